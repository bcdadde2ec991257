"""ST5: fuel-drop alerts by keyed state with event-time timers.

Readings of a unit wait in its state until the watermark has passed them, so they are
judged in the order of their times whatever order they come in.  A timer stands at
the unit's earliest waiting reading; after its last one it stands at the end of the
silence after which the unit's state is dropped.

Waiting readings are kept as pieces, sorted by time.  A large chunk of one unit's
readings is cut at whole minutes, and the pieces that are due are taken in order of
time with only those held at once that overlap: what a hot unit needs in memory is its
readings of a minute and its small pieces, not its micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

OUT_SCHEMA = ("event_id long, equipment_id string, ts timestamp_ntz, prev_level double, "
              "fuel_level double, fuel_consumed double, missing double")
COLUMNS = ["event_id", "equipment_id", "ts", "prev_level", "fuel_level", "fuel_consumed", "missing"]
ROW = np.dtype([("ts", "<i8"), ("id", "<i8"), ("level", "<f8"), ("used", "<f8"), ("may_drop", "?")])
SMALL = 1_000            # readings of a chunk that stay one piece
MINUTE = 60_000_000


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    """A chunk as sorted rows; readings without a time have no place and are left out."""
    pdf = pdf[pdf["ts"].notna()]
    out = np.zeros(len(pdf), ROW)
    out["ts"] = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
    out["id"] = pdf["event_id"].fillna(-1).to_numpy(dtype=np.int64)
    out["level"] = pdf["fuel_level"].to_numpy(dtype=float)
    out["used"] = pdf["fuel_consumed"].to_numpy(dtype=float)
    # as in the SQL rule, an unknown refuel flag does not fire
    out["may_drop"] = (pdf["refuel_event"].notna() & (pdf["refuel_event"] != "Yes")).to_numpy(dtype=bool)
    return out[np.lexsort((out["id"], out["ts"]))]


def pieces(rows: np.ndarray) -> list[np.ndarray]:
    """Sorted rows as pieces: one if they are few, else cut at whole minutes."""
    if len(rows) <= SMALL:
        return [rows] if len(rows) else []
    return np.split(rows, np.flatnonzero(np.diff(rows["ts"] // MINUTE)) + 1)


def in_order(keys: list[tuple[int, int, int]], load) -> Iterator[np.ndarray]:
    """Rows of the pieces ``(first, last, number)`` in order of time, as runs; ``load``
    gives a piece's rows.  Only pieces that overlap are held together."""
    held = np.zeros(0, ROW)
    for first, _, number in sorted(keys):
        before = held["ts"] < first
        if before.any():
            yield held[before]
            held = held[~before]
        held = np.concatenate([held, load((first, _, number))])
        held = held[np.lexsort((held["id"], held["ts"]))]
    if len(held):
        yield held


def judged(rows: np.ndarray, last: tuple[int, int, float] | None, silence: int):
    """Alerts among ``rows`` (sorted) that follow the reading ``last``, and the new last
    reading; repeats and readings before ``last`` are left out.  A reading that follows
    more than ``silence`` micros later has none before it."""
    if last is not None:
        rows = rows[(rows["ts"] > last[0]) | ((rows["ts"] == last[0]) & (rows["id"] > last[1]))]
    if len(rows) == 0:
        return rows, np.zeros(0), last
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["ts"][1:] != rows["ts"][:-1]) | (rows["id"][1:] != rows["id"][:-1])
    rows = rows[fresh]
    prev = np.concatenate(([np.nan if last is None else last[2]], rows["level"][:-1]))
    prev[np.diff(rows["ts"], prepend=rows["ts"][0] if last is None else last[0]) > silence] = np.nan
    x = prev - rows["used"]
    with np.errstate(invalid="ignore"):
        fired = rows["may_drop"] & ~np.isnan(prev) & (x > 0) & ((x - rows["level"]) >= 0.1 * x)
    return rows[fired], prev[fired], (int(rows["ts"][-1]), int(rows["id"][-1]), float(rows["level"][-1]))


class FuelDrop(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, id long, level double")
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getMapState("waiting", "first long, last long, number long", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        if pd.isna(key[0]):                                    # readings of no unit have no series
            for _ in rows:
                pass
            return iter([])
        number = self.count.get()[0] if self.count.exists() else 0
        first = None
        for pdf in rows:
            for piece in pieces(_rows(pdf)):
                span = (int(piece["ts"][0]), int(piece["ts"][-1]), number)
                self.waiting.updateValue(span, (piece.tobytes(),))
                first = span[0] if first is None else min(first, span[0])
                number += 1
        self.count.update((number,))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        limit = mark * 1000                                    # later readings may still come before others
        keys = [tuple(k) for k in self.waiting.keys()]
        due = [k for k in keys if k[0] <= limit]
        last = tuple(self.last.get()) if self.last.exists() else None
        number = self.count.get()[0] if self.count.exists() else 0
        rest: list[int] = [k[0] for k in keys if k[0] > limit]

        def load(k):
            rows = np.frombuffer(self.waiting.getValue(k)[0], ROW)
            self.waiting.removeKey(k)
            return rows
        left = []
        for run in in_order(due, load):
            ready = run["ts"] <= limit
            left.append(run[~ready])
            rows, prev, last = judged(run[ready], last, self.silence_ms * 1000)
            if len(rows):
                yield pd.DataFrame({
                    "event_id": rows["id"], "equipment_id": key[0], "ts": rows["ts"].astype("datetime64[us]"), "prev_level": prev,
                    "fuel_level": rows["level"], "fuel_consumed": rows["used"],
                    "missing": (prev - rows["used"]) - rows["level"]})[COLUMNS]
        for piece in [p for part in left for p in pieces(part)]:
            self.waiting.updateValue((int(piece["ts"][0]), int(piece["ts"][-1]), number), (piece.tobytes(),))
            rest.append(int(piece["ts"][0]))
            number += 1
        self.count.update((number,))
        end = None if last is None else last[0] // 1000 + self.silence_ms
        if end is not None and end < mark:                     # whatever comes is too much later
            self.last.clear()
        elif end is not None:
            self.last.update(last)
        if rest:
            self.handle.registerTimer(min(rest) // 1000 + 1)
        elif end is not None and end >= mark:
            self.handle.registerTimer(end + 1)
        else:
            self.count.clear()

    def close(self) -> None:
        pass
