"""Properties from the test strategy on the sf0.001 view."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from support import SF_SMALL
from tankwise.operators import features as FE
from tankwise.operators.sequence import ordered_split
from tankwise.plans import views as V
from tankwise.sources.tables import telemetry


def test_rolling_mean_within_frame_bounds(spark):
    t = telemetry(spark, SF_SMALL)
    r = FE.with_rolling(t)
    w = Window.partitionBy("equipment_id").orderBy("ts", "event_id").rowsBetween(-11, 0)
    chk = r.select("avg_consumption_12h", F.min("fuel_consumed").over(w).alias("lo"),
                   F.max("fuel_consumed").over(w).alias("hi"))
    bad = chk.filter((F.col("avg_consumption_12h") < F.col("lo") - 1e-9) |
                     (F.col("avg_consumption_12h") > F.col("hi") + 1e-9)).count()
    assert bad == 0


def test_split_count_is_floor_of_fraction(spark):
    t = telemetry(spark, SF_SMALL).select("event_id", "equipment_id", "ts")
    n = t.count()
    s = ordered_split(t, 0.8)
    assert s.filter("is_train").count() == int(n * 0.8) and s.count() == n


def test_payload_lengths_sum_to_rows(spark):
    t = telemetry(spark, SF_SMALL)
    p = V.nested_payload(t)
    assert p.agg(F.sum(F.size("history"))).first()[0] == t.count()
    assert p.filter(F.size("history") != F.col("n_items")).count() == 0


def test_equipment_detail_lookup_and_not_found(spark):
    t = telemetry(spark, SF_SMALL)
    some = t.select("equipment_id").first()[0]
    one = V.equipment_detail(t, [some]).collect()
    assert len(one) == 1 and one[0]["equipment_id"] == some
    assert V.equipment_detail(t, ["NO-SUCH-ID"]).count() == 0
