"""N-gram Jaccard self join (operator 1): universe-partition pigeonhole.

Sets are the distinct k-word shingles of each text.  Two sets of sizes l >= s
with Jaccard >= t differ in at most H = (l + s)(1 - t)/(1 + t) elements.

* Equal sets are one class; only the class representative (smallest id) joins.
  (A row whose id stands for another class joins too; it links with its own.)
* *Main index.*  Size bands grow by 4; band b splits the universe into
  3 * 4^b segments by hash.  A set's entries are its non-empty segment subsets.
  Every differing element spoils at most one subset, so a pair whose larger
  entry count exceeds H shares a subset, and by the prefix principle shares one
  among the first H + 1 entries of both in hash order.  Sets near the lower edge
  of a band also enter the band below.
* *Cost-based allocation.*  Shingles found in many sets are given no segment
  (allocation -1): a subset of frequent shingles alone would put unlike texts
  into one bucket.  A set that is left with at most H entries can only be missed
  together with a partner in the same position (subsets that are not shared are
  all spoiled, on both sides).
* *Finest partition.*  Those sets also enter their single elements (segments of
  one element, frequent ones left out).  There only the set's own l - overlap
  differing elements spoil entries, at most A, so the first A + 1 in hash order
  do; again a pair without a common entry has at most A entries on both sides.
* *One-deletion index.*  The sets still left get ceil((H + 1) / 2) segments over
  the full universe in narrow bands, each with allocation 1: the subset and all
  its one-element deletions.  Allocations add up to H + 1 spoilt elements, so any
  pair agrees on some segment up to one deletion.
* *Buckets to links.*  Each bucket member meets the bucket's smallest set first;
  verified links are merged into components, and only members of different
  components that share a bucket are compared afterwards (large buckets block by
  block, on sketches).  Large groups of near copies therefore cost a star, not
  all pairs, and no link between different texts is lost for the components.
* *Verification.*  A parity sketch whose Hamming distance never exceeds the true
  difference rejects candidates without their texts; the rest are decided on the
  full shingle sets of the whole texts.

Which shingles count as frequent only steers cost: results do not depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.shared import arrow_map, components, documents, dropped, of_ids, stored
from tankwise.llm.words import U, mix, shingles_of_texts
from tankwise.session import settings

K = 5
SIMILARITY = (75, 100)
FREQUENT = 8             # sets holding a shingle, seen by tasks, from which it is frequent
FREQUENT_KEPT = 1 << 20  # most frequent shingles given to the tasks (8 MB at most)
COUNT_CHUNK = 1 << 21    # shingles counted at a time inside a task
SKETCH_BITS = 1 << 16
SMALL_BUCKET = 32        # members up to which a bucket's pairs are joined by Spark
CODEC = "zstd"           # of the tables between the steps: signatures and ids, small after it
FIRST_BUCKETS = 4        # large buckets of a set that its rows name, to report a pair once
BLOCK = 1024             # members of a larger bucket compared at a time


def _differ(a, b, sim):
    """Largest symmetric difference of linked sets of these sizes."""
    p, q = sim
    return (a + b) * (q - p) // (q + p)


def _partner(n, sim):
    """Largest size of a set linked with one of size n."""
    p, q = sim
    return n * q // p


# ------------------------------------------------------------------ first pass
def _fingerprints(batches, k):
    """Rows of kind 0: id, set size, fingerprint, sketch; kind 1: a shingle that
    several sets of this task hold, with their number."""
    kept, seen, size = [], set(), 0

    def counted():
        if not kept:
            return None
        v, c = np.unique(np.concatenate(kept), return_counts=True)
        v, c = v[c > 1], c[c > 1]
        m = len(v)
        return pa.record_batch([pa.array(np.ones(m, np.int8)), pa.nulls(m, pa.int64()), pa.array(c.astype(np.int64)),
                                pa.array(v.view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())],
                               names=["kind", "id", "n", "f1", "f2", "sketch"])

    for batch in batches:
        ids = batch.column(0)
        for row, values, off in shingles_of_texts(batch.column(1), k):
            m = len(off) - 1
            n = np.diff(off)
            f1, f2 = _sums(mix(values, 1), off), _sums(mix(values, 2), off)
            sketches = []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                v = values[a:b]
                sketches.append(_sketch(v))
                key = (int(f1[i]), int(f2[i]))
                if key not in seen:
                    seen.add(key)
                    kept.append(v)
                    size += b - a
            yield pa.record_batch([pa.array(np.zeros(m, np.int8)), ids.slice(row, m), pa.array(n),
                                   pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                                   pa.array(sketches, pa.binary())],
                                  names=["kind", "id", "n", "f1", "f2", "sketch"])
            if size >= COUNT_CHUNK:
                yield counted()
                kept, seen, size = [], set(), 0
    out = counted()
    if out is not None:
        yield out


def _sums(values, off):
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _sketch(values) -> bytes:
    """Parity of the shingles in each of 2 to 4 times as many cells (a power of two)."""
    n = len(values)
    bits = min(SKETCH_BITS, max(64, 1 << int(np.ceil(np.log2(max(2 * n, 1))))))
    par = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(par.astype(np.uint8)).tobytes()


# ---------------------------------------------------------------- signatures
def _signatures(batches, k, sim, frequent):
    """(sig, id, n) of the representatives: main and one-deletion entries."""
    names = ["sig", "id", "n"]
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, values, off in shingles_of_texts(batch.column(1), k):
            m = len(off) - 1
            n = np.diff(off)
            doc = np.repeat(np.arange(m), n)
            cold = np.ones(len(values), bool)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                cold &= frequent[at] != values
            cv, cd = values[cold], doc[cold]
            band = np.zeros(m, np.int64)
            big = n > 0
            band[big] = np.floor(np.log2(n[big]) / 2 + 1e-12).astype(np.int64)
            band += (4 ** (band + 1) <= n).astype(np.int64)
            band -= ((4 ** band > n) & (band > 0)).astype(np.int64)
            edge = 4 ** band
            own = _differ(n, _partner(n, sim), sim)
            low = np.where((band > 0) & (n <= _partner(edge - 1, sim)), _differ(n, edge - 1, sim), -1)
            sigs, who, few = [], [], np.zeros(m, bool)
            for scheme, most in ((band, own), (band - 1, low)):
                use = big & (most >= 0)
                s, d = _entries(cv, cd, scheme, use, m)
                rank, order, count = _ranks(s, d, m)
                take = rank <= most[d[order]]
                sigs.append(s[order][take])
                who.append(d[order][take])
                few |= use & (count <= most)
            for i in np.flatnonzero(few).tolist():
                v = values[off[i]:off[i + 1]]
                own = mix(v[cold[off[i]:off[i + 1]]], 31)
                alone = _alone(len(v), sim)
                s = np.sort(own)[:alone + 1]
                if len(own) <= alone:
                    s = np.concatenate([s, _deletion_entries(v, sim)])
                sigs.append(s)
                who.append(np.full(len(s), i))
            s, w = np.concatenate(sigs), np.concatenate(who)
            yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(ids[row + w]), pa.array(n[w].astype(np.int32))],
                                  names=names)


def _entries(values, doc, scheme, use, m):
    """Signature of each non-empty segment subset: (signatures, text index)."""
    on = use[doc]
    v, d = values[on], doc[on]
    if len(v) == 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    s = scheme[d]
    segments = (3 * 4 ** s).astype(U)
    seg = mix(v, 11) % segments
    key = (d.astype(U) << U(40)) + seg
    order = np.argsort(key, kind="stable")
    key, d, seg, s = key[order], d[order], seg[order], s[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    content = np.add.reduceat(mix(v[order], 12), head)
    return mix(content + mix(seg[head] + (s[head].astype(U) << U(50)), 13)), d[head]


def _ranks(sig, doc, m):
    """Place of each entry in its text's hash order."""
    order = np.argsort((doc.astype(U) << U(44)) + (sig >> U(20)), kind="stable")
    count = np.bincount(doc, minlength=m)
    start = np.zeros(m + 1, np.int64)
    np.cumsum(count, out=start[1:])
    return np.arange(len(order)) - start[doc[order]], order, count


def _alone(n, sim):
    """Most elements that a set of size n has outside a linked set."""
    p, q = sim
    smallest = -(-n * p // q)
    return n + (-p * (n + smallest) // (p + q))


def _deletion_entries(values, sim):
    """Entries of one set over the full universe with allocation 1 (the last
    segment 0 when H + 1 is odd), in the narrow bands that it can share."""
    p, q = sim
    n = len(values)
    top, edges = 1, [1]
    while top <= n:                       # bands [edges[j], edges[j+1])
        top = max(top + 1, top * q // p)
        edges.append(top)
    j = len(edges) - 2
    out = []
    for b in range(j, -1, -1):
        s_top = edges[b + 1] - 1          # a pair belongs to the band of its smaller set
        if b < j and _partner(s_top, sim) < n:
            break
        h = _differ(s_top, _partner(s_top, sim), sim)
        parts, half = (h + 2) // 2, (h + 1) % 2
        seg = (mix(values, 21) % U(parts)).astype(np.int64)
        item = mix(values, 22)
        content = np.zeros(parts, U)
        np.add.at(content, seg, item)
        tag = mix(np.arange(parts).astype(U) + U(b << 32), 23)
        out.append(mix(content + tag, 24))
        gone = np.ones(n, bool) if not half else seg < parts - 1
        out.append(mix(content[seg[gone]] - item[gone] + tag[seg[gone]], 24))
    return np.unique(np.concatenate(out))


# -------------------------------------------------------------------- buckets
def _runs(batches):
    """Input sorted by (sig, n, id).  Keeps signatures that several rows hold;
    ``center`` is the first of the run.  One row is carried between batches."""
    last = None
    for batch in batches:
        sig, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if len(sig) == 0:
            continue
        head = np.zeros(0, np.int64)
        if last is not None:
            sig = np.concatenate([[last[0]], sig])
            ids = np.concatenate([[last[1]], ids])
            n = np.concatenate([[last[2]], n])
        same = np.concatenate([[last is not None and last[4]], sig[1:] == sig[:-1]])
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(sig))))
        center = np.where(head < 0, last[3] if last is not None else 0, ids[np.maximum(head, 0)])
        nxt = np.concatenate([same[1:], [False]])
        out = (same | nxt)
        out[-1] = False                   # decided with the next batch
        yield _bucket_rows(sig[out], ids[out], center[out], n[out])
        last = (sig[-1], ids[-1], n[-1], center[-1], bool(same[-1]))
    if last is not None and last[4]:
        yield _bucket_rows(*(np.array([last[i]]) for i in (0, 1, 3, 2)))


def _bucket_rows(sig, ids, center, n):
    return pa.record_batch([pa.array(sig.astype(np.int64)), pa.array(ids.astype(np.int64)),
                            pa.array(center.astype(np.int64)), pa.array(n.astype(np.int32))],
                           names=["sig", "id", "center", "n"])


# --------------------------------------------------------------- verification
def _sketch_filter(batches, sim):
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            if len(x) < len(y):
                x, y = y, x
            while len(x) > len(y):        # folding halves keeps the parities
                x = x[:len(x) // 2] ^ x[len(x) // 2:]
            keep.append(int(np.bitwise_count(x ^ y).sum()) <= _differ(int(na[i]), int(nb[i]), sim))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _near_in_bucket(key, table: pa.Table, sim) -> pa.Table:
    """Pairs of a bucket, or of two of its blocks, that lie in different
    components and whose sketches do not exclude a link."""
    p, q = sim
    ids, n, c, side = (table[x].to_numpy() for x in ("id", "n", "c", "side"))
    n = n.astype(np.int64)
    across = key[1].as_py() != key[2].as_py()
    raw = table["sketch"].to_pylist()
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        groups.setdefault(len(x), []).append(i)
    packed = {k: np.frombuffer(b"".join(raw[i] for i in v), np.uint64).reshape(len(v), k // 8) for k, v in groups.items()}
    left, right = [], []
    sig, first, sets = key[0].as_py(), table["first"], {}

    def before(i):
        if i not in sets:
            sets[i] = {x for x in first[i].as_py() if x < sig}
        return sets[i]

    for k, rows in groups.items():
        for k2, rows2 in groups.items():
            if k2 < k:
                continue
            other, at = _folded(packed[k2], k // 8), np.array(rows2)
            for i, x in zip(rows, packed[k]):
                ok = (c[at] != c[i]) & (n[at] * p <= n[i] * q) & (n[i] * p <= n[at] * q)
                if across:
                    ok &= side[at] != side[i]
                if k == k2:
                    ok &= at > i
                j = np.flatnonzero(ok)
                if len(j):
                    apart = np.bitwise_count(other[j] ^ x).sum(axis=1)
                    for m in at[j[apart <= _differ(n[at[j]], n[i], sim)]].tolist():
                        if before(i).isdisjoint(before(m)):      # else an earlier bucket has the pair
                            left.append(ids[i])
                            right.append(ids[m])
    a, b = np.array(left, np.int64), np.array(right, np.int64)
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def remaining_pairs(members: DataFrame, sketches: DataFrame, sim) -> DataFrame:
    """Distinct pairs (a > b) of ``members(sig, id, n, c)`` that share a signature
    and lie in different components; pairs from large buckets have passed the
    sketch."""
    p, q = sim
    sizes = members.groupBy("sig").agg(F.count("*").alias("size"))
    sized = members.join(sizes, "sig")
    small = sized.where(F.col("size") <= SMALL_BUCKET)
    l, r = small.alias("l"), small.alias("r")
    few = (l.join(r, F.expr(f"l.sig = r.sig and l.c < r.c and l.n * {p} <= r.n * {q} and r.n * {p} <= l.n * {q}"))
           .select(F.greatest("l.id", "r.id").alias("a"), F.least("l.id", "r.id").alias("b")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # beside its sketch a member carries its first large buckets, a fixed number: a pair with
    # a common one among them is reported there only, a pair without may come several times
    large = (sized.where(F.col("size") > SMALL_BUCKET).groupBy("id", "n", "c")
             .agg(F.sort_array(F.collect_list(F.struct("sig", "size"))).alias("all"))
             .join(sketches.select("id", "sketch"), "id")
             .select("id", "n", "c", "sketch", F.slice("all.sig", 1, FIRST_BUCKETS).alias("first"), F.explode("all").alias("one"))
             .select("id", "n", "c", "sketch", "first", "one.sig", "one.size")
             .withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.col("own").alias("side"), "id", "n", "c", "sketch", "first"))
    many = large.groupBy("sig", "i", "j").applyInArrow(lambda key, t: _near_in_bucket(key, t, sim), "a long, b long")
    return few.unionAll(many).where("a <> b").distinct()


def _exact_links(batches, k, sim):
    p, q = sim
    for batch in batches:
        sets = []
        for name in ("ta", "tb"):
            own = []
            for _, v, off in shingles_of_texts(batch.column(name), k):
                own += [v[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            sets.append(own)
        keep = []
        for x, y in zip(*sets):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and q * both >= p * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, sim) -> DataFrame:
    """The pairs (a, b) of ids whose sets are linked, stored."""
    sa = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    p, q = sim
    both = pairs.join(sa, "a").join(sb, "b").where(F.greatest("na", "nb") * p <= F.least("na", "nb") * q)
    near = stored(arrow_map(both, lambda it: _sketch_filter(it, sim), "a long, b long").distinct(), "near")
    need = near.select(F.col("a").alias("id")).unionAll(near.select(F.col("b").alias("id"))).distinct()
    need = stored(need, "need")
    have = stored(of_ids(texts, need, "left_semi", "id"), "texts")
    ta = have.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = have.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    out = stored(arrow_map(both, lambda it: _exact_links(it, k, sim), "a long, b long").distinct(), "links")
    dropped(have, near, need)
    return out


# ------------------------------------------------------------------- operator
def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
               similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``.

    Null or wordless texts have no shingles and link with nothing: their
    component is themselves.  Rows that repeat an id count as one node (linked if
    any of its texts is); rows without an id get a null component.  An empty
    table gives an empty result.  Other columns are not read."""
    with settings(docs.sparkSession, {"spark.sql.parquet.compression.codec": CODEC}):
        return _joined(docs, id_col, text_col, k, similarity)


def _joined(docs: DataFrame, id_col: str, text_col: str, k: int, sim: tuple[int, int]) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = stored(arrow_map(texts, lambda it: _fingerprints(it, k),
                             "kind byte, id long, n long, f1 long, f2 long, sketch binary"), "sets")
    sets = first.where("kind = 0").select("id", "n", "f1", "f2")
    sketches = first.where("kind = 0 and n > 0 and id is not null").select("id", "n", "sketch")
    top = (first.where("kind = 1").groupBy(F.col("f1").alias("v")).agg(F.sum("n").alias("c"))
           .where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "v").limit(FREQUENT_KEPT).select("v").toPandas())
    frequent = np.sort(top["v"].to_numpy(np.int64).view(U)) if len(top) else np.zeros(0, U)
    common = spark.sparkContext.broadcast(frequent)

    classes = stored(sets.where("n > 0 and id is not null").groupBy("f1", "f2", "n")
                     .agg(F.min("id").alias("rep")), "classes")
    ids = classes.select(F.col("rep").alias("id")).distinct()
    copies = stored(sets.where("n > 0 and id is not null").select("id").distinct().join(ids, "id", "left_anti"), "copies")
    entries = arrow_map(of_ids(texts.where("id is not null"), copies, "left_anti", "id"),
                        lambda it: _signatures(it, k, sim, common.value), "sig long, id long, n int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = stored(arrow_map(entries.repartition(parts, "sig").sortWithinPartitions("sig", "n", "id"),
                               _runs, "sig long, id long, center long, n int"), "buckets")

    rep_sketch = stored(sketches.join(ids, "id", "left_semi").dropDuplicates(["id", "sketch"]), "sketches")
    stars = stored(buckets.where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b"))
                   .distinct(), "stars")
    links = verified(stars, rep_sketch, texts, k, sim)
    comp = stored(components(links), "comp")
    placed = (buckets.select("sig", "id", "n").join(comp, "id", "left")
              .select("sig", "id", "n", F.coalesce("component", "id").alias("c")))
    mixed = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    left = stored(placed.join(mixed, "sig", "left_semi").distinct(), "mixed")
    rest = remaining_pairs(left, rep_sketch, sim)
    done = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = verified(rest.join(done, ["a", "b"], "left_anti"), rep_sketch, texts, k, sim)
    joined = comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)
    final = stored(components(joined), "comp")
    dropped(buckets, stars, left, links, more, rep_sketch, comp)

    member = classes.join(final, F.col("rep") == F.col("id"), "left").select(
        "f1", "f2", "n", F.coalesce("component", "rep").alias("c"))
    return sets.join(member, ["f1", "f2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))


def op1_ngram_join(spark, sf_dir):
    """Near-duplicate classes of all documents by 5-word shingles, Jaccard >= 0.75."""
    return ngram_join(documents(spark, sf_dir))
