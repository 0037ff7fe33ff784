"""Near-duplicates by min-max hashing: one hash evaluation gives two signature values, the least and the largest.

One pass over the texts writes, per document, the size of its shingle set, a 128-bit fingerprint of the set, its band
keys and one byte of each signature value. The number of bands follows from the threshold (`bands_for`). Documents with
equal sets form a class; only one of each class goes on.

Candidates, round one: in each bucket of a band the smallest id is the hub, and every other member is paired with it,
so a bucket of m gives m - 1 pairs. Pairs are confirmed on full sets, and confirmed links make components. Round two:
in buckets that still hold several components, the members outside the bucket's largest component are searched block by
block against all members for pairs across components whose signatures agree often enough for the threshold (six
standard deviations of slack); these are confirmed as well. So no member of a bucket is skipped, nothing is capped, and
no group's pairs are emitted wholesale. A link at the threshold itself shares no bucket with probability below 1e-6,
whatever the threshold and the size of the sets; only unequal sets that share one single shingle (possible at thresholds
of one half or less) never do.

What is shuffled: band keys with ids, once to find buckets of several; signatures and full sets only of documents that
sieves let through. Texts never are; `keep_near` shuffles the few rows that a sieve takes for dropped ones by mistake.

Defined results: null and empty texts, and texts of white space, have an empty set and link with nothing; rows with a
null id get a null component and stay; rows that repeat an id are one node, and all stay if that node does; other
columns are not read by `near_groups` and pass through `keep_near` untouched, whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T
from gnomon.llm.graph import components

#: Least number of bands of a signature, hash evaluations in a band (two values each), and the chance of a link at the
#: threshold to share no bucket.
LEAST_BANDS, PER_BAND, MISS = 32, 3, 1e-6
#: Members of a block when buckets are searched in round two.
BLOCK = 512


def agreement(both: int, union: int) -> float:
    """Probability that two sets agree in the minimum and the maximum of a hash function."""
    return both * (both - 1) / (union * (union - 1))


@functools.cache
def bands_for(num: int, den: int) -> int:
    """Bands with which a link at the threshold num / den, or the nearest one above it that a union of any size can
    have, shares no bucket with probability below MISS."""
    # The agreement nears (num / den) ** 2 as unions grow and is less only where they are small.
    sizes = ((-(-num * u // den), u) for u in range(2, 4096))
    least = min([(num / den) ** 2, *(agreement(i, u) for i, u in sizes if 1 < i < u)])
    if least >= 1:
        return LEAST_BANDS
    return max(LEAST_BANDS, math.floor(math.log(MISS) / math.log1p(-(least**PER_BAND))) + 1)


@functools.cache
def _random(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    n, odd = bands * PER_BAND, np.uint64(1)
    xor = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64)
    mul = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + odd
    return xor, mul, rng.integers(0, 1 << 63, (bands, 2 * PER_BAND), dtype=np.uint64) * np.uint64(2) + odd


def signature(shingles: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each hash function."""
    xor, mul, _ = _random(bands)
    low = high = None
    for i in range(0, len(shingles), 1024):
        h = (shingles[None, i : i + 1024] ^ xor) * mul
        lo, hi = h.min(axis=1), h.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int) -> np.ndarray:
    values = T.mix(np.concatenate([low.reshape(bands, PER_BAND), high.reshape(bands, PER_BAND)], axis=1))
    return T.mix((values * _random(bands)[2]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sub-batches of (id, text) with the shingle set of each row."""
    for batch in batches:
        data, offs = T.text_bytes(batch.column(1))
        for i, j in T.slices(offs, 1 << 19):
            *_, hashes, first = T.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield batch.slice(i, j - i), [T.row_shingles(hashes[first[r] : first[r + 1]], k) for r in range(j - i)]


def _signed(k: int, bands: int):
    @R.trimmed
    def run(batches):
        for batch, sets in _each(batches, k):
            n, one, two, keys, sig = [], [], [], [], []
            for s in sets:
                n.append(len(s))
                if not len(s):
                    one.append(None), two.append(None), keys.append(None), sig.append(None)
                    continue
                low, high = signature(s, bands)
                print_ = T.mix(s * T.ORDER[0])
                one.append(int(print_.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(T.mix(s + T.ORDER[1])).view(np.int64)))
                keys.append(band_keys(low, high, bands))
                sig.append(np.concatenate([T.mix(low), T.mix(high)]).astype(np.uint8).tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["id", "n", "f1", "f2", "bands", "sig"],
            )

    return run


def _sets(k: int):
    @R.trimmed
    def run(batches):
        for batch, sets in _each(batches, k):
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return run


def _linked(num: int, den: int):
    @R.trimmed
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(both) - same))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(spark: SparkSession, docs: DataFrame, pairs: DataFrame, several: Callable[..., Column], k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b: ids) whose full shingle sets have den * intersection >= num * union. several: a test of ids
    that more than one row has."""
    kind = dict(docs.dtypes)["id"]
    sets = _sets_of(spark, docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), several, k)
    hub = R.sieve(spark, pairs, "a")("id")
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    met = met.join(sets.where(hub).select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")
    return R.table(spark, met.mapInArrow(_linked(num, den), f"a {kind}, b {kind}"), "links")


def _sets_of(spark: SparkSession, docs: DataFrame, ids: DataFrame, several: Callable[..., Column], k: int) -> DataFrame:
    """(id, set) of all rows whose id is among ids, and of few others; rows alike once."""
    texts = docs.where(R.sieve(spark, ids, "id")("id"))
    sets = R.table(spark, texts.mapInArrow(_sets(k), f"id {dict(docs.dtypes)['id']}, set binary"), "sets")
    return sets.where(~several("id")).unionByName(sets.where(several("id")).distinct())


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Complete groups of rows that arrive sorted by their keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        k = np.stack([table.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield table.slice(lo, hi - lo)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


KEYS = ["bucket", "i", "j"]


def _near_pairs(table: pa.Table, num: int, den: int, values: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs in different components, close in size and in signature, of a block outside the largest component
    (side 0) and one of all members (side 1)."""
    comp, n, side = (table.column(c).to_numpy() for c in ("comp", "n", "side"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, values)
    rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows:
        c = cols[(comp[cols] != comp[r]) & (den * np.minimum(n[cols], n[r]) >= num * np.maximum(n[cols], n[r]))]
        c = c[(sig[c] == sig[r]).sum(axis=1) >= least]
        left.append(np.full(len(c), r)), right.append(c)
    return np.concatenate(left), np.concatenate(right)


def _across(num: int, den: int, kind: pa.DataType):
    """Of each pair of blocks, the pairs to confirm; where these would outnumber the rows, the rows that take part
    (b null), to be confirmed block by block."""
    t = num / den
    expected = t + (1 - t) / 256
    values = 2 * bands_for(num, den) * PER_BAND
    least = values * expected - 6 * math.sqrt(values * expected * (1 - expected))

    @R.trimmed
    def run(batches):
        for table in _groups(batches, KEYS):
            a, b = _near_pairs(table, num, den, values, least)
            if not len(a):
                continue
            ids = table.column("id").combine_chunks()
            if len(a) <= table.num_rows:
                none = pa.nulls(len(a), pa.int64())
                yield pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b)), none, *[pa.nulls(len(a), pa.int32())] * 3, pa.nulls(len(a), kind)], names=["a", "b", *KEYS, "side", "comp"])
                continue
            part = table.take(pa.array(np.unique(np.concatenate([a, b]))))
            cols = [part.column(c).combine_chunks() for c in ("id", *KEYS, "side", "comp")]
            yield pa.record_batch([cols[0], pa.nulls(part.num_rows, kind), *cols[1:]], names=["a", "b", *KEYS, "side", "comp"])

    return run


def _dense(num: int, den: int):
    """Links between blocks of a bucket on full sets: intersections of all members at once as a matrix product over
    the shingles that members share. Links inside a component found so far are not repeated, so a block gives fewer
    links than it has rows."""

    @R.trimmed
    def run(batches):
        for table in _groups(batches, KEYS):
            side, comp = table.column("side").to_numpy(), table.column("comp").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            values, code = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            same = np.zeros((len(sets), len(sets)), np.float32)
            for lo in range(0, len(values), 4096):
                at = np.flatnonzero((code >= lo) & (code < lo + 4096))
                hold = np.zeros((len(sets), min(4096, len(values) - lo)), np.float32)
                hold[owner[at], code[at] - lo] = 1
                same += hold @ hold.T
            linked = den * same >= num * (sizes[:, None] + sizes[None, :] - same)
            linked &= (side[:, None] == 0) & (side[None, :] == 1) & (comp[:, None] != comp[None, :])
            root = {c: c for c in comp.tolist()}

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            a, b = [], []
            for r, c in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                x, y = find(comp[r]), find(comp[c])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(r), b.append(c)
            ids = table.column("id").combine_chunks()
            yield pa.record_batch([ids.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    return run


def _classes(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (id, n, bands, sig) for each different set, that of the smallest id; and (rep, id) of all other rows."""
    on, narrow = ["n", "f1", "f2"], rows.select("id", "n", "f1", "f2")
    by_id = narrow.groupBy(*on, "id").agg(F.count("*").alias("c"))
    same = by_id.groupBy(*on).agg(F.min(F.struct("id", "c")).alias("best"), F.sum("c").alias("size")).where("size > 1")
    same = R.table(spark, same.select(*on, F.col("best.id").alias("rep"), F.col("best.c").alias("copies")), "classes")
    shared = R.sieve(spark, same, *on)(*on)
    met = R.attach(narrow.where(shared), same, on, ["id"])
    members = R.table(spark, met.where("rep != id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "members")
    best = R.attach(rows.where(shared), same, on, ["id"], narrow.where(shared)).where("rep is null or rep = id")
    once = best.where("rep is null or copies = 1").select("id", "n", "bands", "sig")
    several = best.where("copies > 1").groupBy(*on, "id").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")).select("id", "n", "bands", "sig")
    return R.table(spark, rows.where(~shared).select("id", "n", "bands", "sig").unionByName(once).unionByName(several), "reps"), members


def _buckets(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(bucket, id, n, hub, hn) of the members of all buckets of several; hub: the smallest id, hn: the size of its set."""
    banded = classes.select("id", "n", F.explode("bands").alias("bucket"))
    crowded = R.sieve(spark, banded.groupBy("bucket").count().where("count > 1"), "bucket")
    held = R.table(spark, banded.where(crowded("bucket")), "banded")
    hubs = held.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    hubs = hubs.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hn"))
    return R.table(spark, held.join(hubs, "bucket"), "held")  # a hot bucket's rows are split by adaptive execution


def _round_two(spark: SparkSession, docs: DataFrame, classes: DataFrame, held: DataFrame, links: DataFrame, several, k: int, num: int, den: int) -> list[DataFrame]:
    """Links between components that share a bucket."""
    kind, arrow = dict(docs.dtypes)["id"], R.arrow_type(docs, "id")
    first = components(spark, links)
    part = held.join(first, held["id"] == first["node"], "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp"))
    part = R.table(spark, part, "parts")
    by_comp = part.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    mixed = by_comp.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    # Blocks of all members, and blocks of those outside the largest component.
    mixed = mixed.select("bucket", F.col("main.comp").alias("main"), F.expr(f"int(ceil(m / {BLOCK}))").alias("blocks"), F.expr(f"int(ceil((m - main.c) / {BLOCK}))").alias("outer_blocks"))
    mixed = R.table(spark, mixed, "mixed")
    rest = R.table(spark, part.where(R.sieve(spark, mixed, "bucket")("bucket")).join(mixed, "bucket"), "rest")
    sigs = classes.where(R.sieve(spark, rest, "id")("id")).select("id", "sig")
    rest = rest.join(sigs, "id")
    block = lambda of: F.expr(f"int(pmod(xxhash64(id), {of}))")
    numbers = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    outer = rest.where("comp != main").select("*", F.lit(0).alias("side"), block("outer_blocks").alias("i"), numbers("blocks").alias("j"))
    every = rest.select("*", F.lit(1).alias("side"), numbers("outer_blocks").alias("i"), block("blocks").alias("j"))
    met = outer.unionByName(every).select(*KEYS, "side", "id", "n", "comp", "sig").repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = R.table(spark, met.mapInArrow(_across(num, den, arrow), f"a {kind}, b {kind}, bucket long, i int, j int, side int, comp {kind}"), "found")
    single = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = confirm(spark, docs, R.table(spark, single, "single"), several, k, num, den)
    crowd = found.where("b is null").select(*KEYS, "side", F.col("a").alias("id"), "comp")
    crowd = crowd.join(_sets_of(spark, docs, crowd, several, k), "id").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return [more, R.table(spark, crowd.mapInArrow(_dense(num, den), f"a {kind}, b {kind}"), "dense")]


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable through links), kept."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.dtypes)["id"]
    signed = R.table(spark, docs.mapInArrow(_signed(k, bands_for(num, den)), f"id {kind}, n long, f1 long, f2 long, bands array<long>, sig binary"), "signed")
    several = R.sieve(spark, signed.where("id is not null").groupBy("id").count().where("count > 1"), "id")
    # Members of a class are linked to its smallest id; so are the sets of an id that rows repeat with different texts.
    classes, members = _classes(spark, signed.where("n > 0 and id is not null"))
    held = _buckets(spark, classes)
    fits = F.expr(f"{den} * least(n, hn) >= {num} * greatest(n, hn)")
    stars = R.table(spark, held.where("id != hub").where(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = confirm(spark, docs, stars, several, k, num, den)
    whole = links.unionByName(members)
    for more in _round_two(spark, docs, classes, held, links, several, k, num, den):
        whole = whole.unionByName(more)
    whole = components(spark, whole)
    rows = signed.select("id", "n")
    linked = rows.where("id is not null").join(whole, rows["id"] == whole["node"], "left").select("id", "n", F.coalesce("component", "id").alias("comp"))
    linked = linked.unionByName(rows.where("id is null").withColumn("comp", F.col("id")))
    return linked.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept")
    )


def keep_near(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay, with all their columns: one document of each component."""
    groups = near_groups(spark, docs, id_col, text_col, k, num, den)
    gone = R.table(spark, groups.where("not kept").select(F.col(id_col).alias("id")).distinct(), "gone")
    dropped = F.coalesce(R.sieve(spark, gone, "id")("id"), F.lit(False)) & F.col("id").isNotNull()
    # Ids that the sieve takes for dropped ones by mistake; only rows of theirs are shuffled.
    rows, names = R.apart(docs)
    rows = rows.withColumn("id", F.col(names[docs.columns.index(id_col)]))
    mistaken = R.table(spark, docs.select(F.col(id_col).alias("id")).where(dropped).join(gone, "id", "left_anti").distinct(), "mistaken")
    back = rows.where(dropped & R.sieve(spark, mistaken, "id")("id")).join(gone, "id", "left_anti")
    return R.restored(rows.where(~dropped).unionByName(back), docs)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    return near_groups(spark, R.load(spark, sf_dir, "documents"), k=3, num=85, den=100)


#: DuckDB SQL of op2: shingle sets, their links, and components by the smallest id that spreads along links.
OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
l AS (
  SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
