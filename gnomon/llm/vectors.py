"""Exact nearest neighbours by a block matrix join with int8 tiles.

Candidates are dealt into blocks; a tile is a block of candidates against some of the queries. Both sides are quantised to
int8 with one scale a vector, and a tile's matrix product gives approximate distances. The quantisation error of each
vector is known exactly, so by the triangle inequality the true distance lies within the sum of the two errors of the
approximate one. A candidate whose lower bound exceeds the k-th smallest distance found so far for its query can't be among
the query's k nearest; the others are computed anew in double precision on the original vectors, and at most k of each
query and block go on. They meet by a rank limit, partition by partition first. Every row is compared with every query:
recall 1.

A block of candidates is held by one task, and the queries pass by it: shuffled are each candidate once and each query once
for each block, in the bytes of the original vectors. Blocks are as large as `COMPONENTS` allows, so there are few of them.
Large tables have a round before, of all queries against 1 piece in `SEEDS`, whose k-th distances are where the
search among all candidates starts; it saves work and decides nothing.

A block keeps of equal vectors the k + 1 rows of smallest ids, as the others can be no query's k nearest, so that large groups of
copies are not computed anew for each other.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, and neither do
vectors of another length than the most common one; a query's own row is left out by its id, so rows that repeat a
query's id are no candidates of it; a repeated candidate id counts once, at its nearest; a repeated query id is one
query with the vector of smallest hash; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R

#: Queries and candidates of a matrix product; candidates of a piece, the unit that is dealt.
QUERIES, CANDIDATES, PIECE = 1024, 2048, 2048
#: Components of a block of candidates, and blocks that small tables are dealt into for the sake of more tasks.
COMPONENTS, BLOCKS = 1 << 24, 64
#: Rows from which on there is a round before, and the part of the pieces that it takes.
SEEDED, SEEDS = 1 << 19, 16


def usable(vec: str) -> Column:
    bad = "x is null or isnan(x) or abs(x) = double('infinity')"
    return F.expr(f"`{vec}` is not null and size(`{vec}`) > 0 and not exists(`{vec}`, x -> {bad}) and exists(`{vec}`, x -> x != 0)")


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and the scale of each row."""
    scale = np.abs(v).max(axis=1).astype(np.float64) / 127
    codes = np.rint(np.divide(v, scale[:, None], out=np.zeros(v.shape), where=scale[:, None] > 0)).clip(-127, 127).astype(np.int8)
    return codes, scale.astype(np.float32)


def restored(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return codes * scale[:, None]


def errors(v: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Length of each row's quantisation error."""
    return np.sqrt(((v.astype(np.float64) - near) ** 2).sum(axis=1)) * (1 + 1e-9)


def _once(ids: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that stay: of rows with equal vectors those of the `most` smallest ids, each id once."""
    bits = np.ascontiguousarray(v).view(np.uint32).reshape(len(v), -1)
    odd = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 62, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.zeros(len(v), np.uint64)
    for x, m in zip(bits.T, odd, strict=True):
        h += x * m
    order = np.lexsort((ids, h))
    at, nth = ids[order], h[order]
    same = np.flatnonzero(nth[1:] == nth[:-1])
    copy = np.zeros(len(v), bool)
    for lo in range(0, len(same), 1 << 14):
        i = same[lo : lo + (1 << 14)]
        copy[i + 1] = (bits[order[i]] == bits[order[i + 1]]).all(axis=1)
    again = copy.copy()
    again[1:] &= at[1:] == at[:-1]
    group = np.cumsum(~copy)
    order, group = order[~again], group[~again]
    rank = np.arange(len(order)) - np.searchsorted(group, group, "left")
    return order[rank < most]


def _true(held: np.ndarray) -> np.ndarray:
    """Flat places of the true ones, of which there are few: eight are looked at together."""
    flat = held.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    eight, one = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[eight] * 8 + one


class Block:
    """A block of candidates, in the order of their lengths, so that those of a product are alike in them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        stay = _once(ids, v, k + 1)
        codes, scale = quantised(v[stay])
        length, error = np.zeros(len(stay)), np.zeros(len(stay))
        for lo in range(0, len(stay), CANDIDATES):
            hi = lo + CANDIDATES
            near = restored(codes[lo:hi], scale[lo:hi])
            length[lo:hi] = np.sqrt((near.astype(np.float64) ** 2).sum(axis=1))
            error[lo:hi] = errors(v[stay[lo:hi]], near)
        order = np.argsort(length, kind="stable")
        self.k, self.ids, self.v = k, ids[stay[order]], v[stay[order]]
        self.codes, self.scale, self.length, self.error = codes[order], scale[order], length[order], error[order]

    def _chunks(self):
        """Bounds of candidates: few first, to have a distance to go by."""
        lo, n = 0, 64
        while lo < len(self.ids):
            yield lo, min(lo + n, len(self.ids))
            lo, n = lo + n, min(n * 4, CANDIDATES)

    def nearest(self, qid: np.ndarray, q: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of query, distance and candidate id: up to k of each query, none farther than cut."""
        codes, scale = quantised(q)
        near = restored(codes, scale)
        error, length = errors(q, near), np.sqrt((near.astype(np.float64) ** 2).sum(axis=1))
        left = np.concatenate([near, np.ones((len(q), 1), np.float32)], axis=1)
        cut, dim = cut.copy(), q.shape[1]
        part, waiting = [], 0
        width = 0  # the arrays below are used again
        for lo, hi in self._chunks():
            near = restored(self.codes[lo:hi], self.scale[lo:hi])
            with np.errstate(all="ignore"):
                # q.c - |c|^2 / 2, which is less the farther c is, is short of what the farthest distance allowed gives.
                right = np.concatenate([near, (self.length[lo:hi, None] ** 2 / -2).astype(np.float32)], axis=1)
                if len(right) != width:
                    width, product, held = len(right), np.empty((len(q), len(right)), np.float32), np.empty((len(q), len(right)), bool)
                np.matmul(left, right.T, out=product)
                far, farthest = self.length[lo:hi].max(), cut + error + self.error[lo:hi].max()
                rounding = (dim + 16) * 2.0**-23 * (length * far + far**2) + 1e-35
                least = (length**2 - farthest**2) / 2 * (1 + 1e-12 * np.sign(length - farthest)) - rounding - 1e-12 * length**2
                least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                np.greater_equal(product, least[:, None], out=held)
                if not max(far, length.max()) < 1e15:  # single precision doesn't hold their squares
                    held[:] = True
            r, c = np.divmod(_true(held), hi - lo)
            size = max(1, (1 << 22) // dim)
            for at in range(0, len(r), size):
                i, j = r[at : at + size], c[at : at + size] + lo
                other = self.ids[j] != qid[i]
                i, j = i[other], j[other]
                diff = np.ascontiguousarray((self.v[j].astype(np.float64) - q[i]).T)
                total = np.zeros(len(i))
                with np.errstate(over="ignore"):
                    for x in diff:  # one component after the other, as the definition adds them
                        total += x * x
                d = np.sqrt(total)
                close = d <= cut[i]
                part.append((i[close], d[close], self.ids[j[close]]))
                waiting += len(part[-1][0])
                if waiting > 1 << 20:
                    part, waiting = [self._best(part, cut)], 0
            # Putting them in order is dear: at once where it lowers the cut much, else when there are many.
            if waiting and (hi - lo < CANDIDATES or waiting > self.k * len(q)):
                part, waiting = [self._best(part, cut)], 0
        return self._best(part, cut) if part else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def _best(self, parts: list, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest ids of each query among parts; cut is lowered to the k-th distance."""
        row, dist, cand = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((dist, cand, row))
        row, dist, cand = row[order], dist[order], cand[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (cand[1:] != cand[:-1])
        row, dist, cand = row[first], dist[first], cand[first]
        order = np.lexsort((cand, dist, row))
        row, dist, cand = row[order], dist[order], cand[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        last = rank == self.k - 1
        cut[row[last]] = np.minimum(cut[row[last]], dist[last])
        stay = rank < self.k
        return row[stay], dist[stay], cand[stay]


def nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(place of query, distance, candidate id): up to k of each query in this tile."""
    found = Block(cid, c, k).nearest(qid, q, np.full(len(qid), np.inf))
    return list(zip(*(x.tolist() for x in found), strict=True))


def _matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(rows, -1)


def _pieces(kind: type, dim: int):
    """Rows (id, vec) into pieces (deal, ids, vecs, cuts), rows that stand together in different ones."""
    size = max(1, min(PIECE, (1 << 17) // dim))

    @R.trimmed
    def run(batches):
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() * 11, [], 0

        def flush():
            nonlocal number, held, n
            ids, v = (np.concatenate([h[i] for h in held]) for i in range(2))
            parts = -(-n // size)
            for p in range(parts):
                yield _sent("deal", number + p, ids[p::parts], v[p::parts], None)
            number, held, n = number + parts, [], 0

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1), batch.num_rows, kind).copy()))
                n += batch.num_rows
                if n >= size * SEEDS:
                    yield from flush()
        if n:
            yield from flush()

    return run


def _sent(name: str, number: int, ids: np.ndarray, v: np.ndarray, cut: np.ndarray | None) -> pa.RecordBatch:
    cuts = pa.array([None if cut is None else cut.tobytes()], pa.binary())
    return pa.record_batch([pa.array([number], pa.int64()), pa.array([ids.tobytes()]), pa.array([np.ascontiguousarray(v).tobytes()]), cuts], names=[name, "ids", "vecs", "cuts"])


def _queries(kind: type):
    """Rows (id, vec, cut) into rows (deal, ids, vecs, cuts)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cut = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                yield _sent("deal", -1, batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1), batch.num_rows, kind), cut)

    return run


def _tiles(kind: type, dim: int, k: int):
    """Rows (block, ids, vecs, cuts), sorted by block and those of candidates (cuts null) first, into rows (query_id, score, vec_id)."""

    @R.trimmed
    def run(batches):
        at, block, pieces, waiting, n = None, None, [], [], 0

        def search():
            nonlocal block, pieces, waiting, n
            if block is None and pieces:
                block = Block(*(np.concatenate([p[i] for p in pieces]) for i in range(2)), k)
                pieces = []
            if block is not None and waiting:
                qid, q, cut = (np.concatenate([w[i] for w in waiting]) for i in range(3))
                for lo in range(0, len(qid), QUERIES):
                    own = qid[lo : lo + QUERIES]
                    row, dist, cand = block.nearest(own, q[lo : lo + QUERIES], cut[lo : lo + QUERIES])
                    yield pa.record_batch([pa.array(own[row], pa.int64()), pa.array(dist, pa.float64()), pa.array(cand, pa.int64())], names=["query_id", "score", "vec_id"])
            waiting, n = [], 0

        for batch in batches:
            for number, ids, vecs, cuts in zip(*(batch.column(i) for i in range(4)), strict=True):
                if number.as_py() != at:
                    yield from search()
                    at, block, pieces = number.as_py(), None, []
                ids, v = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vecs.as_buffer(), kind).reshape(-1, dim)
                if not cuts.is_valid:
                    pieces.append((ids.copy(), v.copy()))
                    continue
                waiting.append((ids.copy(), v.copy(), np.frombuffer(cuts.as_buffer(), np.float64).copy()))
                n += len(ids)
                if n >= QUERIES:
                    yield from search()
        yield from search()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of all blocks."""
    # At most k rows of each block and query. The rank limit is applied in every partition before rows of a query meet, so
    # no task holds more of a query than it needs, however many blocks there are.
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, nearest first, ties to the smaller id."""
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind = np.float32 if single else np.float64
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    rows = vectors.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), is_query.alias("q"))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim, n = (size[0]["n"], size[0]["count"]) if size else (1, 0)
    rows = rows.where(F.size("vec") == dim)
    queries = rows.where("q").groupBy("id").agg(F.expr("min_by(vec, xxhash64(cast(vec as array<double>)))").alias("vec"))
    queries = R.table(spark, queries, "queries")
    dealt = rows.select("id", "vec").mapInArrow(_pieces(kind, dim), "deal long, ids binary, vecs binary, cuts binary")

    def found(pieces: DataFrame, blocks: int, queries: DataFrame) -> DataFrame:
        """Each query goes to each block of candidates."""
        sent = queries.mapInArrow(_queries(kind), "deal long, ids binary, vecs binary, cuts binary")
        sent = sent.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "ids", "vecs", "cuts")
        met = pieces.select((F.expr(f"deal div {SEEDS} + deal % {SEEDS}") % blocks).alias("block"), "ids", "vecs", "cuts").unionByName(sent)
        # Four partitions a block leave few partitions with several blocks.
        met = met.repartition(4 * blocks, "block").sortWithinPartitions("block", F.col("cuts").isNotNull())
        return met.mapInArrow(_tiles(kind, dim, k), "query_id long, score double, vec_id long")

    blocks = max(1, -(-n * dim // COMPONENTS), min(-(-n // PIECE), BLOCKS))
    none = F.lit(float("inf")).alias("cut")
    if n < SEEDED:
        best = _best(found(dealt, blocks, queries.select("id", "vec", none)), k)
    else:
        first = found(dealt.where(f"deal % {SEEDS} = 0"), max(4 * -(-blocks // SEEDS), 16), queries.select("id", "vec", none))
        cuts = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cut"))
        queries = R.table(spark, queries.join(cuts, "id", "left").select("id", "vec", F.coalesce("cut", none).alias("cut")), "cuts")
        best = _best(found(dealt, blocks, queries), k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    return search(spark, R.load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
