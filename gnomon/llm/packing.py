"""Best-fit packing of token sequences in bulk-synchronous rounds.

A round range-sorts the pieces that have no place yet and the gaps, longest first and gaps before pieces of their size.
Each partition sweeps its stretch: a piece goes to its successor, the smallest gap seen that is large enough, which is the
top of a stack; a gap that still takes pieces of that size stays there, else it waits until the sweep comes to its size.
Pieces that find no gap in their own partition take those left over in the partitions of larger sizes, nearest first: which
leftover piece takes which leftover gap is settled by their ranks, from the partitions' counts alone, so no two pieces get
one place. Then the gaps are brought up to date. Pieces longer than every gap open new sequences: those of at least half the
greatest length left, one after the other in the order of length. So it goes on until every piece has a place.

The driver sees one row of counts a partition and round, never pieces or gaps. Pieces of one length, however common, are
dealt over partitions by their hashes. Every round's tables are written to the shared folder.

Defined results: a null or empty text is the end id alone; rows with a null id, and repeated rows, are packed as any
other; other columns are not read. Texts of more than `most` ids are cut into pieces of `most`, the first shorter.
"""

from __future__ import annotations

import heapq
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T
from gnomon.llm.bpe import encoder, with_ends

#: Ids of a sequence, and the id that ends a document.
MOST, END = 1024, 2
#: Rows of a round: gaps (id: the sequence), pieces without a place, and pieces with one.
GAP, PIECE, PLACED = 0, 1, 2
_ROW = "kind int, id long, size long, used long, seq long, part int, rank long"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
_NAMES = ["kind", "id", "size", "used", "seq", "part", "rank"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _sorted(rows: DataFrame) -> DataFrame:
    """Longest first, gaps before pieces of their size; rows alike in both are told apart by a hash, so they spread."""
    order = [F.col("size").desc(), F.col("kind"), F.xxhash64("id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def sweep(rows, part: int = 0) -> list[tuple]:
    """Rows (kind, id, size, used) of one partition, in order, to rows of _ROW. Leftover pieces have a rank, and so have
    leftover gaps that pieces of later partitions may take, smallest last; gaps that have shrunk below the partition's own
    sizes have rank -1. A placed piece's `used` is its offset."""
    out, stack, waiting, missed = [], [], [], 0
    for kind, number, size, used in rows:
        while waiting and -waiting[0][0] >= size:
            least, seq, full = heapq.heappop(waiting)
            stack.append([-least, seq, full])
        if kind == GAP:
            stack.append([size, number, used])
        elif not stack:
            out.append((PIECE, number, size, 0, None, part, missed))
            missed += 1
        else:
            gap = stack[-1]
            out.append((PLACED, number, size, gap[2], gap[1], part, None))
            gap[0], gap[2] = gap[0] - size, gap[2] + size
            if gap[0] < size:
                stack.pop()
                if gap[0]:
                    heapq.heappush(waiting, (-gap[0], gap[1], gap[2]))
    out += [(GAP, seq, size, used, None, part, k) for k, (size, seq, used) in enumerate(stack)]
    return out + [(GAP, seq, -least, used, None, part, -1) for least, seq, used in waiting]


def _swept(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
    out = sweep(rows, part)
    for k in range(0, len(out), 50_000):
        yield _batch(out[k : k + 50_000])


def by_rank(counts: list[tuple]) -> list[tuple]:
    """Which leftover pieces take which leftover gaps: (part, first rank, pieces, gap's part, rank of the first gap, pieces
    to each gap), gaps' ranks going down. counts: (part, pieces, longest piece, gaps, smallest gap) in the order of parts."""
    stack, out = [], []
    for part, pieces, longest, gaps, smallest in counts:
        rank, left = 0, pieces
        while left and stack:
            top = stack[-1]
            each = max(1, top[2] // longest)
            use = min(top[1], -(-left // each))
            took = min(left, use * each)
            out.append((part, rank, took, top[0], top[1] - 1, each))
            rank, left, top[1] = rank + took, left - took, top[1] - use
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps, smallest])
    return out


def _opened(most: int, number: int):
    """Pieces, longest first, into new sequences one after the other."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seq, used, out = (number << 48) + (part << 28) - 1, most, []
        for b in batches:
            for size, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if used + size > most:
                    if used < most:
                        out.append((GAP, seq, most - used, used, None, part, -1))
                    seq, used = seq + 1, 0
                out.append((PLACED, piece, size, used, seq, part, None))
                used += size
            yield _batch(out)
            out = []
        if used < most:
            yield _batch([(GAP, seq, most - used, used, None, part, -1)])

    return run


def place(spark: SparkSession, pieces: DataFrame, most: int = MOST) -> DataFrame:
    """(id, seq, used: offset) of pieces (id: unique, size: 1 to `most`)."""
    plain = ["kind", "id", "size", "used"]
    state = pieces.select(F.lit(PIECE).alias("kind"), "id", F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("used"))
    done, number = [], 0
    while True:
        of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
        seen = state.agg(F.max(of(PIECE, "size")).alias("longest"), F.min(of(PIECE, "size")).alias("least"), F.max(of(GAP, "size")).alias("gap")).first()
        if seen["longest"] is None:
            break
        left, gaps = state.where(F.col("kind") == PIECE), state.where((F.col("kind") == GAP) & (F.col("size") >= seen["least"]))
        if seen["longest"] > (seen["gap"] or 0):
            number += 1
            bound = max(seen["gap"] or 0, seen["longest"] // 2)
            opened = _sorted(left.where(F.col("size") > bound)).select("size", "id").mapInArrow(_opened(most, number), _ROW)
            opened = R.table(spark, opened, "opened")
            done.append(opened.where(F.col("kind") == PLACED).select("id", "seq", "used"))
            left, gaps = left.where(F.col("size") <= bound), gaps.unionByName(opened.where(F.col("kind") == GAP).select(*plain))
        swept = R.table(spark, _sorted(left.unionByName(gaps)).select(*plain).mapInArrow(_swept, _ROW), "swept")
        free = (F.col("kind") == GAP) & (F.col("rank") >= 0)
        counts = swept.where(free | (F.col("kind") == PIECE)).groupBy("part").agg(
            F.count(of(PIECE, "id")).alias("pieces"), F.max(of(PIECE, "size")).alias("longest"), F.count(of(GAP, "id")).alias("gaps"), F.min(of(GAP, "size")).alias("smallest")
        )  # one row a partition
        table = by_rank(sorted((r["part"], r["pieces"], r["longest"], r["gaps"], r["smallest"]) for r in counts.collect()))
        met = R.table(spark, _crossed(spark, swept, free, table), "crossed")
        done += [swept.where(F.col("kind") == PLACED).select("id", "seq", "used"), met.select("id", "seq", "used")]
        taken = met.groupBy("seq").agg(F.sum("size").alias("taken"))
        kept = swept.where(F.col("kind") == GAP).join(taken.withColumnRenamed("seq", "id"), "id", "left")
        kept = kept.select("kind", "id", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size"), (F.col("used") + F.coalesce("taken", F.lit(0))).alias("used"))
        rest = swept.where(F.col("kind") == PIECE).join(met.select("id"), "id", "left_anti").select(*plain)
        state = R.table(spark, kept.where("size > 0").unionByName(rest), "state")
    none = spark.createDataFrame([], "id long, seq long, used long")
    return reduce(DataFrame.unionByName, done, none)


def _crossed(spark: SparkSession, swept: DataFrame, free, table: list[tuple]) -> DataFrame:
    """(id, size, seq, used) of leftover pieces that take gaps of other partitions."""
    spans = spark.createDataFrame(table, "part int, first long, n long, gap_part int, top long, each long")
    pieces = swept.where(F.col("kind") == PIECE).select("part", "rank", "id", "size")
    # Partitions bound the table of spans: fewer than two rows for each.
    pieces = pieces.join(F.broadcast(spans), "part").where("rank >= first and rank < first + n")
    pieces = pieces.select("id", "size", "rank", "gap_part", F.expr("top - (rank - first) div each").alias("gap_rank"))
    gaps = swept.where(free).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("id").alias("seq"), F.col("used").alias("full"))
    met = pieces.join(gaps, ["gap_part", "gap_rank"])
    before = F.sum("size").over(W.partitionBy("seq").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))  # `most` rows at most
    return met.select("id", "size", "seq", (F.col("full") + F.coalesce(before, F.lit(0))).alias("used"))


def cuts(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % most or most
    return [(0, head)] + [(s, most) for s in range(head, n, most)]


def _cut(path: str, kind: str, most: int, end: int, ids: bool):
    @R.trimmed
    def run(batches):
        enc = encoder(path, kind)
        for batch in batches:
            data, offs = T.text_bytes(batch.column(1))
            for i, j in T.slices(offs, 1 << 19):
                got, first = with_ends(*enc.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), end)
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for r in range(j - i):
                    own = got[first[r] : first[r + 1]].astype("<u4").tobytes()
                    for k, (s, n) in enumerate(cuts(len(own) // 4, most)):
                        part = own[4 * s : 4 * (s + n)]
                        row.append(i + r), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part))
                        if ids:
                            held.append(part)
                cols = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([*cols, pa.array(held, pa.binary())] if ids else cols, names=names + ["ids"] * ids)

    return run


def pieces(spark: SparkSession, docs: DataFrame, path: str, kind: str = "byte", most: int = MOST, end: int = END, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document, and its ids as bytes if asked for."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return rows.mapInArrow(_cut(path, kind, most, end, ids), schema)


def pack(spark: SparkSession, cut: DataFrame, most: int = MOST) -> DataFrame:
    """cut (rows with a `length` of 1 to `most`) with sequence_id and offset."""
    held = R.table(spark, cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    places = place(spark, held.select(F.col("__row").alias("id"), F.col("length").alias("size")), most)
    places = places.select(F.col("id").alias("__row"), F.col("seq").alias("sequence_id"), F.col("used").alias("offset"))
    return held.join(places, "__row").select(*cut.columns, "sequence_id", "offset")


def packed_documents(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    cut = pieces(spark, docs, path or public_tokenizers.path("byte_bpe_50k.json"))
    return pack(spark, cut).withColumnRenamed("id", "doc_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    return packed_documents(spark, R.load(spark, sf_dir, "documents"))
