"""Language-model scores by stupid backoff, computed relationally.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. The score of a word after its history is count(history, word) /
count(history) if the n-gram occurs at least `least` times, else `alpha` times its score after the history without its
first word; the unigram score is count(word) / words. A document's score is the mean of the logarithms.

Relations: words are cut into slices of a bounded number of words. Each slice's n-grams are counted, and travel to count
tables that are partitioned by ranges of the 64-bit hash, where the counts of all slices are added. The join back needs
no keys: a slice gets, from each range, the corpus counts of its n-grams in the order of their hashes, makes its own list
of n-grams again and so has a count for each. A history's count is that of the n-gram that ends one word before. Rows of
both relations hold packed arrays, so what moves is a slice's different hashes, as the steps between them, and counts.

A common n-gram is in a slice's row once at most; a long text is cut between words, each part with the few words before
it. The number of ranges follows the number of words, so no task's memory grows with the input.

Defined results: a null or empty text, or one of white space, has no words and a null mean; rows with a null id or that
repeat an id are scored together as one document; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T

#: Longest n-grams, factor of a step back, and the least count of an n-gram that is used.
ORDER, ALPHA, LEAST = 2, 0.4, 2
#: Words and rows of a slice; n-grams, counted once a slice, that a range of hashes holds on average.
SLICE, SLICE_ROWS, RANGE = 1 << 20, 1 << 16, 1 << 20
_U32 = np.uint64(32)


def _packed(values: np.ndarray, size: int = 8) -> bytes:
    """Unsigned integers of `size` bytes, byte planes apart: high bytes are nearly all zero."""
    return zlib.compress(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def _unpacked(held: bytes, size: int = 8) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(held), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending 64-bit hashes: the first, a byte with the size of a step, and the steps in so many bytes."""
    d = np.diff(keys).astype("<u8")
    size = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([size]) + d.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unstepped(held: bytes) -> np.ndarray:
    size = held[8]
    d = np.frombuffer(held, np.uint8, offset=9).reshape(-1, size)
    wide = np.zeros((len(d) + 1, 8), np.uint8)
    wide[0], wide[1:, :size] = np.frombuffer(held, np.uint8, 8), d
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _sliced(order: int, id_type: pa.DataType, most: int):
    """Rows of (slice, ids, lengths, context, vocabulary, words): word numbers of all parts, one part an id. The first
    `context` words of a part belong to the part before."""

    @R.trimmed
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        hashes: list[np.ndarray] = []
        ids: list[pa.Array] = []
        lengths: list[int] = []
        context: list[int] = []
        waiting = 0

        def flush():
            nonlocal number, hashes, ids, lengths, context, waiting
            vocabulary, words, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True, return_counts=True)
            common = np.argsort(-times, kind="stable")  # common words get small numbers, which pack well
            place = np.empty(len(common), np.uint32)
            place[common] = np.arange(len(common), dtype=np.uint32)
            row = {
                "slice": pa.array([number], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "context": pa.array([context], pa.list_(pa.int64())),
                "vocabulary": pa.array([vocabulary[common].tobytes()], pa.binary()),
                "words": pa.array([_packed(place[words], 4)], pa.binary()),
            }
            number, hashes, ids, lengths, context, waiting = number + 1, [], [], [], [], 0
            return pa.record_batch(list(row.values()), names=list(row))

        for batch in batches:
            data, offs = T.text_bytes(batch.column(1))
            own = batch.column(0).cast(id_type)
            for i, j in T.slices(offs):
                _, _, h, first = T.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                # Parts of this stretch of rows, none longer than a slice.
                for r in range(i, j):
                    a, b = int(first[r - i]), int(first[r - i + 1])
                    for lo in range(a, max(b, a + 1), most):
                        before = min(order - 1, lo - a)
                        hi = min(b, lo + most)
                        if lengths and (waiting + hi - lo > most or len(lengths) >= SLICE_ROWS):
                            yield flush()
                        hashes.append(h[lo - before : hi].copy())
                        ids.append(own.slice(r, 1))
                        lengths.append(hi - lo + before)
                        context.append(before)
                        waiting += hi - lo
        if lengths:
            yield flush()

    return run


class _Grams:
    """The n-grams of a slice, of each length: hashes in ascending order, and which of them ends at each word."""

    def __init__(self, order: int, lengths: list, context: list, vocabulary: bytes, words: bytes):
        vocab = np.frombuffer(vocabulary, np.uint64)
        at = _unpacked(words, 4)
        size, skip = np.array(lengths, np.int64), np.array(context, np.int64)
        part = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)  # number of the word in its part
        self.part, self.counted, self.room = part, place >= skip[part], place + 1
        word = T.mix(vocab)[at]
        self.keys, self.which, key = [], [], word
        for n in range(1, order + 1):
            if n > 1:  # the n-gram one word shorter that ended before, and the word
                moved = np.empty_like(key)
                moved[:1], moved[1:] = 0, key[:-1]
                key = T.mix(moved * T.BASE + word)
            full = self.room >= n
            found, inverse = np.unique(key[full], return_inverse=True)
            which = np.full(len(at), -1, np.int32)
            which[full] = inverse
            self.keys.append(found), self.which.append(which)

    def times(self, n: int) -> np.ndarray:
        """How often each n-gram occurs; those that end in another part's words are counted there."""
        use = self.which[n - 1][self.counted]
        return np.bincount(use[use >= 0], minlength=len(self.keys[n - 1]))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> _U32) * np.uint64(ranges) >> _U32).astype(np.int64)


def _counted(order: int, ranges: int):
    """Rows of (range, slice, n, keys, times) of each slice."""

    @R.trimmed
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                number, *rest = (batch.column(c)[k].as_py() for c in ("slice", "lengths", "context", "vocabulary", "words"))
                grams = _Grams(order, *rest)
                for n in range(1, order + 1):
                    keys, times = grams.keys[n - 1], grams.times(n)
                    if not len(keys):
                        continue
                    own, first = np.unique(_range_of(keys, ranges), return_index=True)
                    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
                    cols = [pa.array(own, pa.int32()), pa.array(np.full(len(own), number), pa.int64()), pa.array(np.full(len(own), n), pa.int32())]
                    cols += [pa.array([_steps(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_packed(times[a:b]) for a, b in spans], pa.binary())]
                    yield pa.record_batch(cols, names=["range", "slice", "n", "keys", "times"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Of a range: counts of all slices added, and for each slice those of its own n-grams."""
    made = [b""] * table.num_rows
    lengths = np.asarray(table["n"])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        keys = [_unstepped(table["keys"][int(r)].as_py()) for r in rows]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.uint64)
        np.add.at(total, inverse, np.concatenate([_unpacked(table["times"][int(r)].as_py()) for r in rows]))
        at = 0
        for r, k in zip(rows, keys, strict=True):
            made[r] = _packed(total[inverse[at : at + len(k)]])
            at += len(k)
    return pa.table({"slice": table["slice"], "n": table["n"], "range": table["range"], "counts": pa.array(made, pa.binary())})


def _scored(order: int, alpha: float, least: int, total: int, id_type: pa.DataType):
    def run(words: pa.Table, counts: pa.Table) -> pa.Table:
        row = {c: words[c][0].as_py() for c in ("lengths", "context", "vocabulary", "words")}
        grams = _Grams(order, **row)
        level, place, held = np.asarray(counts["n"]), np.asarray(counts["range"]), counts["counts"]
        count = []
        for n in range(1, order + 1):
            rows = np.flatnonzero(level == n)
            rows = rows[np.argsort(place[rows])]
            own = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(held[int(r)].as_py()) for r in rows)]).astype(np.float64)
            at = grams.which[n - 1]
            count.append(np.where(at >= 0, own[at], 0.0) if len(own) else np.zeros(len(at)))
        log = np.log(count[0]) - math.log(total) if len(count[0]) else count[0]
        for n in range(2, order + 1):
            history = np.ones(len(log))
            history[1:] = np.maximum(count[n - 2][:-1], 1)
            here = count[n - 1]
            met = np.log(np.maximum(here, 1)) - np.log(history)
            log = np.where(here >= least, met, np.where(grams.room >= n, log + math.log(alpha), log))
        use, parts = grams.counted, len(row["lengths"])
        n_words = np.bincount(grams.part[use], minlength=parts)
        sums = np.bincount(grams.part[use], weights=log[use], minlength=parts)
        ids = words["ids"].combine_chunks().flatten().cast(id_type)
        return pa.table({"id": ids, "n": pa.array(n_words, pa.int64()), "l": pa.array(sums, pa.float64())})

    return run


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", slice_words: int = SLICE) -> DataFrame:
    """(id, n_words, log_score: the mean natural logarithm of the words' scores)."""
    R.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    id_type = R.arrow_type(rows, "id")
    held = f"slice long, ids array<{kind}>, lengths array<long>, context array<long>, vocabulary binary, words binary"
    words = R.table(spark, rows.mapInArrow(_sliced(order, id_type, slice_words), held), "words")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    total = words.agg(F.coalesce(F.sum(add("lengths") - add("context")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * order // RANGE))
    sent = words.drop("ids").mapInArrow(_counted(order, ranges), "range int, slice long, n int, keys binary, times binary")
    counts = sent.groupBy("range").applyInArrow(_added, "slice long, n int, range int, counts binary")
    run = _scored(order, alpha, least, total, id_type)
    parts = words.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(run, f"id {kind}, n long, l double")
    sums = parts.groupBy("id").agg(F.sum("n").alias("n_words"), F.sum("l").alias("l"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("l") / F.col("n_words"), 6))
    return sums.select(F.col("id").alias(id_col), "n_words", mean.alias("log_score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    return score(spark, R.load(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS history FROM p),
c1 AS (SELECT word, count(*) AS c FROM t GROUP BY word),
c2 AS (SELECT history, word, count(*) AS c FROM t WHERE history IS NOT NULL GROUP BY history, word),
n AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.doc_id, CASE WHEN c2.c >= 2 THEN c2.c / h.c WHEN t.history IS NULL THEN u.c / n.n ELSE 0.4::DOUBLE * (u.c / n.n) END AS p
  FROM t CROSS JOIN n JOIN c1 u ON u.word = t.word LEFT JOIN c1 h ON h.word = t.history
  LEFT JOIN c2 ON c2.history = t.history AND c2.word = t.word)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(x.l / len(d.w), 6) AS log_score
FROM d LEFT JOIN (SELECT doc_id, sum(ln(p)) AS l FROM s GROUP BY doc_id) x USING (doc_id)
"""
