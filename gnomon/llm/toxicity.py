"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (runs of letters, A-Z lower-cased) and their first four and five bytes, hashed into
2**20 slots. The slots that tell toxic from clean texts best in the training sample become features; the machine
learns a weight for each and a vector for each, whose inner products weigh pairs of terms that occur together.

Training takes a bounded sample of labelled rows: at most `per_class` of each class, those with the smallest hashes of
their ids; the intercept is then moved to the share of toxic rows among all training labels. The model has at most
`features` rows whatever the input. Scoring reads every whole text once and shuffles nothing.

Defined results: null and empty texts get the score of a text without terms; rows with a null id count as held out;
labels other than 0 and 1 don't count, and an id labelled both ways counts as toxic; rows that repeat an id are learned
from once, by the terms of smallest hash; without both labels to learn from every score is 0. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T

#: Hashed slots, features, factors, and labelled rows of each class in the training sample.
SLOTS, FEATURES, FACTORS, PER_CLASS = 1 << 20, 4096, 4, 4000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every term of every row."""
    starts, ends, first = T.runs(LETTER[data], offs)
    total = T.prefix_sums(T.BYTE[data])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    slots = [T.hashes_of(total, starts, ends)]
    slots += [T.mix(T.hashes_of(total, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in (4, 5)]
    return np.tile(row, 3), (np.concatenate(slots) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Machine:
    places: np.ndarray  # of a slot's feature, -1 for none
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.weights[feature], rows)
        v = self.factors[feature]
        for f in range(v.shape[1]):
            out += 0.5 * (np.bincount(row, v[:, f], rows) ** 2 - np.bincount(row, v[:, f] ** 2, rows))
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        row, slot = terms(data, offs)
        feature = self.places[slot]
        hit = np.flatnonzero(feature >= 0)
        pair = np.unique(row[hit] * len(self.weights) + feature[hit])
        m = self.margins(pair // len(self.weights), pair % len(self.weights), rows)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(labels: np.ndarray, slots: list[np.ndarray], prior: float, features: int = FEATURES, k: int = FACTORS, epochs: int = 30, seed: int = 5) -> Machine:
    """Machine from rows' labels (0, 1) and distinct slots; prior: the share of label 1 among all training labels."""
    rng = np.random.default_rng(seed)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slot = np.concatenate(slots).astype(np.int64) if slots else np.zeros(0, np.int64)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    of = labels[row] == 1
    pos, neg = np.bincount(slot[of], minlength=SLOTS), np.bincount(slot[~of], minlength=SLOTS)
    odds = np.log((pos + 0.5) / (n[1] - pos + 0.5)) - np.log((neg + 0.5) / (n[0] - neg + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    z[pos + neg < 5] = 0
    best = np.argsort(-z, kind="stable")[:features]
    best = best[z[best] > 2.5]
    places = np.full(SLOTS, -1, np.int32)
    places[best] = np.arange(len(best))
    m = Machine(places, 0.0, np.zeros(max(1, len(best))), rng.normal(0, 0.02, (max(1, len(best)), k)))
    hit = np.flatnonzero(places[slot] >= 0)
    row, feature = row[hit], places[slot[hit]].astype(np.int64)
    at = np.searchsorted(row, np.arange(len(slots) + 1))
    grow = [np.zeros_like(x) for x in (m.weights, m.weights, m.factors, m.factors)]
    step, rate, decay = 0, 0.03, 2e-4
    for _ in range(epochs):
        order = rng.permutation(len(slots))
        for b in range(0, len(order), 256):
            pick = np.sort(order[b : b + 256])
            count = at[pick + 1] - at[pick]
            r = np.repeat(np.arange(len(pick)), count)
            x = feature[np.repeat(at[pick] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            p = 1 / (1 + np.exp(-np.clip(m.margins(r, x, len(pick)), -30, 30)))
            g = (p - labels[pick]) / len(pick)
            v = m.factors[x]
            sums = np.stack([np.bincount(r, v[:, f], len(pick)) for f in range(k)], axis=1)
            dw = np.bincount(x, g[r], len(m.weights)) + decay * m.weights
            dv = np.stack([np.bincount(x, g[r] * (sums[r, f] - v[:, f]), len(m.weights)) for f in range(k)], axis=1) + decay * m.factors
            step += 1
            for value, d, (u, s) in ((m.weights, dw, grow[:2]), (m.factors, dv, grow[2:])):
                u *= 0.9
                u += 0.1 * d
                s *= 0.999
                s += 0.001 * d * d
                value -= rate * (u / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            m.bias -= rate * 2 * g.sum()
    share = min(max(n[1] / max(1, n.sum()), 1e-6), 1 - 1e-6)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    m.bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return m


def _sampled(batches):
    for batch in batches:
        data, offs = T.text_bytes(batch.column(1))
        for i, j in T.slices(offs):
            row, slot = terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            pair = np.unique(row * SLOTS + slot)
            cuts = np.searchsorted(pair, np.arange(j - i + 1) * SLOTS).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pair % SLOTS).astype(np.int32)))
            yield pa.record_batch([batch.column(0).slice(i, j - i), slots, batch.column(2).slice(i, j - i)], names=["label", "slots", "id"])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine | None:
    """Machine from labelled documents for which `train` (a condition on the id column) holds."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train)
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    count = {r["__label"]: r["count"] for r in marked.groupBy("__label").count().collect()}
    if len(count) < 2:
        return None
    near = [marked.where(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    sample = near[0].unionByName(near[1])  # at most 2 * per_class rows
    ids = docs.select(F.col(id_col).alias("__own"), F.col(text_col).cast("string").alias("text"))
    texts = ids.join(F.broadcast(sample), F.col("__own") == F.col("__id")).select("__label", "text", "__id")
    kind = dict(texts.dtypes)["__id"]
    slots = texts.mapInArrow(_sampled, f"label int, slots array<int>, id {kind}")
    once = slots.groupBy("id", "label").agg(F.expr("min_by(slots, xxhash64(slots))").alias("slots")).select("label", "slots")
    held = once.toArrow().combine_chunks()
    label = held.column("label").to_numpy().astype(np.int64)
    slots = [np.asarray(x.values) for x in held.column("slots").combine_chunks()] if held.num_rows else []
    order = sorted(range(len(slots)), key=lambda i: (label[i], len(slots[i]), slots[i].tobytes()))  # however rows arrive
    made = fit(label[order], [slots[i] for i in order], count[1] / (count[0] + count[1]))
    del held, label, slots
    R.trim()
    return made


def score(spark: SparkSession, docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(machine)  # SLOTS and features bound its size

    @R.trimmed
    def run(batches):
        for batch in batches:
            data, offs = T.text_bytes(batch.column(1))
            out = [np.zeros(0)]
            for i, j in T.slices(offs):
                m = shared.value
                out.append(m.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) if m else np.zeros(j - i))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out))], names=["id", "score"])

    return ids.mapInArrow(run, f"id {dict(ids.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    machine = learn(spark, docs, labels, F.lit(True))
    shared = spark.sparkContext.broadcast(machine)
    names, at = docs.columns, docs.columns.index("text")

    @R.trimmed
    def run(batches):
        for batch in batches:
            data, offs = T.text_bytes(batch.column(at))
            keep = [np.zeros(0, bool)]
            for i, j in T.slices(offs):
                m = shared.value
                keep.append(m.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) < threshold if m else np.ones(j - i, bool))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema).select(*names)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    docs, labels = R.load(spark, sf_dir, "documents"), R.load(spark, sf_dir, "labels")
    machine = learn(spark, docs, labels, R.id_hash() % 5 != 0)
    out = score(spark, docs, machine)
    return out.select("doc_id", (R.id_hash() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
