"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has its own piece probabilities, learned by expectation
maximisation. The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm;
a text's is the product over its words (runs of letters, lower-cased, of any length). The language whose product is largest, each language being as likely as the next beforehand, is predicted; its
posterior is the score. Ties go to the language first in code-point order.

Learning takes about `per_language` documents of each language, chosen by the hashes of their ids, and of these the words
of at most `LEARNED` letters; the model has
pieces times languages numbers whatever the input. Prediction reads every whole text once and shuffles nothing.

Defined results: null texts and texts without a letter are `und` with score 0; without a language to learn from, so is
every text; rows with a null language are never learned from. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T

#: Documents of each language to learn from, letters of the longest words to learn from, rounds of expectation maximisation.
PER_LANGUAGE, LEARNED, ROUNDS = 1500, 32, 3
#: Letters from which on a run is summed by itself, place by place; a matter of speed and memory alone.
LONG = 48
#: Probability of a single character that is no piece, and the pseudo-count of pieces.
UNKNOWN, PSEUDO = 1e-8, 0.02
#: Distinct runs whose probabilities a worker keeps; a matter of speed alone.
KEPT = 600_000
#: Distinct words whose tables the driver holds at once while it learns.
FITTED = 20_000
START = 0x2581  # ▁, which stands before a word in the vocabulary
_SIZE = 1 << 20

_tables: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def _codes(codes: np.ndarray) -> np.ndarray:
    return T.mix(codes.astype(np.uint64) + np.uint64(12345))


def pieces(path: str) -> list[str]:
    """Lower-cased letter pieces of a SentencePiece model, with or without the word mark, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        if p.lstrip("▁").isalpha() and p.count("▁") <= 1 or p == "▁":
            out.setdefault(p, None)
    return list(out)


class Vocabulary:
    """Place of a piece by its hash: two tables of 2**20 slots, tried one after the other."""

    def __init__(self, found: list[str]):
        data = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in found])
        h = T.hashes_of(T.prefix_sums(_codes(data)), np.concatenate([[0], ends[:-1]]), ends)
        self.n, self.longest = len(found), max(map(len, found), default=1)
        self.hash = np.concatenate([h, [np.uint64(0)]])
        self.slots = np.full((2, _SIZE), self.n, np.int32)
        rest = np.arange(self.n)
        for t in range(2):
            at = self._slot(h[rest], t)
            _, one = np.unique(at, return_index=True)
            self.slots[t, at[one]] = rest[one]
            rest = np.delete(rest, one)
        self.rest = {int(h[i]): int(i) for i in rest}  # hardly ever any

    @staticmethod
    def _slot(h: np.ndarray, t: int) -> np.ndarray:
        return ((h >> np.uint64(20 * t)) & np.uint64(_SIZE - 1)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, n for none."""
        out = self.slots[0, self._slot(h, 0)]
        miss = np.flatnonzero(self.hash[out] != h)
        hm = h[miss]
        second = self.slots[1, self._slot(hm, 1)]
        out[miss] = np.where(self.hash[second] == hm, second, self.n)
        for key, i in self.rest.items():
            out[h == np.uint64(key)] = i
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _tables:
        _tables[path] = Vocabulary(pieces(path))
    return _tables[path]


def runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs of lower-cased texts, each with the word mark before it: characters, starts, ends, row of a run."""
    low = [(t or "").lower() for t in texts]
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    s, e, first = T.runs(_letters()[data], offs)
    return data, s, e, np.repeat(np.arange(len(texts)), np.diff(first))


def marked(data, s, e):
    """Characters of runs with the word mark before each, starts, ends."""
    size = e - s + 1
    ends = np.cumsum(size)
    starts = ends - size
    out = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint32)
    at = np.arange(len(out)) - np.repeat(starts, size)
    keep = at > 0
    out[keep] = data[(np.repeat(s, size) + at - 1)[keep]]
    return out, starts, ends


class Lattice:
    """All segmentations of distinct runs: for each end and piece length, the piece that ends there."""

    def __init__(self, vocab: Vocabulary, data, starts, ends):
        self.order = np.argsort(starts - ends, kind="stable")  # longest first
        self.s, self.n = starts[self.order], (ends - starts)[self.order]
        self.count, self.longest, self.none = len(starts), int(self.n.max(initial=0)), vocab.n
        total = T.prefix_sums(_codes(data))
        self.arcs = []
        for j in range(1, self.longest + 1):
            m = int(np.searchsorted(-self.n, -j, "right"))
            row = []
            for k in range(1, min(j, vocab.longest) + 1):
                a = self.s[:m] + j - k
                p = vocab.places(T.hashes_of(total, a, a + k))
                if k == 1:
                    p = np.where(p == self.none, self.none + 1, p)  # the unknown character
                row.append(p)
            self.arcs.append((m, row))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        a = np.zeros((self.longest + 1, self.count, prob.shape[1]))
        a[0] = 1
        for j, (m, row) in enumerate(self.arcs, 1):
            for k, p in enumerate(row, 1):
                hit = np.flatnonzero(p != self.none)
                if len(hit):
                    a[j, hit] += a[j - k, hit] * prob[p[hit]]
        return a

    def logs(self, prob: np.ndarray) -> np.ndarray:
        """Log-probability of each distinct run in each language, in the order in which the runs were given."""
        a = self.forward(prob)
        out = np.empty((self.count, prob.shape[1]))
        out[self.order] = np.log(a[self.n, np.arange(self.count)] + 1e-300)
        return out

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, runs weighted by language."""
        a = self.forward(prob)
        z = a[self.n, np.arange(self.count)] + 1e-300
        w = weight[self.order] / z
        b = np.zeros_like(a)
        b[self.n, np.arange(self.count)] = 1
        out = np.zeros((self.none + 2, prob.shape[1]))
        for j in range(self.longest, 0, -1):
            m, row = self.arcs[j - 1]
            for k, p in enumerate(row, 1):
                hit = np.flatnonzero(p != self.none)
                if len(hit):
                    q = prob[p[hit]]
                    flow = a[j - k, hit] * q * b[j, hit] * w[hit]
                    for lang in range(q.shape[1]):
                        out[:, lang] += np.bincount(p[hit], flow[:, lang], len(out))
                    b[j - k, hit] += q * b[j, hit]
        return out


def long_log(vocab: Vocabulary, prob: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Log-probability of one run, its word mark included, in each language; sums are scaled as they go, so that none is lost."""
    reach, scale = vocab.longest, np.zeros(prob.shape[1])
    window = np.zeros((reach, prob.shape[1]))  # sums of the places before, the nearest first
    window[0] = 1
    total = T.prefix_sums(_codes(data))
    length = np.arange(1, reach + 1)
    for lo in range(0, len(data), 4096):
        end = np.arange(lo + 1, min(lo + 4096, len(data)) + 1)[:, None]
        start = end - length
        piece = vocab.places(T.hashes_of(total, np.maximum(start, 0).ravel(), np.broadcast_to(end, start.shape).ravel())).reshape(start.shape)
        piece = np.where(start < 0, vocab.n, piece)
        piece[:, 0] = np.where(piece[:, 0] == vocab.n, vocab.n + 1, piece[:, 0])
        for k, chance in enumerate(prob[piece]):
            here = (window * chance).sum(axis=0)
            window[1:] = window[:-1]
            window[0] = here
            if k % 16 == 15:
                top = window.max(axis=0)
                window /= top
                scale += np.log(top)
    return np.log(window[0] + 1e-300) + scale


@dataclass
class Model:
    path: str
    languages: list[str]
    prob: np.ndarray  # piece by language; then 0 for none and UNKNOWN

    def logs(self, data, s, e) -> np.ndarray:
        """Log-probabilities of runs. Those of the last KEPT distinct runs or so are kept, sorted by hash."""
        h = T.hashes_of(T.prefix_sums(_codes(data)), s, e)
        h, one, place = np.unique(h, return_index=True, return_inverse=True)
        keys, held = self.__dict__.get("_kept", (np.zeros(0, np.uint64), np.zeros((0, len(self.languages)), np.float64)))
        at = np.searchsorted(keys, h)
        new = np.flatnonzero(keys[np.minimum(at, max(0, len(keys) - 1))] != h) if len(keys) else np.arange(len(h))
        out = np.empty((len(h), len(self.languages)))
        old = np.ones(len(h), bool)
        old[new] = False
        out[old] = held[at[old]]
        if len(new):
            size = e[one[new]] - s[one[new]]
            far, new = new[size >= LONG], new[size < LONG]
            vocab = vocabulary(self.path)
            for i in far.tolist():
                out[i] = long_log(vocab, self.prob, np.concatenate([np.array([START], np.uint32), data[s[one[i]] : e[one[i]]]]))
            if len(new):
                out[new] = Lattice(vocab, *marked(data, s[one[new]], e[one[new]])).logs(self.prob)
            if len(keys) > KEPT:
                keys, held, at = keys[:0], held[:0], at * 0
            self._kept = np.insert(keys, at[new], h[new]), np.insert(held, at[new], out[new], axis=0)
        return out[place]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        data, s, e, row = runs(texts)
        if not self.languages or not len(s):
            return ["und"] * len(texts), np.zeros(len(texts))
        logs = self.logs(data, s, e)
        total = np.stack([np.bincount(row, logs[:, k], len(texts)) for k in range(logs.shape[1])], axis=1)
        some = np.bincount(row, minlength=len(texts)) > 0
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, some, strict=True)], np.where(some, share, 0.0)


def fit(words: dict[tuple[str, str], int], path: str, rounds: int = ROUNDS) -> Model:
    """Model from counts of (language, word)."""
    languages = sorted({lang for lang, _ in words})
    if not languages:
        return Model(path, [], np.zeros((0, 0)))
    at = {w: i for i, w in enumerate(sorted({w for _, w in words}))}
    weight = np.zeros((len(at), len(languages)))
    for (lang, w), n in words.items():
        weight[at[w], languages.index(lang)] += n
    vocab = vocabulary(path)
    # Words of like length together, FITTED at a time: the forward and backward tables of one part are held at once.
    order = sorted(at, key=len)
    parts = []
    for i in range(0, len(order), FITTED):
        few = order[i : i + FITTED]
        data = np.frombuffer("".join("▁" + w for w in few).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(w) + 1 for w in few])
        parts.append((Lattice(vocab, data, ends - [len(w) + 1 for w in few], ends), weight[[at[w] for w in few]]))
    prob = np.full((vocab.n + 2, len(languages)), 1 / vocab.n)
    for r in range(rounds + 1):
        if r:
            seen = sum(lattice.expected(prob, w) for lattice, w in parts)[: vocab.n] + PSEUDO
            prob[: vocab.n] = seen / seen.sum(axis=0)
        prob[vocab.n], prob[vocab.n + 1] = 0, UNKNOWN
    return Model(path, languages, prob)


def _counted(batches):
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, s, e, row = runs(texts)
        seen: dict[tuple[str, str], int] = {}
        few = e - s <= LEARNED
        for a, b, r in zip(s[few].tolist(), e[few].tolist(), row[few].tolist(), strict=True):
            key = langs[r], data[a:b].tobytes().decode("utf-32-le", "replace")
            seen[key] = seen.get(key, 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def learn(spark: SparkSession, docs: DataFrame, train: Column, path: str, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.groupBy("lang").count().collect()  # one row for each label
    if not counts:
        return fit({}, path)
    cut = spark.createDataFrame([(r["lang"], min(1_000_000, -(-per_language * 1_000_000 // r["count"]))) for r in counts], "lang string, cut long")
    sample = rows.join(F.broadcast(cut), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("cut")).select("lang", "text")
    words = sample.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return fit({(r["lang"], r["word"]): r["n"] for r in words.toArrow().to_pylist()}, path)


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(model)  # pieces times languages

    @R.trimmed
    def run(batches):
        for batch in batches:
            _, offs = T.text_bytes(batch.column(1))
            texts = batch.column(1).to_pylist()
            names, scores = [], [np.zeros(0)]
            for i, j in T.slices(offs, 3 << 20):
                n, s = shared.value.predict(texts[i:j])
                names += n
                scores.append(s)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op10_language_id(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    R.prepare(spark)
    docs = R.load(spark, sf_dir, "documents")
    held_out = R.id_hash() % 4 == 2
    model = learn(spark, docs, ~held_out, vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
    return predict(spark, docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
