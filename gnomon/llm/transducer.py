"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled once from a byte-pair model: a normaliser (the word mark for spaces, a mark in front), an arc for every piece,
and byte arcs for characters without a piece. A path through the composition of a text with these is a sequence of
pieces; an arc costs nothing where it may follow the piece before it and is infinitely dear elsewhere: two pieces may
follow each other if the model, given just their two strings, yields these two again. Such a path, and only it, is the
model's own segmentation, so the shortest path in the tropical semiring gives exactly the library's ids. The state after
each character is the one piece that a finite path can end in there, so the search is linear in the text. Decoding is
the inverse transducer: pieces to strings, byte arcs to bytes, word marks to spaces.

No piece has a word mark after another character, or a line break; so text is composed chunk by chunk, cut before word
marks and around other characters that are in no longer piece, and a worker keeps the ids of chunks met before.

Defined results: null and empty texts have no ids and decode to the empty text; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T
from gnomon.llm.language import Vocabulary, _codes

#: Chunks kept by a worker; a matter of speed alone.
KEPT = 1_200_000
MARK = "▁"


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = {i: bytes((b,)) for b, i in enumerate(self.byte)}
        self.shown = [raw.get(i) or p.encode() for i, p in enumerate(self.pieces)]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark after another character")
        inner = "".join(regex.escape(c) for c in sorted({c for p in self.id if len(p) > 1 for c in p} - {MARK}))
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]").findall
        # Arcs: the pieces that the model yields for their own strings. The place of an arc is that in this list.
        self.arcs = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        self.longest = max(map(len, self.arcs))
        self.table = Vocabulary(self.arcs)
        self.none = len(self.arcs)  # also stands for a character without a piece
        self.arc_id = np.array([self.id[p] for p in self.arcs] + [0])
        self.arc_len = np.array([len(p) for p in self.arcs] + [1])
        self.pairs, self.allowed = np.zeros(0, np.int64), np.zeros(0, bool)
        self.kept: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's segmentation of a short text by its definition: best pair first, the left one of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether arc b may follow arc a (-1: nothing before). A character without a piece may stand anywhere."""
        out = (a < 0) | (a == self.none) | (b == self.none)
        ask = np.flatnonzero(~out)
        if len(ask):
            key = a[ask].astype(np.int64) << 32 | b[ask]
            at = np.searchsorted(self.pairs, key)
            new = np.unique(key[self.pairs[np.minimum(at, len(self.pairs) - 1)] != key]) if len(self.pairs) else np.unique(key)
            if len(new):
                arcs = self.arcs
                ok = [self.merged(arcs[k >> 32] + arcs[k & 0xFFFFFFFF]) == [arcs[k >> 32], arcs[k & 0xFFFFFFFF]] for k in new.tolist()]
                where = np.searchsorted(self.pairs, new)
                self.pairs, self.allowed = np.insert(self.pairs, where, new), np.insert(self.allowed, where, ok)
                at = np.searchsorted(self.pairs, key)
            out[ask] = self.allowed[at]
        return out

    def compose(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk (little-endian unsigned 32-bit), by the shortest paths of all chunks side by side."""
        size = np.array([len(c) for c in chunks])
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        s, n = (np.cumsum(size) - size)[order], size[order]
        total = T.prefix_sums(_codes(data))
        last = np.full((int(n[0]) + 1, len(n)), -2, np.int64)  # -2: no finite path ends here
        last[0] = -1
        for j in range(1, int(n[0]) + 1):
            open_ = np.arange(int(np.searchsorted(-n, -j, "right")))
            for k in range(min(j, self.longest), 0, -1):
                before = last[j - k, open_]
                a = s[open_] + j - k
                arc = self.table.places(T.hashes_of(total, a, a + k))
                hit = (before != -2) & ((arc != self.none) | (k == 1))
                some = np.flatnonzero(hit)
                hit[some] = self.may_follow(before[some], arc[some])
                last[j, open_[hit]] = arc[hit]
                open_ = open_[~hit]
                if not len(open_):
                    break
        # Backwards along the paths, a piece of each chunk at a time.
        at, live, steps = n.copy(), np.arange(len(n)), []
        while len(live):
            arc = last[at[live], live]
            at[live] -= self.arc_len[arc]
            steps.append((live, arc, at[live]))
            live = live[at[live] > 0]
        row = np.concatenate([x[0] for x in steps[::-1]])
        arc = np.concatenate([x[1] for x in steps[::-1]])
        pos = np.concatenate([x[2] for x in steps[::-1]])
        by = np.argsort(row, kind="stable")
        row, arc, pos = row[by], arc[by], pos[by]
        ids = self.arc_id[arc].astype("<u4")
        cuts = np.searchsorted(row, np.arange(len(n) + 1)).tolist()
        odd = set(row[arc == self.none].tolist())
        out: list[bytes] = [b""] * len(chunks)
        for r, i in enumerate(order.tolist()):
            lo, hi = cuts[r], cuts[r + 1]
            if r in odd:
                made: list[int] = []
                for x in range(lo, hi):
                    if arc[x] == self.none:
                        made += [self.byte[b] for b in chunks[i][pos[x]].encode("utf-8", "replace")]
                    else:
                        made.append(int(ids[x]))
                out[i] = np.array(made, "<u4").tobytes()
            else:
                out[i] = ids[lo:hi].tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        kept, parts = self.kept, []
        if len(kept) > KEPT:
            kept.clear()
        for text in texts:
            parts.append(self.cut(MARK + text.replace(" ", MARK)) if text else [])
        new = list(set().union(*parts) - kept.keys())
        new.sort(key=len)
        while new:  # chunks of like length together, so that the grid of a step stays small
            few = [new.pop()]
            width = len(few[0])
            while new and (len(few) + 1) * width <= 2_000_000 and len(few) < 50_000:
                few.append(new.pop())
            kept.update(zip(few, self.compose(few), strict=True))
        get = kept.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def _encoded(path: str):
    @R.trimmed
    def run(batches):
        t = transducer(path)
        for batch in batches:
            ids = t.encode_all(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


def _digested(path: str):
    @R.trimmed
    def run(batches):
        t = transducer(path)
        for batch in batches:
            n, crc, same = [], [], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, t.encode_all(texts), strict=True):
                n.append(len(ids) // 4), crc.append(zlib.crc32(ids))
                same.append(t.decode(ids) == (text or "").replace(MARK, " "))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["id", "n", "crc", "same"])

    return run


def encode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids of the text's pieces as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path), f"id {dict(rows.dtypes)['id']}, ids binary").withColumnRenamed("id", id_col)


def decode(spark: SparkSession, rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""
    rows = rows.select(F.col(id_col).alias("id"), "ids")

    @R.trimmed
    def run(batches):
        t = transducer(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([t.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, and whether decoding gives the text again."""
    import public_tokenizers

    R.prepare(spark)
    rows = R.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    out = rows.mapInArrow(_digested(path), "id long, n long, crc long, same boolean")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_pieces"), F.col("crc").alias("ids_crc32"), F.col("same").alias("round_trip"))
