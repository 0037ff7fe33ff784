"""Byte-pair encoding of whole columns by the tokenizers library, with the ids of recurring words kept.

A text is cut where the vocabulary's own pattern cuts, by array operations over the bytes of many texts at once; the
parts are told apart by 64-bit hashes, and the library's model encodes each part that a worker has not met before.
The array way knows ASCII and the letters of Latin-1; a text with any other character, or with the text of one of the
vocabulary's added tokens (which has an id of its own there), goes to the library whole. The ids are the same either way.
"""

from __future__ import annotations

import numpy as np

from gnomon.llm import _text as T

#: Slots for parts whose ids a worker keeps (a power of two; a part may be in two of them), and ids that it keeps before it
#: starts afresh. Both bound its memory (40 MB) and are a matter of speed alone.
KEPT, POOL = 1 << 20, 3 << 20
_rng = np.random.Generator(np.random.PCG64(99))
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTER, DIGIT, SIGN, WHITE, FOREIGN = 0, 1, 2, 3, 4
_CLASS = np.full(256, FOREIGN, np.uint8)
_CLASS[33:127] = SIGN
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[9:14] = _CLASS[32] = WHITE
_CLASS[[*range(9), *range(14, 32), 127]] = SIGN


def _printable() -> list[str]:
    """Character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """kind: "byte" for a byte-level vocabulary that keeps white space, "word" for one of lower-cased words."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.word, self.shown = self.library.model, kind == "word", _printable()
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(KEPT, np.uint64), np.zeros(KEPT, np.int32), np.zeros(KEPT, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _with_added(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows that contain the text of an added token."""
        held, rows = data.tobytes(), set()
        for token in self.added:
            at = held.find(token)
            while at >= 0:
                row = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(token) <= offs[row + 1]:
                    rows.add(row)
                    at = held.find(token, int(offs[row + 1]))
                else:
                    at = held.find(token, at + 1)
        return np.array(sorted(rows), np.int64)

    def _parts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts, and whether one is white space."""
        n = len(data)
        kind = _CLASS[data]
        kind[(data >= 128)] = LETTER
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        start |= edge
        apostrophe = np.flatnonzero((data == 39) & start[:n])
        if not self.word:
            # The last of a run of white space before something else: a space goes with what follows, another stands alone.
            last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
            start[last] = True
            start[last[data[last] == 32] + 1] = False
            apostrophe = apostrophe[start[apostrophe]]
        else:
            start[:n] |= kind == DIGIT
        if len(apostrophe):
            end = offs[np.searchsorted(offs, apostrophe, "right")]
            pad = np.concatenate([data, np.zeros(3, np.uint8)])
            one, two = pad[apostrophe + 1], pad[apostrophe + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (apostrophe + 1 < end)
            long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (apostrophe + 2 < end)
            for hit, size in ((apostrophe[short], 2), (apostrophe[long & ~short], 3)):
                start[hit + 1] = False
                start[hit + size] = True
        start[n] = True
        cut = np.flatnonzero(start)
        return cut[:-1], cut[1:], kind[cut[:-1]] == WHITE

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and each row's first id (one more than rows)."""
        rows = len(offs) - 1
        # Two-byte letters of Latin-1 are C3 80 to C3 BF but for two signs; all else beyond ASCII is foreign.
        lead = data == 0xC3
        bad = (data >= 128) & ~lead
        bad[1:] &= ~lead[:-1]
        bad[:-1] |= lead[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        foreign = np.unique(np.searchsorted(offs, np.flatnonzero(bad), "right") - 1) if bad.any() else np.zeros(0, np.int64)
        foreign = np.union1d(foreign, self._with_added(data, offs))
        size_of = np.zeros(rows, np.int64)
        whole: dict[int, np.ndarray] = {}
        for r in foreign.tolist():
            whole[r] = self.direct(data[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace"))
        text = data
        if self.word:
            text = data.copy()
            text[(data >= 65) & (data <= 90)] += 32
            text[1:][lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
        starts, ends, white = self._parts(text, offs)
        row = np.searchsorted(offs, starts, "right") - 1
        use = ~white if self.word else np.ones(len(starts), bool)
        if len(foreign):
            use &= ~np.isin(row, foreign)
        starts, ends, row = starts[use], ends[use], row[use]
        if self.used > POOL:
            self.forget()
        at, size = self._known(text, starts, ends)
        # Where each part's ids go: rows in order, foreign rows in their places.
        size_of = np.bincount(row, size, rows).astype(np.int64)
        for r, ids in whole.items():
            size_of[r] = len(ids)
        first = np.concatenate([[0], np.cumsum(size_of)])
        out = np.empty(int(first[-1]), np.uint32)
        total = int(size.sum())
        source = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)
        if whole:
            keep = np.ones(len(out), bool)
            for r, ids in whole.items():
                out[first[r] : first[r + 1]] = ids
                keep[first[r] : first[r + 1]] = False
            out[keep] = self.pool[source]
        else:
            out = self.pool[source]
        return out, first

    def _known(self, text, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each part are, and how many."""
        h = T.hashes_of(T.prefix_sums(_EXACT[text]), starts, ends)
        mask, high = np.uint64(KEPT - 1), np.uint64(32)
        slot = (h & mask).view(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        slot[miss] = ((h[miss] >> high) & mask).view(np.int64)
        miss = miss[self.keys[slot[miss]] != h[miss]]
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if len(miss):
            new, one, place = np.unique(h[miss], return_index=True, return_inverse=True)
            where, got = self._asked(text, starts[miss[one]].tolist(), ends[miss[one]].tolist())
            need = self.used + len(got)
            if need > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(need - len(self.pool) + (1 << 18), np.uint32)])
            self.pool[self.used : need] = got
            own, n = where[:-1] + self.used, np.diff(where)
            self.used = need
            at[miss], size[miss] = own[place], n[place]
            # A part goes to the first of its slots if that is free, else to the second, where it may take another's place.
            first = (new & mask).view(np.int64)
            goes = np.where(self.keys[first] == 0, first, ((new >> high) & mask).view(np.int64))
            _, last = np.unique(goes, return_index=True)
            goes = goes[last]
            self.keys[goes], self.at[goes], self.size[goes] = new[last], own[last], n[last]
        return at, size

    def _asked(self, text, starts: list[int], ends: list[int]) -> tuple[np.ndarray, list[int]]:
        """Ids of parts from the library's model, and where each part's begin."""
        held, where, tokenize, shown = text.tobytes().decode("latin-1"), [0], self.model.tokenize, self.shown
        got: list[int] = []
        for a, b in zip(starts, ends, strict=True):
            part = held[a:b]
            if not (part.isascii() and part.isprintable()) or " " in part:  # else each character stands for itself
                part = "".join([shown[ord(c)] for c in part])
            got += [t.id for t in tokenize(part)]
            where.append(len(got))
        return np.array(where, np.int64), got


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def with_ends(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with `end` after each row, and each row's first id."""
    return np.insert(ids, first[1:], end).astype(np.uint32), first + np.arange(len(first))
