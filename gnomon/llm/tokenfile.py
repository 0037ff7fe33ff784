"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Orders two and one each predict the next id: the id last seen after the two ids before, and after the one before, each
with how sure it is. Whether a prediction holds is a binary event. What order two and order one say of it, by how sure
they are and whether they agree, is mixed in the logistic domain with weights that adapt. What neither predicts is coded by
order zero, the ids of the block with their adaptive frequencies; an id that is new to the block escapes and is coded in
full. The three make one interval of 65536ths, which a range coder narrows. Predictions, chances and weights are brought up
to date every `STEP` ids and frequencies at the places `_renewals` gives, so that encoder and decoder do the same work on
many ids at once; all blocks of a batch are coded in step, one lane each, by array operations. All arithmetic is on
whole numbers, integers or doubles below 2**53, and divisions are those whose floors double precision gives exactly, so
coder and decoder agree everywhere. `encode` and `decode` say what the bytes are, for readers without Spark; executors code
and read the same bytes id after id, by TokenCoder.java, and Python workers only make the ids.

File: Parquet rows (shard, record, first, doc_ids, lengths, payload), a record holding whole documents, `first` the ids
before it in its shard, shards and records in ascending order of ids. payload: blocks, each "GTB3", number of ids,
number of 16-bit words, crc32 of the ids as little-endian 32-bit integers and of the words (three such integers), words: the
coder's from the first on, and those of ids coded in full from the last back (of a wide block the low half, then the high).
A block whose checksum fails raises ValueError.

Defined results: a null or empty text is the end id alone; rows with a null id come first; rows that repeat an id keep
some order, the same when read; an empty table gives files without rows.
"""

from __future__ import annotations

import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm import _text as T
from gnomon.llm.bpe import encoder, with_ends

#: Ids of a block, and ids after which a record is closed.
BLOCK, RECORD = 4096, 1 << 14
#: Ids between updates of predictions; slots of the order-one and order-two tables (2**10) and of order zero's index (2**12),
#: the most ids that order zero holds, and the total of its frequencies (2**12).
STEP, _SLOT_BITS, _INDEX_BITS, _MOST, _TOTAL_BITS = 64, 10, 12, 2048, 12
_TOTAL = 1 << _TOTAL_BITS
MAGIC = b"GTB3"
END = 2
_CONTEXTS = 32  # how sure order two is (4), how sure order one is (4), whether they agree
_s = np.arange(-2047, 2048)
_SQUASH = np.clip(np.round(65536 / (1 + np.exp(-_s / 256))), 32, 65536 - 32).astype(np.int64)
_p = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.clip(np.round(256 * np.log(_p / (1 - _p))), -2047, 2047).astype(np.int64)
_ONE, _TWO, _THREE, _FOUR = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))
_SLOT_SHIFT, _INDEX_SHIFT = np.uint32(32 - _SLOT_BITS), np.uint32(32 - _INDEX_BITS)
#: Of an order zero's cell: start and frequency (13 bits), and the id.
_FREQ, _ID = (0, 1) if sys.byteorder == "little" else (1, 0)
_C = np.arange(_CONTEXTS)
#: Of each context: what order two's and order one's own chances go by.
_BY_TWO, _BY_ONE = _C >> 2, (_C & 3) | (_C >> 4 << 2)


#: The most ids from one renewal to the next, or to a block's end.
_LONGEST = 512 + STEP


def _renewals(n: int) -> list[int]:
    """Places at which order zero's frequencies are renewed in a block of n ids: multiples of STEP."""
    return [x for x in (64, 128, 256, 512, 1024, *range(1536, n, 512)) if x < n]


def _either(test: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.where of whole numbers of one type by bits, which takes a fifth of its time where the test is hard to foretell."""
    out = a ^ b
    out &= -test.astype(out.dtype)
    out ^= b
    return out


class _Model:
    """What all lanes know. An entry of the tables is an id and, in its low two bits, how sure; -4 for none."""

    def __init__(self, lanes: int, wide: bool):
        self.kind = np.int64 if wide else np.int32
        self.lanes, lane = lanes, np.arange(lanes)
        self.lane, self.context = lane, lane * _CONTEXTS
        # Order two's table, then order one's.
        self.table, self.slot = np.full(2 * lanes << _SLOT_BITS, -4, self.kind), np.stack([lane, lane + lanes]) << _SLOT_BITS
        # Of each event (order two holds; order one holds, order two doesn't): hits and tries by context, weights.
        self.hits = np.zeros((2, lanes, _CONTEXTS), np.int64)
        self.tries = np.zeros((2, lanes, _CONTEXTS), np.int64)
        self.weight = np.full((2, 2, lanes, 1), 36000, np.int64)
        # Order zero: the index of ids by slot, the counts of the ids, and for each its place (_FREQ) and the id (_ID).
        self.index = np.full(lanes << _INDEX_BITS, -1, np.int16)
        self.known, self.width = np.zeros(lanes, np.int64), 64
        self.counts, self.cells = np.zeros((lanes, 64), np.int32), np.zeros((lanes, 65, 2), np.uint32)
        self.escaped, self.seen = np.ones(lanes, np.int64), np.ones(lanes, np.int64)
        self._mix()
        self._frequencies()

    def look(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, entry: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Into at, entry (two rows: order two, order one): places and entries of the predictions after ids b, a (unsigned
        32-bit); into place: that of the lane's context. The predicted ids."""
        m = a.shape[-1]
        h = np.empty(at.shape, np.uint32)
        two, one = h[..., 0, :], h[..., 1, :]
        np.multiply(a, _ONE, out=two)
        two += b * _TWO
        np.multiply(a, _THREE, out=one)
        h >>= _SLOT_SHIFT
        np.add(h, self.slot[:, :m], out=at)
        self.table.take(at, out=entry, mode="clip")
        guess, sure = entry >> 2, entry & 3
        by = sure[..., 0, :] << 2
        by += sure[..., 1, :]
        np.add(by, self.context[:m], out=place)
        place += (guess[..., 0, :] == guess[..., 1, :]).view(np.int8) << 4
        return guess

    def _mix(self) -> None:
        """Bounds of "order two holds" and "order one holds" in each context (shifted by 16 bits, and added), from the chances by order two's and by
        order one's sureness, mixed; and what the weights are to learn from."""
        if not hasattr(self, "bound"):
            self.inputs, self.chance = [None, None], [None, None]
        for e in range(2):
            own = []
            for by, n in ((_BY_TWO, 8), (_BY_ONE, 8)):
                hit, tried = np.zeros((self.lanes, n), np.int64), np.zeros((self.lanes, n), np.int64)
                for c in range(_CONTEXTS):
                    hit[:, by[c]] += self.hits[e, :, c]
                    tried[:, by[c]] += self.tries[e, :, c]
                own.append(_STRETCH.take(((hit * 4 + 1) * 4096 // (tried * 4 + 8))).take(by, axis=1))
            dot = (self.weight[e, 0] * own[0] + self.weight[e, 1] * own[1]) >> 16
            self.inputs[e], self.chance[e] = own, _SQUASH.take(np.clip(dot, -2047, 2047) + 2047)
        first = np.minimum(self.chance[0], 61440 - 64)
        second = first + np.maximum((65536 - first) * self.chance[1] >> 16, 1)
        self.bound = (first << 16 | np.minimum(second, 61440)).ravel().astype(np.uint32)

    def learn(self, ids: np.ndarray, valid: np.ndarray | None, at: np.ndarray, entry: np.ndarray, place: np.ndarray, mix: bool) -> None:
        """Bring predictions, and with `mix` bounds, up to date with ids (places by lanes); valid None: all of them."""
        hit = entry >> 2 == ids[:, None, :]
        # Of each lane and context: how often order two held, order one alone did, and neither.
        two, one = hit[:, 0].view(np.int8), hit[:, 1].view(np.int8)
        nth, bins = np.multiply((1 - two) * (2 - one), self.lanes * _CONTEXTS, dtype=np.int64), (3, self.lanes, _CONTEXTS)
        nth += place
        seen = np.bincount(nth.ravel() if valid is None else nth[valid], minlength=bins[0] * bins[1] * bins[2]).reshape(bins)
        left = seen[1] + seen[2]
        for e, (hits, tries) in enumerate(((seen[0], seen[0] + left), (seen[1], left))):
            error = hits * 65536 - tries * self.chance[e]
            for k in range(2):
                step = np.einsum("ij,ij->i", error, self.inputs[e][k])[:, None] >> 16
                self.weight[e, k] = np.clip(self.weight[e, k] + np.clip(step, -4000, 4000), 0, 1 << 17)
            self.hits[e] += hits
            self.tries[e] += tries
        if mix:
            self._mix()
        sure = entry & 3
        # An entry that held is surer, one that was sure is less so, another gives way; -4 (none) is never sure.
        made = _either(hit, entry + (sure < 3), _either(sure > 0, entry - 1, (ids << 2)[:, None, :]))
        if valid is None:
            self.table[at] = made
        else:
            both = np.broadcast_to(valid[:, None, :], at.shape)
            self.table[at[both]] = made[both]

    def _slot(self, ids: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """Slots of ids in order zero's index."""
        slot = ids.astype(np.uint32)
        slot *= _FOUR
        slot >>= _INDEX_SHIFT
        return slot + (lane << _INDEX_BITS)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in order zero of ids (places by lanes), -1 for none, and their places, those of the escape for none."""
        m = ids.shape[1]
        d = self.index.take(self._slot(ids, self.lane[:m]))
        cell = self.cell.take(d + self.row[:m], mode="clip")  # -1, none, gives another lane's
        met = (cell >> np.uint64(32)).astype(np.uint32) == ids.astype(np.uint32)
        met &= d >= 0
        return d | -(~met).astype(np.int16), _either(met, cell.astype(np.uint32), self.cells[:m, -1, _FREQ]).view(np.int32)

    def renew(self, ids: np.ndarray, valid: np.ndarray, d: np.ndarray) -> None:
        """Order zero's ids, counts and frequencies, after ids (places by lanes) that were coded since the last time. d: their
        numbers so far, -1 where there is none or it isn't known."""
        m = ids.shape[1]
        # Lane by lane, so that what a lane needs stays at hand.
        ids, d = np.ascontiguousarray(ids.T), np.ascontiguousarray(d.T)
        coded = np.full(m, ids.shape[1])
        if not valid.all():
            coded = valid.sum(axis=0)
            d[~valid.T] = -1
        miss = np.flatnonzero(d < 0) if valid.all() else np.flatnonzero((d < 0) & valid.T)
        own, of = ids.ravel()[miss], miss // ids.shape[1]
        slot = self._slot(own, of)
        fresh = np.flatnonzero(self.index[slot] < 0)
        if len(fresh):
            both = np.sort(slot[fresh] << 32 | np.arange(len(fresh)))
            both = both[np.flatnonzero(np.diff(both >> 32, prepend=-1))]  # of ids that share a slot, the first stays
            key, first = both >> 32, both & 0xFFFFFFFF
            lane, new = key >> _INDEX_BITS, own[fresh[first]]
            start = np.searchsorted(lane, np.arange(self.lanes))
            n = self.known[lane] + np.arange(len(key)) - start[lane]
            room = n < _MOST
            key, lane, new, n = key[room], lane[room], new[room], n[room]
            need = int(n.max(initial=0)) + 1
            if need > self.width:
                more = max(need, min(_MOST, self.width * 2)) - self.width
                self.counts = np.pad(self.counts, ((0, 0), (0, more)))
                self.cells = np.pad(self.cells, ((0, 0), (0, more), (0, 0)))
                self.width += more
            self.cells[lane, n, _ID] = new
            self.index[key] = n
            self.known = np.bincount(lane, minlength=self.lanes) + self.known
        found = self.index[slot]
        met = (found >= 0) & (self.cells[of, found, _ID] == own.astype(np.uint32))
        d.ravel()[miss] = np.where(met, found, np.int16(-1))
        # One bin more before each lane's, for those without number.
        now = np.bincount((d + (self.lane[:m] * (self.width + 1) + 1)[:, None]).ravel(), minlength=self.lanes * (self.width + 1))
        np.add(self.counts, now.reshape(self.lanes, self.width + 1)[:, 1:], out=self.counts, casting="unsafe")
        self.escaped = self.escaped // 2 + np.bincount(of[fresh], minlength=self.lanes)
        self.seen = self.seen // 2 + np.pad(coded, (0, self.lanes - m))
        self._frequencies()

    def _frequencies(self) -> None:
        """Frequencies of ids in order zero, with that of the escape last, and their sums."""
        room = _TOTAL - self.known - np.clip(_TOTAL * (self.escaped + 1) // (self.seen + 2), 16, _TOTAL // 2)
        total = np.maximum(self.counts.sum(axis=1), 1)
        # Counts and room are below 2**13: their products, and the floors of the doubles, are exact.
        share = (self.counts * np.maximum(room, 0).astype(np.float64)[:, None] / total[:, None]).astype(np.int32)
        freq = np.zeros((self.lanes, self.width + 1), np.int32)
        freq[:, :-1] = np.where(np.arange(self.width) < self.known[:, None], share + 1, 0)
        freq[:, -1] = _TOTAL - freq.sum(axis=1)
        self.freq = freq
        self.cells[:, :, _FREQ] = (np.cumsum(freq, axis=1, dtype=np.int32) - freq) << 13 | freq
        self.cell = self.cells.reshape(-1).view(np.uint64)  # both in one number, the id above
        self.row = self.lane * (self.width + 1)

    def slots(self) -> np.ndarray:
        """The number in order zero of each of the _TOTAL slots of each lane."""
        return np.repeat(np.tile(np.arange(self.width + 1, dtype=np.int16), self.lanes), self.freq.ravel())


def _chunks(size: np.ndarray):
    """(first, end, lanes at first, renew: where the frequencies were renewed last, if they are to be renewed at the end)."""
    n, last = int(size[0]), 0
    due = set(_renewals(n))
    for t in range(0, n, STEP):
        end = min(t + STEP, n)
        renew = last if end in due else None
        yield t, end, int(np.searchsorted(-size, -t, "left")), renew
        if end in due:
            last = end


def _valid(size: np.ndarray, t: int, end: int, m: int) -> np.ndarray | None:
    """Which of the places t to end the blocks have; None for all."""
    return None if size[m - 1] >= end else np.arange(t, end)[:, None] < size[:m]


def _mixes(end: int) -> bool:
    """Whether bounds are mixed anew after `end` ids."""
    return end <= 4 * STEP or end % (4 * STEP) == 0


def _before(grid: np.ndarray, t: int, end: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each of the places t to end; 0 before the block."""
    a, b = np.zeros((2, end - t, m), np.uint32)
    a[max(0, 1 - t) :] = grid[max(0, t - 1) : end - 1, :m]
    b[max(0, 2 - t) :] = grid[max(0, t - 2) : max(0, end - 2), :m]
    return a, b


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (unsigned 32-bit, at least one id) as bytes with its header."""
    lanes = len(blocks)
    if not lanes:
        return []
    order = sorted(range(lanes), key=lambda i: -len(blocks[i]))
    size = np.array([len(blocks[i]) for i in order])
    wide = np.array([int(blocks[i].max()) > 65535 for i in order])
    model = _Model(lanes, bool(wide.any()))
    grid = np.zeros((int(size[0]), lanes), model.kind)
    for k, i in enumerate(order):
        grid[: size[k], k] = blocks[i]
    # Whole numbers below 2**53 as doubles: products, sums and powers of two are exact, and quick by vector instructions.
    low, span = np.zeros(lanes), np.full(lanes, 2.0**48 - 1)
    width = int(size[0]) + 8  # an id takes a word at most
    out, at = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width
    number, since = np.full((_LONGEST, lanes), -1, np.int16), 0  # of the ids since the last renewal
    fresh: list[tuple[np.ndarray, np.ndarray]] = []  # lanes and ids coded in full

    def put(own, start, freq) -> None:
        r = np.floor(span[:own] * 2.0**-16)
        start *= r
        start += low[:own]
        r *= freq
        go = r < 2.0**32
        word = np.floor(start * 2.0**-32)
        out[at[:own]] = word  # overwritten later where no word is due
        at[:own] += go
        word *= go
        word *= 2.0**32
        start -= word
        shift = go * 65535.0
        shift += 1
        np.multiply(start, shift, out=low[:own])
        np.multiply(r, shift, out=span[:own])

    for t, end, m, renew in _chunks(size):
        ids = grid[t:end, :m]
        seen = np.empty((end - t, 2, m), np.int64), np.empty((end - t, 2, m), model.kind), np.empty((end - t, m), np.int64)
        guess = model.look(*_before(grid, t, end, m), *seen)
        bound = model.bound.take(seen[2])
        b2, b1 = (bound >> np.uint32(16)).view(np.int32), (bound & np.uint32(65535)).view(np.int32)
        d, cell = model.find(ids)
        number[t - since : end - since, :m] = d
        start, rest = cell >> 13, 65536 - b1
        stop = b1 + (rest * (start + (cell & 8191)) >> _TOTAL_BITS)
        start = b1 + (rest * start >> _TOTAL_BITS)
        two, one = guess[:, 0] == ids, guess[:, 1] == ids
        stop = _either(two, b2, _either(one, b1, stop))
        start = _either(one, b2, start)
        start *= ~two
        start, freq = start.astype(np.float64), (stop - start).astype(np.float64)
        valid = _valid(size, t, end, m)
        escape = ((d < 0) & ~two & ~one if valid is None else (d < 0) & ~two & ~one & valid).T
        fresh.append((np.nonzero(escape)[0], ids.T[escape]))
        for k in range(end - t):
            own = int(np.searchsorted(-size, -(t + k), "left"))
            put(own, start[k, :own], freq[k, :own])
        model.learn(ids, valid, *seen, _mixes(end))
        if renew is not None:
            model.renew(grid[renew:end, :m], np.arange(renew, end)[:, None] < size[:m], number[: end - renew, :m])
            since = end
    of, full = (np.concatenate(x) for x in zip(*fresh, strict=True))
    full = full[np.argsort(of, kind="stable")]
    ends = np.cumsum(np.bincount(of, minlength=lanes))
    made: list[bytes] = [b""] * lanes
    for k, i in enumerate(order):
        words = np.concatenate([out[k * width : at[k]], [int(low[k]) >> 32, (int(low[k]) >> 16) & 65535, int(low[k]) & 65535]]).astype(np.uint32)
        while (over := words >> 16).any():  # carries
            words &= 65535
            words[:-1] += over[1:]
        crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
        back = full[ends[k - 1] if k else 0 : ends[k]].astype(np.uint32)
        if wide[k]:
            back = np.stack([back & 65535, back >> 16], axis=1).ravel()
        words = np.concatenate([words, back[::-1]])
        coded = words.astype("<u2").tobytes()
        made[i] = MAGIC + struct.pack("<III", len(blocks[i]) | (int(wide[k]) << 31), len(words), zlib.crc32(coded, crc)) + coded
    return made


def split(payload: bytes) -> list[bytes]:
    """The blocks of a payload."""
    out, at = [], 0
    while at < len(payload):
        if payload[at : at + 4] != MAGIC:
            raise ValueError("not a block of token ids")
        n = 16 + 2 * struct.unpack_from("<I", payload, at + 8)[0]
        out.append(payload[at : at + n])
        at += n
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ValueError where a checksum fails."""
    lanes = len(blocks)
    if not lanes:
        return []
    heads = [struct.unpack_from("<III", b, 4) for b in blocks]
    count = [h[0] & 0x7FFFFFFF for h in heads]
    order = sorted(range(lanes), key=lambda i: -count[i])
    size = np.array([count[i] for i in order])
    wide = np.array([heads[i][0] >> 31 == 1 for i in order])
    width = max(h[1] for h in heads) + 8
    words = np.zeros(lanes * width, np.uint16)
    for k, i in enumerate(order):
        w = np.frombuffer(blocks[i], "<u2", heads[i][1], 16)
        words[k * width : k * width + len(w)] = w
    model = _Model(lanes, bool(wide.any()))
    at = np.arange(lanes) * width
    back = at + [heads[i][1] - 1 for i in order]
    # As in `encode`. Of a broken block, numbers may grow past 2**53, which its checksum tells.
    span, code = np.full(lanes, 2.0**48 - 1), words[at] * 2.0**32 + words[at + 1] * 65536.0 + words[at + 2]
    at += 3
    grid = np.zeros((int(size[0]), lanes), model.kind)
    number, since = np.full((_LONGEST, lanes), -1, np.int16), 0
    slots = model.slots()
    base = model.lane << _TOTAL_BITS

    def whole(lane) -> np.ndarray:
        back[lane] -= 1
        return words.take(back[lane] + 1, mode="clip").astype(model.kind)

    for t, end, m, renew in _chunks(size):
        seen = np.zeros((end - t, 2, m), np.int64), np.zeros((end - t, 2, m), model.kind), np.zeros((end - t, m), np.int64)
        a, b = _before(grid, t, t + 1, m)
        a, b = a[0], b[0]
        for k in range(t, end):
            own = int(np.searchsorted(-size, -k, "left"))
            place = seen[2][k - t, :own]
            guess = model.look(a[:own], b[:own], seen[0][k - t, :, :own], seen[1][k - t, :, :own], place)
            bound = model.bound.take(place)
            b2, b1 = (bound >> np.uint32(16)).view(np.int32), (bound & np.uint32(65535)).view(np.int32)
            r = span[:own] * 2.0**-16
            np.floor(r, out=r)
            # Dividends are below 2**49 and quotients below 2**17: the floor of the double is that of the exact quotient.
            v = code[:own] / r
            v = np.minimum(v, 65535, out=v).astype(np.int32)
            past, rest = v - b1, 65536 - b1
            one, two = past >> 31, (v - b2) >> 31  # all bits where order one or two holds, where order two does
            np.maximum(past, 0, out=past)
            past <<= _TOTAL_BITS
            past += _TOTAL - 1
            q = (past.astype(np.float64) / rest).astype(np.int64)
            q += base[:own]
            d = slots.take(q)
            cell = model.cell.take(d + model.row[:own])
            # Of order zero: start and stop; where order one or two holds, the start is b1.
            low = cell.astype(np.uint32).view(np.int32)
            edge = np.empty((2, own), np.int32)
            np.right_shift(low, 13, out=edge[0])
            np.add(edge[0], low & 8191, out=edge[1])
            edge *= rest
            edge >>= _TOTAL_BITS
            edge += b1
            start, freq = edge
            freq -= start
            ids = (cell >> np.uint64(32)).astype(model.kind)  # an escape's is no id
            full = np.flatnonzero(d == model.width)
            if len(full):
                full = full[one[full] == 0]
            # b1 to b2 where order one holds, then to 0 where order two does; frequencies and ids likewise.
            step = b1 - b2
            step &= one
            start -= step
            start -= b2 & two
            step -= freq
            step &= one
            freq += step
            freq += (b2 - freq) & two
            other = guess[1] ^ ids
            other &= one
            ids ^= other
            other = guess[0] ^ ids
            other &= two
            ids ^= other
            c, s = edge * r
            go = s < 2.0**32
            np.subtract(code[:own], c, out=c)
            here = at[:own]
            shift = go * 65535.0
            shift += 1
            c *= shift
            np.add(c, words.take(here, mode="clip") * go, out=code[:own])
            np.multiply(s, shift, out=span[:own])
            here += go
            number[k - since, :own] = d | one
            if len(full):
                ids[full] = whole(full)
                far = full[wide[full]]
                if len(far):
                    ids[far] |= whole(far) << 16
                number[k - since, full] = -1
            grid[k, :own] = ids
            b, a = a, ids.astype(np.uint32)
        model.learn(grid[t:end, :m], _valid(size, t, end, m), *seen, _mixes(end))
        if renew is not None:
            model.renew(grid[renew:end, :m], np.arange(renew, end)[:, None] < size[:m], number[: end - renew, :m])
            slots, since = model.slots(), end
    made: list = [None] * lanes
    for k, i in enumerate(order):
        ids = grid[: size[k], k].astype(np.uint32)
        if zlib.crc32(blocks[i][16 : 16 + 2 * heads[i][1]], zlib.crc32(ids.astype("<u4").tobytes())) != heads[i][2]:
            raise ValueError("checksum of a block of token ids")
        made[i] = ids
    return made


#: Of the rows that workers make: a record's ids, little-endian, each in `size` bytes.
SCHEMA = "shard int, record long, first long, doc_ids array<{0}>, lengths array<long>, ids binary, size int"


def _coder(spark: SparkSession) -> None:
    """Make the coder known to the session, as two functions: ids and their size to blocks; blocks and documents' lengths to
    first id, length and checksum of each document."""
    R.java_functions(
        spark, Path(__file__).with_name("TokenCoder.java"),
        {"gnomon_token_blocks": ("gnomon.TokenCoder$Encode", "binary"), "gnomon_token_documents": ("gnomon.TokenCoder$Documents", "array<array<bigint>>")},
    )


def _written(path: str, kind: str, end: int, id_type: pa.DataType):
    @R.trimmed
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, number, before = encoder(path, kind), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # ids, lengths, document ids of closed records
        waiting = 0

        def flush():
            nonlocal number, before, held, waiting
            rows = {"shard": [], "record": [], "first": [], "doc_ids": [], "lengths": [], "ids": [], "size": []}
            for ids, lengths, docs in held:
                size = 2 if ids.max() < 1 << 16 else 4
                for c, v in zip(rows, (shard, number, before, docs.to_pylist(), lengths.tolist(), ids.astype(f"<u{size}").tobytes(), size), strict=True):
                    rows[c].append(v)
                number, before = number + 1, before + len(ids)
            held, waiting = [], 0
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.int32())
            return pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

        for batch in batches:
            data, offs = T.text_bytes(batch.column(1))
            for i, j in T.slices(offs, 1 << 19):
                ids, first = with_ends(*enc.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), end)
                at = 0
                while at < j - i:
                    to = min(j - i, max(at + 1, int(np.searchsorted(first, first[at] + RECORD, "right")) - 1))
                    held.append((ids[first[at] : first[to]], np.diff(first[at : to + 1]), batch.column(0).slice(i + at, to - at)))
                    waiting += int(first[to] - first[at])
                    at = to
                if waiting >= 1 << 20:
                    yield flush()
        if held:
            yield flush()

    return run


def write(spark: SparkSession, docs: DataFrame, target: str, path: str, kind: str = "word", end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, `end` after each, to files below `target`, in ascending order of ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id")
    kind_of = dict(rows.dtypes)["id"]
    _coder(spark)
    made = rows.mapInArrow(_written(path, kind, end, R.arrow_type(rows, "id")), SCHEMA.format(kind_of))
    made.select("shard", "record", "first", "doc_ids", "lengths", F.call_udf("gnomon_token_blocks", "ids", "size").alias("payload")).write.parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    _coder(spark)
    files = spark.read.parquet(target)
    # Every record has a document; the outer generator is one before which no filter decodes the blocks as well.
    each = F.inline_outer(F.arrays_zip("doc_ids", F.call_udf("gnomon_token_documents", "payload", "lengths"))).alias("doc_id", "got")
    decoded = files.select("shard", "first", each)
    decoded = decoded.select("shard", "doc_id", (F.col("first") + F.col("got")[0]).alias("start"), F.col("got")[1].alias("n_tokens"), F.col("got")[2].alias("ids_crc32"))
    # Ids before each shard: one row for each shard.
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    rows = sorted((r["shard"], r["n"]) for r in totals.collect())
    before, table = 0, []
    for shard, n in rows:
        table.append((shard, before))
        before += n
    offsets = spark.createDataFrame(table, "shard int, before long")
    met = decoded.join(F.broadcast(offsets), "shard")
    return met.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_file(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import uuid

    import public_tokenizers

    R.prepare(spark)
    target = f"{R.scratch_root(spark)}/token-file-{uuid.uuid4().hex}"
    write(spark, R.load(spark, sf_dir, "documents"), target, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, target)
