"""SentencePiece encoding and decoding: vectorised merge rounds over flat symbol arrays.

A text is cut where no piece of the vocabulary can reach across: before a run of spaces, and around line feeds. Each
distinct unit is encoded once. All units of a slice are merged together: one numpy array of symbols, the lowest pair
rank of each unit by a segmented minimum, all of its leftmost non-overlapping places merged at once, and the array
compacted, until no pair remains. Merging many places at once equals one at a time unless a merge makes a pair that
ranks no later than the merged one; units where that happens are encoded by a queue instead.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length are whole; repeated
rows give repeated rows; other columns stay, but for ones named like the new columns, which are replaced; an empty table gives an empty
table. A model that normalises texts is refused with ValueError.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkloom.llm.common import add_columns

SPACE = "▁"
NONE = np.int32((1 << 31) - 1)
#: Symbols from here on stand for characters that are not in the vocabulary; above all code points.
ODD = 1 << 21
#: Bits of a symbol in the key of a pair: ODD and any code point together stay below.
BITS = 22
#: Distinct units that a task remembers before it begins anew.
MOST_UNITS = 150_000
#: Bytes of text that are encoded together.
SLICE = 1 << 20


def runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class Pieces:
    """The vocabulary as tables, from the bytes of a BPE model with byte fallback and no text normalisation."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = "\ufb01 \u2460  \uff21\t\u00ad x "  # what any of the usual normal forms changes
        if m.decode(m.encode(plain)) != plain:
            raise ValueError("the model normalises texts")
        n = m.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.id_of: dict[str, int] = {}
        shown: list[bytes] = []
        score: dict[int, float] = {}
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                shown.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i):
                shown.append(b"")
            elif m.is_unknown(i):
                shown.append(" ⁇ ".encode())
            else:
                self.id_of[p] = i
                score[i] = m.get_score(i)
                shown.append(p.replace(SPACE, " ").encode())
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << BITS | b] = (ranks[score[i]], i)
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        # the last of each is for pairs that aren't in the vocabulary, whose index is -1
        self.rank = np.array([*(pairs[k][0] for k in keys.tolist()), NONE], np.int32)
        self.made = np.array([*(pairs[k][1] for k in keys.tolist()), -1], np.int64)
        # an open hash table of few filled slots: a pair is found at its slot or one of the next
        self.shift = np.uint64(64 - max(10, len(keys).bit_length() + 3))
        self.slots = np.full((1 << (64 - int(self.shift))) + len(keys), -1, np.int64)
        self.at = np.full(len(self.slots), -1, np.int32)
        for i, (k, h) in enumerate(zip(keys.tolist(), self.slot(keys).tolist(), strict=True)):
            while self.slots[h] >= 0:
                h += 1
            self.slots[h], self.at[h] = k, i
        self.shown_len = np.array([len(b) for b in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        apart = "" if any("\n" in p for p in self.id_of) else "\n"
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece of this model has a space after other characters")
        self.units = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|\n+").findall
        self.first = np.full(ODD, -1, np.int64)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.first[ord(p)] = i

    def slot(self, k: np.ndarray) -> np.ndarray:
        return (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each pair in the tables, or -1."""
        k = a << BITS | b
        h = self.slot(k)
        there = self.slots[h]
        out = np.where(there == k, self.at[h], np.int32(-1))
        left = np.nonzero((there != k) & (there >= 0))[0]
        while len(left):
            h[left] += 1
            there = self.slots[h[left]]
            same = there == k[left]
            out[left[same]] = self.at[h[left[same]]]
            left = left[~same & (there >= 0)]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids in one array, and how many each has."""
        n = len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, units), np.int64, n)
        sym = self.first[points]
        sym = np.where(sym < 0, ODD + points, sym)
        own = np.repeat(np.arange(n, dtype=np.int32), lens)
        at = np.full(len(sym), -1, np.int32)  # of the pair that begins at each symbol; later only pairs beside merges change
        inner = np.nonzero(own[1:] == own[:-1])[0]
        at[inner] = self.look(sym[inner], sym[inner + 1])
        done_sym, done_own, hard = [], [], []
        while len(sym):
            rank = self.rank[at]
            new = np.empty(len(sym), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            starts = np.nonzero(new)[0]
            low = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(sym)))
            least = np.repeat(low, counts)
            active = least < NONE
            if not active.all():
                done_sym.append(sym[~active])
                done_own.append(own[~active])
                sym, own, at, rank, least = sym[active], own[active], at[active], rank[active], least[active]
                if not len(sym):
                    break
            p = np.nonzero(rank == least)[0]
            # of hits in a row every second one, from the first
            far = np.empty(len(p), bool)
            far[0] = True
            np.not_equal(p[1:], p[:-1] + 1, out=far[1:])
            p = p[(p - p[np.maximum.accumulate(np.where(far, np.arange(len(p)), 0))]) % 2 == 0]
            s = self.made[at[p]]
            after = sym.copy()
            after[p] = s
            gone = np.zeros(len(sym), bool)
            gone[p + 1] = True
            # pairs of the merged symbol with what is beside it then; the one before may be a merged one as well
            left, right = np.maximum(p - 1, 0), np.minimum(p + 2, len(sym) - 1)
            beside = np.where(gone[left], np.maximum(p - 2, 0), left)
            l_at = np.where((p > 0) & (own[beside] == own[p]), self.look(after[beside], s), np.int32(-1))
            follows = (p + 2 < len(sym)) & (own[right] == own[p])
            n_at = np.where(follows, self.look(s, after[right]), np.int32(-1))
            r_at = n_at.copy()
            twice = np.nonzero(follows & (after[right] != sym[right]))[0]
            r_at[twice] = self.look(s[twice], sym[right[twice]])
            # one that ranks no later than the merged pair would come first if merged one at a time
            bad = (self.rank[l_at] <= least[p]) | (self.rank[r_at] <= least[p])
            at[p] = n_at
            alone = (p > 0) & ~gone[left]
            at[left[alone]] = l_at[alone]
            keep = ~gone
            if bad.any():
                odd = np.unique(own[p[bad]])
                hard += odd.tolist()
                keep &= ~np.isin(own, odd)
            sym, own, at = after[keep], own[keep], at[keep]
        for u in hard:
            got = self.one_by_one(units[u])
            done_sym.append(np.array(got, np.int64))
            done_own.append(np.full(len(got), u, np.int32))
        sym = np.concatenate(done_sym or [np.zeros(0, np.int64)])
        own = np.concatenate(done_own or [np.zeros(0, np.int32)])
        order = np.argsort(own, kind="stable")
        return self.with_bytes(sym[order], own[order], n)

    def with_bytes(self, sym: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside of the vocabulary as the ids of their UTF-8 bytes."""
        odd = sym >= ODD
        if odd.any():
            known, back = np.unique(sym[odd], return_inverse=True)
            raw = [chr(c - ODD).encode() for c in known.tolist()]
            size = np.array([len(b) for b in raw], np.int64)
            start = np.cumsum(size) - size
            flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            lens = np.ones(len(sym), np.int64)
            lens[odd] = size[back]
            table = np.concatenate((flat, sym[~odd]))
            where = np.empty(len(sym), np.int64)
            where[odd] = start[back]
            where[~odd] = len(flat) + np.arange(int((~odd).sum()))
            sym, own = table[runs(where, lens)], np.repeat(own, lens)
        return sym, np.bincount(own, minlength=n)

    def one_by_one(self, unit: str) -> list[int]:
        """The symbols of a unit by a queue of pairs: best rank first, then leftmost."""
        sym: list[int | None] = [i if (i := self.id_of.get(c)) is not None else ODD + ord(c) for c in unit]
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if 0 <= i and j < len(sym) and (hit := self.pairs.get(sym[i] << BITS | sym[j])):
                heapq.heappush(heap, (hit[0], i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            add(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue
            sym[i], sym[j] = self.pairs[a << BITS | b][1], None
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            add(prv[i], i)
            add(i, nxt[i])
        return [s for s in sym if s is not None]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts in one array, and how many each has; each text's first space is the encoder's own."""
        lens = self.shown_len[ids]
        flat = self.shown[runs(self.shown_at[ids], lens)]
        total = np.concatenate(([0], np.cumsum(lens)))
        ends = total[np.cumsum(counts)]
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        own = (ends > begins) & (flat[np.minimum(begins, max(len(flat) - 1, 0))] == 32) if len(flat) else np.zeros(len(ends), bool)
        keep = np.ones(len(flat), bool)
        keep[begins[own]] = False
        return flat[keep], ends - begins - own


class Coder:
    """Encodes and decodes slices of texts and remembers units."""

    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> list[pa.Array]:
        if len(self.known) > MOST_UNITS:
            self.clear()
        cut = [self.pieces.units(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        if new:
            ids, counts = self.pieces.encode_units(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.flat, self.counts = np.concatenate((self.flat, ids)), np.concatenate((self.counts, counts))
        starts = np.cumsum(self.counts) - self.counts
        n_units = np.fromiter(map(len, cut), np.int64, len(cut))
        unit = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n_units.sum()))
        lens = self.counts[unit]
        ids = self.flat[runs(starts[unit], lens)]
        total = np.concatenate(([0], np.cumsum(lens)))
        ends = total[np.cumsum(n_units)]
        counts = np.diff(np.concatenate(([0], ends)))
        text, sizes = self.pieces.decode(ids, counts)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        shown = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), shown]


def encode_decode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with ids array<int> (all ids of the whole text) and decoded string (what the ids stand for).

    The model file, of a fixed size of half a MB, is read on the driver and sent with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    return add_columns(df, text, lambda: Coder(model), [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], SLICE)
