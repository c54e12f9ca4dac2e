"""Suffix-array dedup: bytes of repeated passages, by maximal repeats from the common-prefix interval tree.

A byte is removed if a string of `least` bytes that covers it also starts earlier: in an earlier document, or earlier
in the same one. Matches never cross documents.

1. Every window of `least` bytes chooses the K-byte word in it of the least hash (the leftmost of equals), so equal
   windows choose equal words. Windows in a row with the same chosen word are one occurrence of that word; its context
   is all that those windows cover. Only hashes of words are dealt out, to tell which words occur more than once. A
   word that a slice of documents holds twice is known to, and sends one row a slice to tell the others.
2. Documents are written once in buckets of their key. Contexts of repeated words are cut out there; equal contexts of a
   task are joined, byte by byte, so that a passage of very many copies sends a row a task. Words with more than `most`
   contexts are dealt by longer cores: each window has at least half of what it holds beside the word on one side of it,
   so an occurrence becomes two, whose words are longer by that half; those of cores that still have too many grow
   again, up to whole windows, which are equal in a group.
3. In a group, equal contexts are joined into one with all its occurrences. An enhanced suffix array of the rest (ranks
   by prefix doubling, longest common prefixes) is scanned with a stack for its intervals of at least `least` common
   bytes; an interval whose occurrences have different bytes before them is a maximal repeat group, as is a context that
   has several occurrences. All occurrences but the earliest are removed for the repeat's whole length.
4. Removed ranges meet their document in its bucket and are merged.

Hashes only choose what is compared: nothing is removed without a comparison of bytes. A document's occurrences are held
together, which its own length bounds.

Defined cases: null and empty texts have no bytes; documents with a null id come last; rows that repeat an id and text
are one document and get the same result; rows with the same id and other texts are documents in the order of the
texts' hash. Texts are whole, of any length. Columns beside id and text aren't returned, whatever their names. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import bucketed_cut, cut, slices, whole_groups

#: Bytes of a chosen word.
K = 24
#: Bytes of a document that are looked at together at most, and of distinct contexts that a task joins at a time.
PIECE, HELD_BYTES = 1 << 23, 1 << 24
#: What a row of an occurrence says in place of a size: ask whether its word occurs elsewhere; known to; a slice's count
#: of a word, for those that ask; a word with too many contexts.
ASK, KNOWN, COUNT, HOT = -1, -2, -3, -4
LAST = (1 << 63) - 1
C1, C2, C3, C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C4
    return x ^ (x >> np.uint64(29))


def word_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the K = 24 bytes from each position on, for bytes with K - 1 more behind."""
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    n = len(b) - K + 1
    h = mixed(x[:n] * C1 + np.uint64(1))
    h = mixed((h ^ x[8 : 8 + n]) * C2)
    return mixed((h ^ x[16 : 16 + n]) * C3)


def window_hashes(h: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """A hash of the `least` bytes from each position in at, from the word hashes that cover them."""
    steps = [*range(0, least - K, K), least - K]
    out = np.full(len(at), least, np.uint64)
    for s in steps:
        out = mixed((out ^ h[at + s]) * C1)
    return out


def occurrences(b: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(word hash, context hash, document, first window, windows) of documents that end at `ends` in b."""
    n_all = len(b) - K + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n_all <= 0 or len(b) < least:
        return none
    h = word_hashes(b)
    bits = np.uint64(24)
    v = h >> bits << bits | np.arange(n_all, dtype=np.uint64)
    width, span = least - K + 1, 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    n = len(b) - least + 1
    v = np.minimum(v[:n], v[width - span : width - span + n])
    pos = (v & np.uint64((1 << 24) - 1)).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - begins)[:n]
    inside = np.arange(n) + least <= ends[doc]
    new = np.ones(n, bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    first = np.nonzero(new & inside)[0]
    if not len(first):
        return none
    edge = np.nonzero(np.concatenate((new | ~inside, [True])))[0]
    count = edge[np.searchsorted(edge, first, side="right")] - first
    context = mixed(window_hashes(h, first, least) * C2 ^ window_hashes(h, first + count - 1, least) ^ count.astype(np.uint64) * C3)
    return h[pos[first]], context, doc[first], first - begins[doc[first]], count


def union(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) of documents, with those that touch joined."""
    if not len(a):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    far = np.empty_like(b)
    base = doc * np.int64(1 << 40)
    far = np.maximum.accumulate(b + base) - base
    new = np.ones(len(a), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])
    at = np.nonzero(new)[0]
    return doc[at], a[at], np.maximum.reduceat(b, at)


def long_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each value ends."""
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(x.as_buffer().to_pybytes() for x in col if x.is_valid and len(x.as_buffer())) if col.null_count else b"".join(memoryview(x.as_buffer()) for x in col)
    return np.frombuffer(raw, np.uint8), np.cumsum(sizes)


def equal_ranges(b: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether b has the same `size` bytes from p as from q, for each row; sizes are over 0."""
    out = np.ones(len(p), bool)
    total, at = np.cumsum(size), 0
    while at < len(p):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + PIECE // 2, side="right")))
        starts = total[at:end] - size[at:end] - base
        inner = np.arange(int(total[end - 1] - base)) - np.repeat(starts, size[at:end])
        same = b[np.repeat(p[at:end], size[at:end]) + inner] == b[np.repeat(q[at:end], size[at:end]) + inner]
        out[at:end] = np.logical_and.reduceat(same, starts)
        at = end
    return out


FOUND = "h long, d long, k long, at long, size long"


def rows(h: np.ndarray, d: np.ndarray, k: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, d, k, at, size)], names=["h", "d", "k", "at", "size"])


def find(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Step 1 on (d, k, text): rows (h, d, k, at, size); with a size over 0 the range [at, at + size) is removed.

    An occurrence has size ASK or KNOWN, and in `at` its first window and, in the lower 16 bits, how many windows.
    """
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)):
            b, ends = long_bytes(part.column(2))
            got = []
            if len(b) <= PIECE:
                got.append(occurrences(b, ends, least))
            else:  # one long document
                for at in range(0, len(b), PIECE):
                    h, c, doc, a, n = occurrences(b[at : at + PIECE + least - 1], np.array([min(len(b), at + PIECE + least - 1) - at]), least)
                    got.append((h, c, doc + int(np.searchsorted(ends, at, side="right")), a + at, n))
            h, c, doc, a, n = (np.concatenate(x) for x in zip(*got, strict=True))
            d, k = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
            order = np.lexsort((a, k, d, c, h))
            h, c, doc, d, k, a, n = (x[order] for x in (h.view(np.int64), c, doc, d, k, a, n))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            own = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            begins = np.concatenate(([0], ends[:-1]))
            itself = ~new & (d == d[own]) & (k == k[own]) & (a == a[own])
            again = np.nonzero(~new & ~itself)[0]
            same = (n[again] == n[own[again]]) & equal_ranges(b, begins[doc[again]] + a[again], begins[doc[own[again]]] + a[own[again]], np.minimum(n[again], n[own[again]]) + least - 1)
            new[again[~same]] = True  # equal hashes of unequal contexts
            again = again[same]
            m_doc, m_a, m_b = union(doc[again], a[again], a[again] + n[again] + least - 1)
            md, mk = part.column(0).to_numpy()[m_doc], part.column(1).to_numpy()[m_doc]
            yield rows(np.zeros(len(md), np.int64), md, mk, m_a, m_b - m_a)
            at = np.nonzero(new)[0]
            h, d, k, place = h[at], d[at], k[at], a[at] << 16 | n[at]
            first = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0] if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(h)))
            yield rows(h, d, k, place, np.repeat(np.where(count > 1, KNOWN, ASK), count))
            many = count > 1
            none = np.zeros(int(many.sum()), np.int64)
            yield rows(h[first[many]], none, none, count[many], none + COUNT)


def shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """On rows of find(), those that ask or count sorted by h: ranges, occurrences of words that occur twice, and a HOT row for each word of more than `most`."""
    now, n_rows, total, wait = None, 0, 0, None
    none = np.zeros(1, np.int64)
    for batch in batches:
        size = batch.column(4).to_numpy()
        told = (size != ASK) & (size != COUNT)
        if told.any():
            yield batch.filter(pa.array(told))
            batch = batch.filter(pa.array(~told))
        if not batch.num_rows:
            continue
        h, at, size = (batch.column(i).to_numpy() for i in (0, 3, 4))
        first = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0]
        count = np.diff(np.append(first, len(h)))
        of, totals = count.copy(), np.add.reduceat(np.where(size == COUNT, at, 1), first)
        if now is not None and h[0] == now:
            of[0] += n_rows
            totals[0] += total
            if wait is not None:
                yield wait
        elif total > most:
            yield rows(none + now, none, none, none, none + HOT)
        yield batch.filter(pa.array(np.repeat(of > 1, count) & (size == ASK)))
        hot = h[first[:-1][totals[:-1] > most]]
        zero = np.zeros(len(hot), np.int64)
        yield rows(hot, zero, zero, zero, zero + HOT)
        now, n_rows, total = h[-1], of[-1], totals[-1]
        wait = batch.slice(len(h) - 1, 1) if n_rows == 1 and size[-1] == ASK else None
    if total > most:
        yield rows(none + now, none, none, none, none + HOT)


def enhanced_suffix_array(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each string b[starts:ends] in lexicographic order, and the common prefix of each with the one before.

    Strings lie apart by 8 zero bytes at least. A suffix ends with its string. Returned are positions in b.
    """
    n = len(b)
    x = np.concatenate((b, np.zeros(8, np.uint8))).astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    x = (x[:-4] << np.uint64(32) | x[4:])[:n]
    end = np.zeros(n, np.int64)
    sizes = ends - starts
    inner = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    end[inner] = np.repeat(ends, sizes)

    def ranked(key: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[inner] = np.unique(key[inner], return_inverse=True)[1] + 1
        return out

    levels = [(8, ranked(x))]
    while levels[-1][0] < sizes.max(initial=0):
        size, r = levels[-1]
        i = np.minimum(np.arange(n) + size, n - 1)
        follow = np.where(np.arange(n) + size < end, r[i], 0)
        levels.append((2 * size, ranked(r << np.int64(32) | follow)))
    order = inner[np.argsort(levels[-1][1][inner], kind="stable")]
    p, q = order[:-1].copy(), order[1:].copy()
    pe, qe = end[p], end[q]
    common = np.zeros(len(p), np.int64)
    for size, r in reversed(levels):
        pi, qi = np.minimum(p + common, n - 1), np.minimum(q + common, n - 1)
        ok = (p + common + size <= pe) & (q + common + size <= qe) & (r[pi] == r[qi])
        common[ok] += size
    for _ in range(7):
        pi, qi = np.minimum(p + common, n - 1), np.minimum(q + common, n - 1)
        ok = (p + common < pe) & (q + common < qe) & (b[pi] == b[qi])
        common[ok] += 1
    return order, np.concatenate(([0], common))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(common bytes, first, last) of each interval of the tree with at least `least` common bytes, by a stack."""
    deep = np.nonzero(lcp >= least)[0]
    if not len(deep):
        return
    breaks = np.nonzero(np.diff(deep) > 1)[0] + 1
    for run in np.split(deep, breaks):
        stack: list[tuple[int, int]] = []
        values = lcp[run[0] : run[-1] + 1].tolist()
        i = int(run[0])
        for i, v in enumerate(values, i):
            first = i - 1
            while stack and stack[-1][0] > v:
                size, first = stack.pop()
                yield size, first, i - 1
            if not stack or stack[-1][0] < v:
                stack.append((v, first))
        while stack:
            size, first = stack.pop()
            yield size, first, i


def maximal_repeats(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions): each maximal repeat of at least `least` bytes with all of its occurrences."""
    order, lcp = enhanced_suffix_array(b, starts, ends)
    left = b[np.maximum(order - 1, 0)].astype(np.int64)
    at_start = np.isin(order, starts)
    left[at_start] = -1 - np.arange(int(at_start.sum()))  # nothing is known before a string: differs from all
    changes = np.cumsum(np.concatenate(([0], left[1:] != left[:-1])))
    for size, first, last in intervals(lcp, least):
        if changes[last] > changes[first]:
            yield size, order[first : last + 1]


def repeated_part(flat: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings cut to the part that windows of `least` bytes cover whose hash occurs again among all strings.

    (bytes, ends, which string, bytes cut off before). Equal windows have equal hashes, so no repeat is lost; the rest
    need not be sorted.
    """
    begins = np.concatenate(([0], ends[:-1]))
    sizes = np.maximum(ends - begins - least + 1, 0)
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    if not len(at):
        return flat[:0], ends[:0], ends[:0], ends[:0]
    own = np.repeat(np.arange(len(ends)), sizes)
    hashes = window_hashes(word_hashes(flat), at, least)
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    same = sorted_[1:] == sorted_[:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.nonzero(again)[0]
    row, first = np.unique(own[hit], return_index=True)
    last = np.append(first[1:], len(hit))[: len(row)] - 1
    lo, hi = at[hit[first]], at[hit[last]] + least
    n = hi - lo
    stops = np.cumsum(n)
    return flat[np.repeat(lo - (stops - n), n) + np.arange(int(n.sum()))], stops, row, lo - begins[row]


CONTEXT = "h long, d long, k long, a long, size long, ctx binary, p int"
NAMES = ["h", "d", "k", "a", "size", "ctx", "p"]


def ranges_of(d: np.ndarray, k: np.ndarray, a: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Ranges to remove as rows of CONTEXT, those of a document that touch joined."""
    docs, doc = np.unique(np.stack((d, k), 1), axis=0, return_inverse=True) if len(d) else (np.zeros((0, 2), np.int64), d)
    doc, a, b = union(doc.ravel(), a, a + size)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, docs[doc, 0], docs[doc, 1], a, b - a)] + [pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int32())], names=NAMES)


def grown(ctx: bytes, p: int, w: int, g: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """A context whose windows all hold the core [p, p + w), in two: windows with g bytes before it, and the others, which have g behind it.

    (offset, end, new core's offset in it, hash of the new core): the core has w + g bytes then. least - w must be 2 g - 1 at least.
    """
    n, left = len(ctx) - least + 1, p - g + 1
    key = lambda at: int.from_bytes(blake2b(ctx[at : at + w + g], digest_size=8).digest(), "little", signed=True)
    if left > 0:
        yield 0, min(left, n) + least - 1, p - g, key(p - g)
    if left < n:
        at = max(left, 0)
        yield at, len(ctx), p - at, key(p)


def growth(w: int, least: int) -> int:
    """By how many bytes a core of w grows."""
    return (least - w + 1) // 2


def contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Step 2 on (d, k, text, want): contexts of the wanted occurrences as rows of CONTEXT, equal ones once, and ranges for their repeats.

    Those of hot words have a longer core, whose place is p.
    """
    held: dict[tuple, tuple[int, int, int]] = {}
    gone: list[tuple[int, int, int, int]] = []
    used = 0

    def out() -> Iterator[pa.RecordBatch]:
        if gone:
            yield ranges_of(*np.array(gone, np.int64).T)
        if held:
            key = list(zip(*held, strict=True))
            where = np.array(list(held.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[0], pa.int64()), *(pa.array(where[:, i]) for i in range(3)), pa.array(np.full(len(where), ASK, np.int64)), pa.array(key[1], pa.binary()), pa.array(key[2], pa.int32())], names=NAMES)

    g = growth(K, least)
    for batch in batches:
        want = batch.column(3)
        h, place, hot = (want.flatten().field(i) for i in range(3))
        h, place, hot = h.to_numpy(), place.to_numpy(), hot.to_numpy(zero_copy_only=False)
        starts, width = (place >> 16).tolist(), (place & 0xFFFF).tolist()
        offsets = (want.offsets.to_numpy() - want.offsets[0].as_py()).tolist()
        for i, (d, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            raw = batch.column(2)[i].as_buffer().to_pybytes() if batch.column(2)[i].is_valid else b""
            for j in range(offsets[i], offsets[i + 1]):
                a, n = starts[j], width[j]
                ctx = raw[a : a + n + least - 1]
                parts = [(int(h[j]), ctx, None, a)]
                if hot[j]:
                    p = n - 1 + int(np.argmax(word_hashes(np.frombuffer(ctx, np.uint8))[n - 1 : least - K + 1].view(np.int64) == h[j]))
                    parts = [(key, ctx[lo:hi], at, a + lo) for lo, hi, at, key in grown(ctx, p, K, g, least)]
                for key, part, at, x in parts:
                    here, name = (d, k, x), (key, part, at)
                    there = held.setdefault(name, here)
                    if there is here:
                        used += len(part) + 200
                    elif there != here:
                        late = max(there, here)
                        held[name] = min(there, here)
                        gone.append((*late, len(part)))
            if used > HELD_BYTES or len(gone) > 200_000:
                yield from out()
                held.clear()
                gone.clear()
                used = 0
    yield from out()


def regrown(batches: Iterator[pa.RecordBatch], w: int, least: int) -> Iterator[pa.RecordBatch]:
    """Contexts with cores of w bytes, with the next longer ones."""
    g = growth(w, least)
    for batch in batches:
        cols: list[list] = [[] for _ in NAMES]
        for _, d, k, a, _, ctx, p in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            for lo, hi, at, key in grown(ctx, p, w, g, least):
                for col, x in zip(cols, (key, d, k, a + lo, ASK, ctx[lo:hi], at), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary(), pa.int32()], strict=True)], names=NAMES)


def distinct_contexts(batches: Iterator[pa.RecordBatch], gone: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, ctx, d, k, a the first of each context; the ranges of the others, and ranges as they come, go to gone."""
    held = None  # the open context: h, ctx, d, k, a
    for batch in batches:
        size = batch.column(4).to_numpy()
        if (size > 0).any():
            gone.append(batch.filter(pa.array(size > 0)))
            batch = batch.filter(pa.array(size <= 0))
        if not batch.num_rows:
            continue
        h, d, k, a = (batch.column(i).to_numpy() for i in range(4))
        ctx = batch.column(5)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | pc.not_equal(ctx.slice(1), ctx.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False)
        if held:
            new[0] = h[0] != held[0] or ctx[0].as_py() != held[1]
        own = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        fd, fk, fa = (np.where(own < 0, held[i + 2] if held else 0, x[own]) for i, x in enumerate((d, k, a)))
        again = ~new & ((d != fd) | (k != fk) | (a != fa))
        if again.any():
            gone.append(ranges_of(d[again], k[again], a[again], pc.binary_length(ctx).to_numpy()[again].astype(np.int64)))
        if new.any():
            i = int(np.nonzero(new)[0][-1])
            held = (h[i], ctx[i].as_py(), d[i], k[i], a[i])
            yield batch.filter(pa.array(new))


def compare(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Step 3: ranges to remove as rows of CONTEXT, from contexts that are sorted by h, ctx, d, k, a."""
    gone: list[pa.RecordBatch] = []
    for t in whole_groups(distinct_contexts(batches, gone), ["h"], 8_000):
        yield from gone
        gone.clear()
        h = t.column("h").to_numpy()
        again = np.zeros(len(h), bool)
        again[1:] |= h[1:] == h[:-1]
        again[:-1] |= h[1:] == h[:-1]
        if not again.any():  # one context a word
            continue
        t = t.filter(pa.array(again))
        flat, ends = long_bytes(t.column("ctx").combine_chunks())
        d, k, a = (t.column(c).to_numpy() for c in ("d", "k", "a"))
        flat, ends, row, skip = repeated_part(flat, ends, least)
        if not len(row):
            continue
        d, k, a = d[row], k[row], a[row] + skip
        sizes = np.diff(np.concatenate(([0], ends)))
        begins = np.cumsum(sizes + 8) - (sizes + 8)
        b = np.zeros(int((sizes + 8).sum()), np.uint8)
        b[np.repeat(begins - (ends - sizes), sizes) + np.arange(len(flat))] = flat
        own = np.searchsorted(begins, np.arange(len(b)), side="right") - 1
        docs = np.unique(np.stack((d, k), 1), axis=0, return_inverse=True)[1].ravel()
        where = a[own] + np.arange(len(b)) - begins[own]
        rank = docs[own] * np.int64(1 << 40) + where
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size, at in maximal_repeats(b, begins, begins + sizes, least):
            r = rank[at]
            rest = at[r != r.min()]
            found.append((own[rest], where[rest], np.full(len(rest), size)))
        if found:
            o, lo, size = (np.concatenate(x) for x in zip(*found, strict=True))
            yield ranges_of(d[o], k[o], lo, size)
    yield from gone


def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, n_bytes, removed, kept) from (d, text, ranges)."""
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
            sizes, removed, kept = [], [], []
            for text, ranges in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                at, out, gone = 0, [], []
                for r in sorted((x["a"], x["b"]) for x in ranges or ()):
                    if gone and r[0] <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], r[1])
                    else:
                        gone.append({"start": r[0], "end": r[1]})
                for g in gone:
                    out.append(raw[at : g["start"]])
                    at = g["end"]
                out.append(raw[at:])
                sizes.append(len(raw))
                removed.append(gone)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["d", "n_bytes", "removed", "kept"])


def deduplicate(df: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text", most: int = 4096) -> DataFrame:
    """(doc_id, n_bytes long, removed array<struct<start, end>> in bytes, kept binary): a row per row of df.

    most: contexts of a word beyond which its words grow; results don't depend on it.
    """
    if not 2 * K <= least < 1 << 16:
        raise ValueError(f"least must be {2 * K} to {(1 << 16) - 1}")
    docs = bucketed_cut(df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("text")), ["d", "k"])
    dealt = F.when(F.col("size").isin(ASK, COUNT), F.col("h")).otherwise(F.xxhash64("d", "k", "at"))
    found = cut(docs.select("d", "k", "text").mapInArrow(lambda it: find(it, least), FOUND).repartition(dealt).sortWithinPartitions("h").mapInArrow(lambda it: shared(it, most), FOUND))
    hot = found.filter(F.col("size") == HOT).select("h", F.lit(True).alias("hot"))
    want = found.filter(F.col("size").isin(ASK, KNOWN)).select("h", "d", "k", "at")
    some_hot = not hot.isEmpty()
    want = want.join(hot, "h", "left") if some_hot else want.withColumn("hot", F.lit(False))
    want = want.groupBy("d", "k").agg(F.collect_list(F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want"))
    fetched = docs.join(want, ["d", "k"]).select("d", "k", "text", "want").mapInArrow(lambda it: contexts(it, least), CONTEXT)
    if some_hot:
        fetched = cut(fetched)
        cool, todo, w = fetched.filter("p IS NULL"), fetched.filter("p IS NOT NULL"), K + growth(K, least)
        while w < least:
            large = todo.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("h", F.lit(True).alias("large"))
            large = cut(large)
            if large.isEmpty():
                break
            marked = todo.join(large, "h", "left")
            cool = cool.union(marked.filter("large IS NULL").drop("large").select(*NAMES))
            todo = cut(marked.filter("large").select(*NAMES).mapInArrow(lambda it, w=w: regrown(it, w, least), CONTEXT))
            w += growth(w, least)
        fetched = cool.union(todo)
    by = ["h", "ctx", "d", "k", "a"]
    compared = fetched.repartition("h").sortWithinPartitions(*by).mapInArrow(lambda it: compare(it, least), CONTEXT)
    gone = found.filter("size > 0").select("d", "k", F.col("at").alias("a"), "size").union(compared.select("d", "k", "a", "size"))
    ranges = gone.groupBy("d", "k").agg(F.collect_list(F.struct("a", (F.col("a") + F.col("size")).alias("b"))).alias("ranges"))
    out = docs.join(ranges, ["d", "k"], "left").select("d", "text", "ranges").mapInArrow(without, "d long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "n_bytes", "removed", "kept")
