"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is 1 if it is set in over half of the 64-bit hashes of the document's word shingles. Texts with
equal fingerprints are one class; only distinct fingerprints are compared. The 64 bits are cut in m bands, and every
choice of m - radius bands is a table: two fingerprints that differ in at most `radius` bits agree in at least one
choice whole (pigeonhole), so no link is lost. m grows with the number of fingerprints, so that groups stay small.
Groups of a choice that are large all the same are dealt out in pairs of blocks.

Within groups, bit planes are stored vertically: plane k holds bit k of all fingerprints, 64 to a machine word. The
planes against themselves shifted by d give the differing bits of all pairs (i, i + d) at once. Carry-save counters
(three planes and an overflow plane) sum them, and words in which every pair has passed the radius are abandoned.
A group gives a spanning set of links, never all pairs.

Defined cases: null and empty texts have fingerprint zero, which links like any other; rows with a null id get the
component of their fingerprint; repeated rows give repeated rows; columns beside id and text aren't returned by
near_duplicates, and one_of_each returns all of its input's, whatever their names; texts are whole, of any length; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import add_columns, components, cut, group_starts, in_blocks, looked_up, roots_of, unused, whole_groups

#: Rows of a group that are compared in one task at most, in each of two blocks.
BLOCK = 4096


def fingerprints_of(texts: list[str], words: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprints of whole texts as unsigned 64-bit numbers."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        parts = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six blanks only
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(joined, seed))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        begins = np.concatenate(([0], ends[:-1]))
        begins, ends = begins[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist()
        hashes += [digest(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)]
        counts[k] = len(ends)
    out = np.zeros(len(texts), np.uint64)
    some = np.nonzero(counts)[0]
    if not len(some):
        return out
    flat = np.array(hashes, np.uint64)
    stops = np.cumsum(counts[some])
    # a few documents at a time, so that the unpacked bits stay small
    a = 0
    while a < len(some):
        base = stops[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(stops, base + 50_000, side="right")))
        starts = np.concatenate(([base], stops[a : b - 1])) - base
        ones = np.zeros((b - a, 64), np.int64)
        if b - a == 1:
            for i in range(base, stops[a], 50_000):
                ones[0] += np.unpackbits(flat[i : min(i + 50_000, stops[a])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            bits = np.unpackbits(flat[base : stops[b - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = 2 * ones > counts[some[a:b], None]
        out[some[a:b]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
        a = b
    return out


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """df with fp long: the fingerprint of each whole text, as a signed number of the same bits."""
    return add_columns(df, text, lambda: lambda texts: [pa.array(fingerprints_of(texts, words, seed).view(np.int64))], [T.StructField("fp", T.LongType())], 1 << 20)


def shifted(words: np.ndarray, d: int) -> np.ndarray:
    """The bit row moved down by d: bit i of the result is bit i + d."""
    q, r = divmod(d, 64)
    x = words[q:]
    if r:
        y = x >> np.uint64(r)
        y[:-1] |= x[1:] << np.uint64(64 - r)
        x = y
    return x


def pairs_at(planes: np.ndarray, d: int, n: int, radius: int) -> np.ndarray:
    """All i with at most radius (up to 7) differing bits between row i and row i + d, for n rows."""
    count = n - d
    w = (count + 63) // 64
    where = np.arange(w)
    seen = np.full(w, ~np.uint64(0))
    if count % 64:
        seen[-1] = np.uint64((1 << (count % 64)) - 1)
    one = np.zeros(w, np.uint64)
    two, four, over = one.copy(), one.copy(), one.copy()
    whole = True
    for k in range(64):
        p = planes[k]
        x = p[:w] ^ shifted(p, d)[:w] if whole else p[where] ^ later(p, where, d)
        c1 = one & x
        one ^= x
        c2 = two & c1
        two ^= c1
        c3 = four & c2
        four ^= c2
        over |= c3
        if k in (15, 23, 31, 47, 63):
            near = seen & ~over & below(one, two, four, radius)
            live = near != 0
            if not live.all():
                where, seen, one, two, four, over, near = where[live], seen[live], one[live], two[live], four[live], over[live], near[live]
                whole = False
                if not len(where):
                    return where
    rows = np.nonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))[0]
    return where[rows // 64] * 64 + rows % 64


def later(p: np.ndarray, where: np.ndarray, d: int) -> np.ndarray:
    q, r = divmod(d, 64)
    a = p[where + q]
    if r:
        b = p[np.minimum(where + q + 1, len(p) - 1)]
        a = a >> np.uint64(r) | b << np.uint64(64 - r)
    return a


def below(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Where the counter four-two-one is at most radius."""
    out = np.zeros_like(one)
    for v in range(radius + 1):
        out |= ~(one ^ (~np.uint64(0) if v & 1 else np.uint64(0))) & ~(two ^ (~np.uint64(0) if v & 2 else np.uint64(0))) & ~(four ^ (~np.uint64(0) if v & 4 else np.uint64(0)))
    return out


def links_within(fp: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, row) within groups of fingerprints that begin at starts."""
    n = len(fp)
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    rows = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(n)
    group = np.repeat(np.arange(len(sizes)), sizes[order])
    sizes = sizes[order]
    x = fp[rows]
    planes = np.empty((64, (n + 63) // 64 + 1), np.uint64)
    pad = np.zeros(planes.shape[1] * 64, np.uint8)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for k in range(64):
        pad[:n] = bits[:, k]
        planes[k] = np.packbits(pad, bitorder="little").view(np.uint64)
    del bits
    parent = np.arange(n)
    held = np.cumsum(sizes)
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        m = int(held[np.searchsorted(-sizes, -d, side="left") - 1])  # rows of groups with more than d
        i = pairs_at(planes[:, : (m + 63) // 64 + 1], d, m, radius)
        i = i[group[i] == group[i + d]]
        if len(i):
            parent = roots_of(n, i, i + d, parent)
    child = np.nonzero(parent != np.arange(n))[0]
    return rows[child], rows[parent[child]]


def choices(bits: int, m: int, radius: int) -> list[int]:
    """The masks of all choices of m - radius of m bands."""
    edges = [bits * k // m for k in range(m + 1)]
    bands = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(m)]
    return [sum(c) for c in combinations(bands, m - radius)]


def near_links(fps: DataFrame, radius: int, n: int, block: int = BLOCK) -> DataFrame:
    """(u, v): spanning links between distinct fingerprints (column fp) that differ in at most radius bits."""
    m = radius + 1
    while m < 2 * radius and n > 256 << (64 * (m - radius) // m):
        m += 1
    masks = choices(64, m, radius)
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for k, x in enumerate(signed)])).alias("b")).select("fp", F.xxhash64("b.t", "b.v").alias("key"))
    dealt = in_blocks(keyed, ["key"], F.col("fp"), block)
    keys = ["key", "blk_a", "blk_b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            fp = t.column("fp").to_numpy().view(np.uint64)
            a, b = links_within(fp, group_starts(t, keys), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["u", "v"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(compare, "u long, v long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root): a row per row of df; component_id is the smallest id that links reach, root the component's least fp."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    marked = cut(fingerprints(rows, "text", words, seed).drop("text"))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(distinct.select("fp"), radius, distinct.count())
    roots = components(links)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = looked_up(member, least, "root", "fp").select("fp", "component_id", "root")
    return marked.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_of_each(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of df with the smallest id of each component that near_duplicates found; null ids come last."""
    last = (1 << 63) - 1
    d, k = unused(df, "d"), unused(df, "k")
    best = found.groupBy("root").agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias(d), F.col("text_hash").alias(k))).alias("b")).select(f"b.{d}", f"b.{k}")
    keyed = df.withColumns({d: F.coalesce(F.col(doc_id).cast("long"), F.lit(last)), k: F.xxhash64(F.col(text))})
    return keyed.join(best, [d, k]).dropDuplicates([d, k]).select(*[F.col(f"`{c}`") for c in df.columns])
