"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order: the first `prefix` of its permutation. It
stands in the inverted lists of its `listed` nearest pivots. Within a list, vectors that share at least `shared` pivots
of their prefixes are retrieved, and only their cosine is computed, in double precision. A pair counts once, in the list
of its smallest common pivot. Equal vectors of a label are one class with a count and are compared once. A list that is
long is split by the further pivots of its vectors' permutations (as retrieved pairs share more than one), and what is
long even so - a crowd of nearly equal vectors - is dealt out in pairs of blocks, as each of its pairs counts.

Pivots grow with the root of the number of classes (PER_ROOT times it, MOST_PIVOTS at most), so that lists grow with the
root too. They come from a sample of 8 times as many vectors, by hash of the class, none of them within cosine 0.9 of
another, so that a crowd gets one pivot. All vectors are indexed. Vectors of a length that the sample has not seen share
one list and are compared exactly. prefix=None is the exact way for all: a label's vectors of a length are one list.

Defined cases: rows whose vector is null, empty, zero or has null or non-finite components, or whose label or id is
null, link with nothing: n_links 0, component_id their own id. Rows that repeat an id count as vectors of their own, with
links and component of their own label and vector. Columns beside id, vector and label aren't returned, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import components, cut, drop_cut, group_starts, in_blocks, looked_up, roots_of, whole_groups

#: Pivots: how many for the root of the number of classes, and at least and at most; rows of the sample for each.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, SAMPLED = 4, 64, 8192, 8
#: How many nearest pivots describe a vector, list it, and must be shared.
PREFIX, LISTED, SHARED = 8, 4, 3
BLOCK = 2048
#: A pivot's number holds its vectors' length above so many bits.
BITS = 16


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, most: int, least: float = 0.9) -> np.ndarray:
    """Up to `most` rows of unit vectors, the first ones of which none is within cosine `least` of one before."""
    chosen = np.zeros((0, x.shape[1]))
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        part = part[(part @ chosen.T).max(axis=1, initial=-1.0) <= least]
        near = part @ part.T > least
        keep = np.zeros(len(part), bool)
        for i in range(len(part)):
            keep[i] = not (near[i, :i] & keep[:i]).any()
        chosen = np.concatenate((chosen, part[keep]))[:most]
        if len(chosen) == most:
            break
    return chosen


def matrix(v: pa.ListArray, at: np.ndarray, size: int) -> np.ndarray:
    return v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def choose_pivots(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by length of the vectors (column v), from a sample of the n classes by hash of their number."""
    most = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PER_ROOT * n**0.5)))
    rows = classes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLED * most).select("v").toArrow().column("v").combine_chunks()
    lens = np.diff(rows.offsets.to_numpy())
    return {k: apart(unit(matrix(rows, np.nonzero(lens == k)[0], k)), most) for k in np.unique(lens).tolist()}


def indexed(classes: DataFrame, pivots: dict[int, np.ndarray], prefix: int | None) -> DataFrame:
    """classes with near array<long>: the numbers of each vector's nearest pivots, the nearest first."""
    names = [*classes.columns, "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            lens = np.diff(v.offsets.to_numpy())
            for size in np.unique(lens).tolist():
                at = np.nonzero(lens == size)[0]
                piv = pivots.get(size)
                if prefix is None or piv is None or len(piv) < 2:
                    near = np.full((len(at), 1), -1, np.int64)
                else:
                    near = np.argsort(-(unit(matrix(v, at, size)) @ piv.T), axis=1, kind="stable")[:, :prefix]
                near = near + np.int64(size << BITS)
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), lists], names=names)

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("near", T.ArrayType(T.LongType()))]))


KEYS = ["grp", "p", "q", "blk_a", "blk_b"]


def lists_of(index: DataFrame, listed: int, block: int) -> DataFrame:
    """The inverted lists' entries (grp, p, q, node, n, near, v): q is -1, but in lists over `block` each further pivot."""
    entries = index.select("grp", "node", "n", "near", "v", F.explode(F.slice("near", 1, listed)).alias("p"))
    sizes = cut(entries.groupBy("grp", "p").agg(F.count("*").alias("m")).filter(F.col("m") > block).select("grp", "p", F.lit(True).alias("long")))
    marked = entries.join(sizes, ["grp", "p"], "left")
    further = F.array_remove(F.col("near"), F.col("p"))
    alone = F.col("long").isNull() | (F.size("near") < 2)
    return marked.withColumn("q", F.explode(F.when(alone, F.array(F.lit(-1).cast("long"))).otherwise(further))).drop("long")


def members(near: list[np.ndarray]) -> np.ndarray:
    """Whether a row's prefix has each pivot of the group, as a matrix."""
    flat = np.concatenate(near)
    names, at = np.unique(flat, return_inverse=True)
    out = np.zeros((len(near), len(names)), np.float32)
    out[np.repeat(np.arange(len(near)), [len(x) for x in near]), at] = 1
    return out


def first_common(a: np.ndarray, b: np.ndarray, but: int = -1) -> int:
    both = np.intersect1d(a, b)
    both = both[both != but]
    return int(both[0]) if len(both) else -1


def verified(dealt: DataFrame, least: float, listed: int, shared: int) -> DataFrame:
    """(node, links, root): from each list, the links of a node as a count of vectors, and a spanning link."""

    def pairs(x: np.ndarray, near: list[np.ndarray], p: int, q: int, cross: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m = members(near)
        few = min(shared, min(map(len, near)))
        # the same prefixes come again and again in a crowd
        ids: dict[bytes, int] = {}
        kind = np.array([ids.setdefault(a.tobytes(), len(ids)) for a in near])
        one = [near[i] for i in np.unique(kind, return_index=True)[1]]
        for c in range(0, len(x), 1024):
            retrieved = m[c : c + 1024] @ m.T >= few
            if cross is not None:
                retrieved &= cross[c : c + 1024, None] != cross[None, :]
            i, j = np.nonzero(retrieved & (x[c : c + 1024] @ x.T >= least))
            i, j = i[i + c < j] + c, j[i + c < j]
            if not len(i):
                continue
            both, back = np.unique(kind[i] * len(one) + kind[j], return_inverse=True)
            mine = [first_common(a[:listed], b[:listed]) == p and (q < 0 or first_common(a, b, p) == q) for a, b in ((one[x], one[y]) for x, y in zip(*divmod(both, len(one)), strict=True))]
            keep = np.array(mine)[back]
            yield i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, KEYS, 20_000):
            starts = group_starts(t, KEYS)
            node, n, own, p, q = (t.column(c).to_numpy() for c in ("node", "n", "own", "p", "q"))
            crossed = t.column("blk_a").to_numpy() != t.column("blk_b").to_numpy()
            near, v = t.column("near").combine_chunks(), t.column("v").combine_chunks()
            lens, flat, offs = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy() - v.offsets[0].as_py()
            near_flat, near_offs = near.flatten().to_numpy(), near.offsets.to_numpy() - near.offsets[0].as_py()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist(), strict=True):
                if b - a < 2:
                    continue
                x = unit(flat[offs[a] : offs[b]].reshape(b - a, lens[a]))  # a list's vectors have one length
                found, parent = np.zeros(b - a, np.int64), np.arange(b - a)
                for i, j in pairs(x, [near_flat[near_offs[r] : near_offs[r + 1]] for r in range(a, b)], int(p[a]), int(q[a]), own[a:b] if crossed[a] else None):
                    np.add.at(found, i, n[a + j])
                    np.add.at(found, j, n[a + i])
                    parent = roots_of(b - a, i, j, parent)
                hit = np.nonzero(found)[0]
                if len(hit):
                    out.append((node[a + hit], found[hit], node[a + parent[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "node long, links long, root long")


def near_duplicates(df: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", prefix: int | None = PREFIX, listed: int = LISTED, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of df; vectors link at cosine >= least within a label."""
    v = F.col("v")
    usable = F.col("vec_id").isNotNull() & F.col("lab").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("lab"), F.col(embedding).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    good = rows.filter("ok").select("vec_id", "lab", "v")
    classes = cut(good.groupBy("lab", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumns({"grp": F.xxhash64("lab"), "node": F.monotonically_increasing_id()}))
    index = cut(indexed(classes, choose_pivots(classes, classes.count()), prefix))
    drop_cut(classes)
    dealt = in_blocks(lists_of(index, listed, block), ["grp", "p", "q"], F.col("node"), block)
    found = cut(verified(dealt, least, listed, shared))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    state = cut(index.select("lab", "v", "node", "n", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = state.groupBy("root").agg(F.min("least").alias("component_id"))
    state = looked_up(state, lowest, "root", "node").select("lab", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(state, ["lab", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
