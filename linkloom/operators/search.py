"""Search: BM25 postings, token and trigram search, nearest vectors and fused suggestions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as Y
from linkloom.functions import text as X
from linkloom.operators.relational import top_k


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word) for each word, repeats included."""
    return df.select(key, F.explode(F.filter(F.split(X.normalize_content(F.col(text)), r"\s+"), lambda w: F.length(w) > 2)).alias("word"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, cut: float = -1.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query. Scores are negative, lower is better, and those not under `cut` are left out.

    One scan without a shuffle gives the totals, one the postings of the queries' words, with each document's length;
    document frequencies come from these postings.
    """
    words = F.filter(F.split(X.normalize_content(F.col(text)), r"\s+"), lambda w: F.length(w) > 2)
    # no filter on the words' array, nor an explode that brings one: each would split the text once more
    size = docs.select(F.coalesce(F.size(words), F.lit(0)).alias("n")).agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("all"))
    total = size.select("n_docs", (F.col("all") / F.col("n_docs")).alias("avg_len"))
    asked = words_of(queries, query_key, query_text).distinct()
    split = docs.select(key, words.alias("ws")).select(key, F.size("ws").alias("len"), F.explode_outer("ws").alias("word"))
    mine = split.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word", key, "len").agg(F.count("*").alias("tf"))
    # the counts are asked for here too, so that this is the same exchange as the one that is scored, and made once
    df = mine.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).filter("all > 0").drop("all")
    scored = mine.join(df, "word").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # by document, so that its words' shares are summed where they are
    shares = scored.select("word", key, weight.alias("w")).repartition(F.col(key))
    hits = shares.join(asked, "word").groupBy(query_key, key).agg(F.round(-F.sum("w"), 6).alias("score"))
    return top_k(hits.filter(F.col("score") < cut), [query_key], [F.asc("score"), F.asc(key)], k)


def name_candidates(names: DataFrame, name: str = "p_name") -> DataFrame:
    """(a, b), a < b: pairs of distinct names that share two letters in a row or their first letter; never all with all.

    Names that share neither are Jaro-Winkler neighbours only as scrambled letters.
    """
    n = names.select(F.col(name).alias("n")).distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - 1, F.lit(1))), lambda i: F.substring(F.col("n"), i, F.lit(2)))
    keyed = n.select("n", F.explode(F.array_distinct(F.concat(pairs, F.array(F.concat(F.lit("^"), F.substring("n", 1, 1)))))).alias("g"))
    return keyed.select("g", F.col("n").alias("a")).join(keyed.select("g", F.col("n").alias("b")), "g").filter("a < b").select("a", "b").distinct()


def holding(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, names' columns): texts that contain a name, met by the name's first three characters (all of a shorter one)."""
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("t__")), lambda i: F.array(*[F.substring(F.col("t__"), i, F.lit(k)) for k in (1, 2, 3)]))))
    keyed = texts.select(F.col(key), F.col(text).alias("t__")).filter(F.length("t__") > 0).withColumn("g__", F.explode(grams))
    named = names.filter(F.length(name) > 0).withColumn("g__", F.substring(name, 1, 3))
    # a merge: the size of a scan says little of its texts' grams, and they would be broadcast
    return keyed.hint("merge").join(named, "g__").filter(F.col("t__").contains(F.col(name))).drop("g__", "t__")


def dictionary_hits(texts: DataFrame, key: str, text: str, masters: DataFrame, master: str, names: list[str]) -> DataFrame:
    """(key, master, method): of each text the masters that it names, by the first of the name columns that is found in it.

    Equal texts are searched once, for the names of all columns at once; what is found goes to their keys as one array.
    """
    ways = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("method"), F.lower(name).alias("name")) for n, name in enumerate(names)])
    named = masters.select(master, F.explode(ways).alias("w")).select(master, F.struct("w.n", "w.method").alias("m"), F.col("w.name").alias("n__")).distinct()
    asked = texts.select(F.col(key).alias("k__"), F.col(text).alias("x__")).filter(F.length("x__") > 0)
    hits = holding(asked.select("x__").distinct(), "x__", "x__", named, "n__").groupBy("x__", master).agg(F.min("m").alias("m"))
    by_text = hits.groupBy("x__").agg(F.collect_list(F.struct(master, "m")).alias("found"))  # at most all masters
    # a key of several texts has a master once; a merge, as a scan's size says little of its strings
    by_key = asked.distinct().hint("merge").join(by_text, "x__").groupBy("k__").agg(F.collect_list("found").alias("found"))
    every = F.array_sort(F.flatten("found"))
    first = F.filter(every, lambda x, i: (i == 0) | ~x[master].eqNullSafe(F.get(every, i - 1)[master]))
    return by_key.select(F.col("k__").alias(key), F.explode(F.when(F.size("found") == 1, F.col("found")[0]).otherwise(first)).alias("f")).select(key, f"f.{master}", "f.m.method")


def trigram_topk(queries: DataFrame, names: DataFrame, columns: list[str], k: int = 5, least: float = 0.3) -> DataFrame:
    """(q, id, method, score, rank): the k best rows of names for each query by the greatest trigram similarity of the columns.

    method says whether a column contains the query (like) or is only similar (trigram).
    """
    found = None
    for c in columns:
        one = trigram_matches(queries.select(F.col("q").alias("a")).distinct(), names.select(F.col(c).alias("b")).distinct(), least)
        hits = one.join(names.select("id", F.col(c).alias("b")), "b").select(F.col("a").alias("q"), "id", F.col("similarity").alias("score"), F.lower("b").contains(F.lower("a")).alias("like"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("q", "id").agg(F.max("score").alias("score"), F.max("like").alias("like"))
    return top_k(best, ["q"], [F.desc("score"), F.asc("id")], k).select("q", "id", F.when(F.col("like"), "like").otherwise("trigram").alias("method"), "score", "rank")


def exact_then_fuzzy(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name, method): names that share a word with a text, and those that share a trigram with its longer words where no word did."""
    words = words_of(texts, key, text).distinct()
    named = names.select(name).distinct()
    exact = words.join(named.select(name, F.explode(X.tokens(F.col(name))).alias("word")), "word").select(key, name).distinct()
    grams = lambda df, c, keep: df.select(*keep, F.explode(X.trigrams(F.col(c))).alias("g")).distinct()
    long = words.filter(F.length("word") >= 4)
    fuzzy = grams(long, "word", [key]).join(grams(named.select(name, F.explode(X.tokens(F.col(name))).alias("w")), "w", [name]), "g").select(key, name).distinct()
    return exact.withColumn("method", F.lit("exact")).unionByName(fuzzy.join(exact, [key, name], "left_anti").withColumn("method", F.lit("fuzzy")))


def semantic_repeats(df: DataFrame, key: str, sender: str, second: str, vector: str, seconds: int = 600, least: float = 0.95) -> DataFrame:
    """(key, earlier, similarity): rows of one sender and up to so many seconds before, with cosine over `least`; met by sender and time slot, not all with all."""
    slot = F.floor(F.col(second) / seconds)
    late = df.select(F.col(key).alias("key"), F.col(sender).alias("s"), F.col(second).alias("t"), F.col(vector).alias("v"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    early = df.select(F.col(key).alias("earlier"), F.col(sender).alias("s"), F.col(second).alias("u"), F.col(vector).alias("w"), slot.alias("slot"))
    near = late.join(early, ["s", "slot"]).filter((F.col("u") < F.col("t")) & (F.col("u") >= F.col("t") - seconds))
    return near.select(F.col("key").alias(key), "earlier", F.round(Y.cosine(F.col("v"), F.col("w")), 6).alias("similarity")).filter(F.col("similarity") > least)


def trigram_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of names (a of left, b of right) whose trigrams' Jaccard similarity reaches `least`, over 0.

    Names of similarity t share one of the rarest |x| - ceil(t |x|) + 1 trigrams of either, so only those are keys, and
    frequent trigrams make no candidates; the similarity itself is of all trigrams.
    """
    sides = [(df.select(c).filter(F.col(c).isNotNull()).distinct(), c) for df, c in ((left, "a"), (right, "b"))]
    exploded = [df.select(F.col(c).alias("n"), F.explode(Y.word_trigrams(F.col(c))).alias("g")) for df, c in sides]
    often = exploded[0].select("g").unionAll(exploded[1].select("g")).groupBy("g").agg(F.count("*").alias("f"))

    def keys(x: DataFrame, c: str) -> DataFrame:
        by = x.join(often, "g").groupBy(F.col("n").alias(c)).agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("gs"))  # a name's own
        few = F.size("gs") - F.ceil((least - 1e-6) * F.size("gs")).cast("int") + 1
        return by.select(c, F.explode(F.slice("gs", 1, F.least(F.size("gs"), few))).alias("k")).select(c, "k.g")

    pairs = keys(exploded[0], "a").join(keys(exploded[1], "b"), "g").select("a", "b").distinct()
    return pairs.withColumn("similarity", F.round(Y.trigram_similarity(F.col("a"), F.col("b")), 6)).filter(F.col("similarity") >= least)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: list[str] | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact nearest vectors; queries are few and stated, or blocked by equal columns."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), *(block or []))
    pairs = vectors.join(q, block) if block else vectors.crossJoin(q)
    hits = pairs.filter(F.col("vec_id") != F.col("query_id")).withColumn("similarity", F.round(Y.cosine(F.col("embedding"), F.col("q")), 6)).filter(F.col("similarity") >= least)
    return top_k(hits.select("query_id", "vec_id", "similarity"), ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 4096, least: float = -1.0, block: list[str] | None = None) -> DataFrame:
    """The rows of nearest(), for many queries: blocks of about so many vectors and of queries meet in pairs, and each pair keeps a query's best k (and ties after rounding).

    block: only vectors and queries that are equal in these columns meet; a value of very many rows is many blocks.
    """
    same = block or []
    n_v, n_q = (max(1, -(-df.count() // rows)) for df in (vectors, queries))
    block_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("vec_id", "embedding", *same, block_of(n_v).alias("v_block"), all_of(n_q).alias("q_block"))
    # columns of their own: in a cogroup, both sides must not share any
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), *[F.col(c).alias(f"{c}__") for c in same], all_of(n_v).alias("v_block__"), block_of(n_q).alias("q_block__"))

    def unit(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
        t = t.filter(pc.equal(pc.list_value_length(t["embedding"]), size))
        m = pc.list_flatten(t["embedding"]).to_numpy().astype(float).reshape(-1, size)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return t["vec_id"].to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        both = left.num_rows and right.num_rows
        if both:
            left, right = (pa.table([t[i], t[e]], ["vec_id", "embedding"]) for t, i, e in ((left, "vec_id", "embedding"), (right, "query_id", "asked")))
        sizes = pc.unique(pc.list_value_length(right["embedding"])).to_pylist() if both else []
        for size in filter(None, sizes):
            (ids, a), (asked, b) = unit(left, size), unit(right, size)
            for i, near in zip(asked, b @ a.T, strict=True):
                near = np.where(ids == i, -np.inf, near)
                least = np.partition(near, -k)[-k] if len(near) > k else -2.0
                take = np.nonzero(near >= max(least - 2e-6, -2.0))[0]
                for part, x in zip(out, (np.full(len(take), i), ids[take], near[take]), strict=True):
                    part.append(x)
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, types, strict=True)], ["query_id", "vec_id", "similarity"])

    keys = [*same, "v_block", "q_block"]
    hits = v.groupBy(*keys).cogroup(q.groupBy(*[f"{c}__" for c in keys])).applyInArrow(best, "query_id long, vec_id long, similarity double")
    return top_k(hits.withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= least), ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)


def fuse(parts: list[tuple[str, DataFrame]], key: list[str], k: int, group: str) -> DataFrame:
    """Hits of several methods, (group, key..., score): the first method that has a key wins it; then the k best of each group."""
    out = None
    for n, (name, df) in enumerate(parts):
        one = df.select(group, *key, "score", F.lit(n).alias("priority"), F.lit(name).alias("method"))
        out = one if out is None else out.unionByName(one)
    first = top_k(out, [group, *key], [F.asc("priority")], 1).drop("rank")
    return top_k(first, [group], [F.desc("score"), F.asc(key[0])], k).drop("priority")


def merged(parts: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """(key, method): what several methods found, once each, under the first method that did."""
    out = None
    for n, (name, df) in enumerate(parts):
        one = df.select(*key, F.struct(F.lit(n), F.lit(name).alias("method")).alias("m"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*key).agg(F.min("m").alias("m")).select(*key, "m.method")
