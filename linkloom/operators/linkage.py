"""Linkage: candidate filters, the matching cascade, contrastive checks, ensembles, resolving and decisions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.scoring import band, expiry_score, match_action, priority
from linkloom.functions.similarity import resolver_similarity
from linkloom.functions.text import normalize_name
from linkloom.operators.relational import top_k
from linkloom.operators.search import trigram_matches


def reject_reason(age_days: Column, most_days: int, same_sender: Column, conc: Column, form: Column) -> Column:
    """The first reason that applies, null if none: stale, same_sender, concentration, form."""
    return F.when(age_days > most_days, "stale").when(same_sender, "same_sender").when(conc, "concentration").when(form, "form")


def candidates(requests: DataFrame, offers: DataFrame, block: list[str], order: list[Column], most: int = 100) -> DataFrame:
    """Pairs of requests and offers of one block: each request meets the block's first `most` active offers, so pairs grow with the requests only."""
    return requests.join(top_k(offers, block, order, most).drop("rank"), block)


def pruned(pairs: DataFrame, hits: DataFrame, group: str, item: str, k: int = 20) -> DataFrame:
    """Pairs whose item is among the k best hits (group, item, score; lower is better) of its group; groups without any hit keep all their pairs."""
    best = top_k(hits.join(pairs.select(group, item).distinct(), [group, item], "left_semi"), [group], [F.asc("score"), F.asc(item)], k).select(group, item, F.lit(True).alias("hit__"))
    some = best.select(group).distinct().withColumn("some__", F.lit(True))
    marked = pairs.join(best, [group, item], "left").join(some, group, "left")
    return marked.filter(F.col("hit__") | F.col("some__").isNull()).drop("hit__", "some__")


def stage_stats(df: DataFrame, stage: str = "stage") -> DataFrame:
    """(stage, n, share) of what each stage decided, nulls as none; stages before the embedding one are deterministic."""
    name = F.when(F.col(stage) == 1, "master").when(F.col(stage) == 2, "embedding").when(F.col(stage) == 3, "fuzzy").otherwise("none")
    g = df.groupBy(name.alias("stage")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # four rows


def new_matches(scored: DataFrame, existing: DataFrame, keys: list[str], score: str, least: float = 0.85, automatic: bool = True) -> DataFrame:
    """(keys, score, status): pairs that score enough, are acted on and don't exist yet; confirmed where the action is automatic."""
    band_of = band(F.col(score))
    action = match_action(band_of, automatic)
    found = scored.filter((F.col(score) >= least) & (band_of != "None") & (action != "Ignore")).join(existing.select(*keys).distinct(), keys, "left_anti")
    return found.select(*keys, score, F.when(action == "AutoConfirm", "CONFIRMED").otherwise("PENDING").alias("status"))


def full_score(parts: dict[str, Column], weights: dict[str, Column | Callable[[Column], Column]], blocked: Column, other_language: Column, days_left: Column, bonus: Column, expiry_weight: float = 0.1, gate: float = 0.7) -> Column:
    """struct(total, band, action): the whole scorer.

    A blocked pair scores 0. The medication's score is the better of both languages, and under the gate all is 0. Expired
    offers score 0, near ones lose up to expiry_weight; a bonus of over 0.001 either way is added; the total stays from 0
    to 1. weights: after tests and warm start, as columns, or as functions of the part: x / 10 and x * 0.1 differ in the
    last bit, which is a band where the total is at its end.
    """
    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a value that is named often is worked out once
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    def held(name: Column) -> Column:
        part = lambda k: F.coalesce(name if k == "medication" else parts[k], F.lit(0.0))
        base = sum((w(part(k)) if callable(w) else part(k) * w for k, w in weights.items()), F.lit(0.0))
        return F.when(name < gate, 0.0).otherwise(within(base))

    def aged(x: Column) -> Column:
        lost = F.greatest(F.lit(0.0), 1 - expiry_score(days_left)) * expiry_weight
        return F.when(days_left < 0, 0.0).otherwise(F.greatest(F.lit(0.0), x - lost))

    def outcome(x: Column) -> Column:
        of = F.when(blocked, "None").otherwise(band(x))
        return F.struct(x.alias("total"), of.alias("band"), F.when(blocked, "Ignore").otherwise(match_action(band(x))).alias("action"))

    moved = lambda x: F.when(blocked, 0.0).when(F.abs(bonus) > 0.001, within(x + bonus)).otherwise(x)
    return let(let(let(let(F.greatest(parts["medication"], other_language), held), aged), moved), outcome)


def contrast_status(enabled: bool, positive: Column, negatives: Column, least: float = 0.7) -> Column:
    """Why a contrastive check is passed over, null where it is made."""
    if not enabled:
        return F.lit("disabled")
    return F.when(positive < least, "below threshold").when(F.coalesce(negatives, F.lit(0)) == 0, "no negatives")


def reviewed(df: DataFrame, status: str, to_approve: list[str]) -> Column:
    """A curation's outcome: pending names in the list are approved, other pending ones stay, rejected ones too."""
    return F.when((F.col(status) == "pending") & F.col("alias").isin(*to_approve), "approved").otherwise(F.col(status))


def filter_stats(df: DataFrame, reason: str = "reason") -> DataFrame:
    r = F.col(reason)
    return df.agg(F.count("*").alias("total"), *[F.count_if(r == k).alias(k) for k in ("stale", "same_sender", "concentration", "form")], F.count_if(r.isNull()).alias("passed")).withColumn("pass_rate", F.round(100.0 * F.col("passed") / F.col("total"), 2))


def first_stage_wins(pairs: DataFrame, group: str, stage: str = "stage") -> DataFrame:
    """Rows of the least non-null stage of each group: later stages count only where earlier ones found nothing."""
    return pairs.filter(F.col(stage).isNotNull()).withColumn("__first", F.min(stage).over(Window.partitionBy(group))).filter(F.col(stage) == F.col("__first")).drop("__first")


def first_priority(df: DataFrame, name: str, priorities: DataFrame, names: list[str]) -> DataFrame:
    """df with its best valid priority, by its normalised name in any of the name columns, the first of them that matches; then the highest level, then the id."""
    ranked = None
    for n, c in enumerate(names):
        one = priorities.withColumns({"k__": normalize_name(F.col(c)), "n__": F.lit(n)})
        ranked = one if ranked is None else ranked.unionByName(one)
    ranked = ranked.withColumn("score", priority(F.col("level")))
    best = top_k(ranked, ["k__"], [F.asc("n__"), F.desc("score"), F.asc("p_partkey")], 1).drop("rank", "n__")
    return df.withColumn("k__", normalize_name(F.col(name))).join(best, "k__").drop("k__")


def cascade(pairs: DataFrame, group: str, same_master: Column, embedding: Column, fuzzy: Column, k: int = 10, tie: Column | None = None) -> DataFrame:
    """Stage and score of each pair: 1 same master (1.0); 2 embedding >= .85, fuzzy >= .7 and .4 e + .6 f >= .75, the k best by embedding; 3 fuzzy >= .75."""
    blended = 0.4 * embedding + 0.6 * fuzzy
    e = pairs.withColumns({"__e": embedding, "__f": fuzzy, "__m": same_master})
    e = e.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("__e"), F.desc("__f"), *([] if tie is None else [tie]))))
    stage = F.when(F.col("__m"), 1).when((F.col("__e") >= 0.85) & (F.col("__rank") <= k) & (F.col("__f") >= 0.7) & (blended >= 0.75), 2).when(F.col("__f") >= 0.75, 3)
    score = F.when(F.col("stage") == 1, 1.0).when(F.col("stage") == 2, blended).otherwise(F.col("__f"))
    return first_stage_wins(e.withColumn("stage", stage).withColumn("score", score), group).drop("__e", "__f", "__m", "__rank")


def steady_mean(x: Column) -> Column:
    """avg(x) that doesn't hang on the order of the rows: multiples of 2^-20 and what is left are summed apart, both without rounding for scores; a group with values of 2^32 and more, NaN or infinite ones has the plain mean."""
    high = F.rint(x * 2.0**20) / 2.0**20
    return F.when(F.max(F.abs(x)) < 2.0**32, (F.sum(high) + F.sum(x - high)) / F.count(x)).otherwise(F.avg(x))


def margins(df: DataFrame, key: list[str], positive: str, negative: str, over_mean: float = 0.15, over_max: float = 0.10) -> DataFrame:
    """(key, positive, mean_negative, max_negative, passed) from one row per match and negative; a mean at the margin's end is the same in each run."""
    g = df.groupBy(*key).agg(F.max(positive).alias("positive"), steady_mean(F.col(negative)).alias("mean_negative"), F.max(negative).alias("max_negative"))
    return g.withColumn("passed", (F.col("positive") - F.col("mean_negative") >= over_mean) & (F.col("positive") - F.col("max_negative") >= over_max))


def sample_negatives(df: DataFrame, group: list[str], key: str, priority: Column, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group: by priority, then in an order fixed by a hash of the key."""
    return top_k(df.withColumn("__p", priority), group, [F.asc("__p"), F.asc(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))), F.asc(key)], k).drop("__p")


def hard_negatives(related: DataFrame, names: DataFrame, name: str, k: int, seed: int = 42) -> DataFrame:
    """(a, b, stage, rank): k negatives of each name: related ones (a, b, stage) by stage, then any others, each in an order fixed by a hash.

    Whatever is related to a name, k others are among the 2 k + 1 names of the least hashes, so only these meet all names.
    """
    order = lambda c: F.md5(F.concat(F.col(c).cast("string"), F.lit(f":{seed}")))
    n = names.select(F.col(name).alias("a")).distinct()
    few = n.select(F.col("a").alias("b")).orderBy(order("b"), "b").limit(2 * k + 1)
    others = n.crossJoin(F.broadcast(few)).filter("a <> b").withColumn("stage", F.lit(2))  # 2 k + 1 rows
    best = related.select("a", "b", "stage").unionByName(others).groupBy("a", "b").agg(F.min("stage").alias("stage"))
    return top_k(best, ["a"], [F.asc("stage"), F.asc(order("b")), F.asc("b")], k)


class Strategy(Protocol):
    """A scorer that can be plugged in: its score is a Column over a frame of pairs; weight 0 turns it off."""

    name: str
    weight: float

    def score(self) -> Column: ...


def plugged(strategies: list[Strategy]) -> Column:
    """ensemble() of strategies."""
    return ensemble({s.name: (s.score(), s.weight) for s in strategies})


def ensemble(strategies: dict[str, tuple[Column, float]]) -> Column:
    """struct(score, top, weakest): the weighted mean over enabled strategies (weight over 0), a missing score counting 0."""
    on = {k: (F.coalesce(c, F.lit(0.0)), w) for k, (c, w) in strategies.items() if w > 0}
    total = sum(w for _, w in on.values())
    parts = F.array(*[F.struct((c * w).alias("share"), F.lit(k).alias("name")) for k, (c, w) in on.items()])
    return F.struct((F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["share"]) / total).alias("score"), F.array_max(parts)["name"].alias("top"), F.array_min(parts)["name"].alias("weakest"))


def ai_score(status: Column, confidence: Column) -> Column:
    return F.when(status == "approved", F.greatest(confidence, F.lit(0.95))).when(status == "flagged", F.least(confidence, F.lit(0.70))).when(status == "rejected", 0.1)


def class_mismatch(a: Column, b: Column, similarity: Column) -> Column:
    both = a.isNotNull() & b.isNotNull() & (a != b)
    one = (a.isNull() != b.isNull()) & (similarity > 0.9)
    return F.coalesce((similarity >= 0.8) & (both | one), F.lit(False))


def decision(blocked: Column, cooling: Column, score: Column, threshold: Column) -> Column:
    return F.when(blocked, "Blocked").when(cooling, "Queued").when(score >= threshold, "Approved").otherwise("Queued")


def threshold_for(category: Column, thresholds: Column, default: float, low: float = 0.70, high: float = 0.99) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.element_at(thresholds, category), F.lit(default))))


def retry_route(error: Column) -> Column:
    return F.when(error.rlike("CircuitBreaker|Network|Timeout"), "retry_later").when(error.rlike("IncompleteJson|ParseError"), "reparse").otherwise("other")


def resolve(names: DataFrame, aliases: DataFrame, masters: DataFrame, approve: float = 0.92, review: float = 0.70, semantic: DataFrame | None = None) -> DataFrame:
    """(name, master, confidence, method, approved) of each distinct name, nulls where nothing fits.

    names: name; aliases: alias, master; masters: master, canonical; semantic: name, master, score, the nearest three.
    In order: an alias (1.0), a canonical name (1.0), the first by name of up to three canonical names that contain the
    name and are similar enough, the first of the semantic ones. Names of three characters or more meet canonical names
    by their first three, shorter ones by all they have, so containment is an equi join with a filter.
    """
    n = names.select("name").filter(F.col("name").isNotNull()).distinct()
    alias = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("master").alias("m"))
    same = masters.groupBy(F.col("canonical").alias("name")).agg(F.min("master").alias("m"))
    grams = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("canonical"), F.lit(1))), lambda i: F.array(*[F.substring(F.col("canonical"), i, F.lit(k)) for k in (1, 2, 3)])))))
    holds = n.withColumn("g", F.substring("name", 1, 3)).join(masters.select("master", "canonical", grams.alias("g")), "g").filter(F.col("canonical").contains(F.col("name")))
    near = top_k(holds.select("name", "master", "canonical").distinct(), ["name"], [F.asc("canonical"), F.asc("master")], 3)
    near = near.withColumn("s", resolver_similarity(F.col("name"), F.col("canonical"))).filter(F.col("s") >= review)
    parts = [(alias, F.lit(1.0), "alias"), (same, F.lit(1.0), "master"), (near.groupBy("name").agg(F.min_by("master", "rank").alias("m"), F.min_by("s", "rank").alias("s")), F.col("s"), "fuzzy")]
    if semantic is not None:
        close = semantic.filter(F.col("score") >= review).groupBy("name").agg(F.max_by("master", "score").alias("m"), F.max("score").alias("s"))
        parts.append((close, F.col("s"), "semantic"))
    hits = None
    for k, (part, confidence, method) in enumerate(parts):
        one = part.select("name", F.struct(F.lit(k).alias("k"), F.col("m").alias("master"), confidence.alias("confidence"), F.lit(method).alias("method")).alias("hit"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.filter("hit.master IS NOT NULL").groupBy("name").agg(F.min("hit").alias("hit"))
    return n.join(best, "name", "left").select("name", "hit.master", "hit.confidence", "hit.method", (F.col("hit.confidence") >= approve).alias("approved"))


def fallback_match(masters: tuple[Column, Column], confidences: tuple[Column, Column], equal: Column, similarity: Column, raw_similarity: Column, embedding: Column | None = None, least: float = 0.70, least_embedding: float = 0.80) -> Column:
    """struct(method, score, high): same master, equal names, .85 names + .15 raw names from `least`, then a kept embedding."""
    score = 0.85 * similarity + 0.15 * raw_similarity
    of = lambda name, s, high: F.struct(F.lit(name).alias("method"), s.alias("score"), high.alias("high"))
    out = F.when(masters[0] == masters[1], of("same_master", (confidences[0] + confidences[1]) / 2, F.lit(True))).when(equal, of("exact", F.lit(1.0), F.lit(True))).when(score >= least, of("fuzzy", score, score >= 0.90))
    if embedding is not None:
        out = out.when(embedding >= least_embedding, of("embedding", embedding, embedding >= 0.90))
    return out.otherwise(of("none", score, F.lit(False)))


def by_strategy(pairs: DataFrame, strategy: str, match: str = "match") -> DataFrame:
    """The pairs that a fallback strategy returns: found ones, all as queued, or none."""
    if strategy == "reject":
        return pairs.filter("false")
    if strategy == "queue":
        return pairs.withColumn(match, F.struct(F.lit("none").alias("method"), F.lit(0.0).alias("score"), F.lit(False).alias("high")))
    if strategy not in ("deterministic", "embeddings"):
        raise ValueError(strategy)
    return pairs.filter(F.col(match)["method"] != "none")


def alias_suggestions(pending: DataFrame, masters: DataFrame, least: float = 0.6) -> DataFrame:
    """(alias, seen, master, similarity): the best canonical name by trigrams of each pending alias, if it reaches `least`."""
    hits = trigram_matches(pending.select(F.col("alias").alias("a")).distinct(), masters.select(F.col("canonical").alias("b")).distinct(), least)
    best = top_k(hits, ["a"], [F.desc("similarity"), F.asc("b")], 1)
    counts = pending.groupBy("alias").agg(F.count("*").alias("seen"))
    return counts.join(best, F.col("alias") == F.col("a")).select("alias", "seen", F.col("b").alias("master"), "similarity")
