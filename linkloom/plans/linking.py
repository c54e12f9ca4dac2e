"""Scalar functions, similarity, search, linkage and learning on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.functions import scoring as Z
from linkloom.functions import similarity as Y
from linkloom.functions import text as X
from linkloom.operators import learning as L
from linkloom.operators import linkage as K
from linkloom.operators import relational as R
from linkloom.operators import search as S
from linkloom.plans.registry import query

NOW = "1998-12-01 12:34:56"
NAMES = "(SELECT DISTINCT p_name FROM part)"
#: Pairs that share two letters in a row, or the first one.
MEET = "(substr(a, 1, 1) = substr(b, 1, 1) OR list_has_any(list_transform(range(1, length(a)), lambda i: substr(a, i, 2)), list_transform(range(1, length(b)), lambda i: substr(b, i, 2))))"
PAIRS = f"(SELECT a.p_name AS a, b.p_name AS b FROM {NAMES} a JOIN {NAMES} b ON a.p_name < b.p_name)"


def names(t):
    return t.part.select("p_name").distinct()


# recency, expiry, bands


AGE = "floor((epoch(TIMESTAMP '1998-12-01 12:34:56') - floor(epoch(o_orderdate))) / 60) / 60.0"


@query(f"SELECT o_orderkey, round(CASE WHEN h <= 0 THEN 1 ELSE pow(0.5, h / 72) END, 8) AS exponential, round(CASE WHEN h <= 0 THEN 1 ELSE greatest(0, 1 - h / 40000) END, 8) AS linear, round(CASE WHEN h <= 0 THEN 1 WHEN h >= 80000 THEN 0.1 ELSE greatest(0.1, sqrt(1 - h / 80000)) END, 8) AS root FROM (SELECT o_orderkey, {AGE} AS h FROM orders)")
def recency_scores(t):
    h = Z.age_hours(F.col("o_orderdate"), F.lit(NOW))
    return t.orders.select("o_orderkey", F.round(Z.recency(h), 8).alias("exponential"), F.round(Z.recency(h, 20000.0, "linear"), 8).alias("linear"), F.round(Z.recency(h, 20000.0, "root"), 8).alias("root"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN d < 0 THEN 0 WHEN d <= 30 THEN d / 30.0 ELSE 1 END, 8) AS score, d >= 180 AS shelf FROM (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1995-06-17', l_shipdate::DATE) AS d FROM lineitem)")
def expiry_scores(t):
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-06-17").cast("date"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(Z.expiry_score(d), 8).alias("score"), Z.enough_shelf_life(d, 180).alias("shelf"))


def _zone(name: str, low: float, high: float, upper: bool) -> str:
    w = f"({high - low}::DOUBLE * 0.1)"
    up, down = f"(({high} - s) / {w})", f"((s - {low}) / {w})"
    up, down = f"({up} * {up} * (3 - 2 * {up}))", f"({down} * {down} * (3 - 2 * {down}))"
    lower = f"CASE WHEN s - {low} < {w} THEN [round({low} + (s - {low}) * {down}, 6), round({down}, 6)] ELSE [round(s, 6), 1.0] END"
    return f"CASE WHEN {high} - s < {w} THEN [round(s + ({high} - s) * (1 - {up}) * 0.5, 6), round({up}, 6)] ELSE {lower} END" if upper else lower


_UP = "((0.5 - s) / 0.05)"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.9 THEN 'Auto' WHEN s >= 0.7 THEN 'Suggest' WHEN s >= 0.5 THEN 'Review' ELSE 'None' END AS band, x[1] AS confidence, x[2] AS strength FROM (
    SELECT *, CASE WHEN s >= 0.9 THEN {_zone('Auto', 0.9, 1.0, False)} WHEN s >= 0.7 THEN {_zone('Suggest', 0.7, 0.9, True)} WHEN s >= 0.5 THEN {_zone('Review', 0.5, 0.7, True)}
        ELSE CASE WHEN 0.5 - s < 0.05 AND s > 0 THEN [round(s * {_UP} * {_UP} * (3 - 2 * {_UP}), 6), round({_UP} * {_UP} * (3 - 2 * {_UP}), 6)] ELSE [round(s, 6), 1.0] END END AS x
    FROM (SELECT l_orderkey, l_linenumber, ((floor(l_extendedprice)::BIGINT % 997) / 997.0)::DOUBLE AS s FROM lineitem))""")
def smooth_bands(t):
    s = t.lineitem.select("l_orderkey", "l_linenumber", (F.pmod(F.floor("l_extendedprice"), F.lit(997)) / 997.0).alias("s"))
    return s.withColumn("b", Z.smooth_band(F.col("s"))).select("l_orderkey", "l_linenumber", "b.band", F.round("b.confidence", 6).alias("confidence"), F.round("b.strength", 6).alias("strength"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.9 THEN 'AutoConfirm' WHEN s >= 0.7 THEN 'Suggest' WHEN s >= 0.5 THEN 'Queue' ELSE 'Ignore' END AS action, CASE WHEN s >= 0.6 THEN 'Accept' WHEN s >= 0.5 THEN 'QueueForReview' ELSE 'Reject' END AS parsed FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s FROM lineitem)")
def actions(t):
    s = F.col("l_quantity") / 50
    return t.lineitem.select("l_orderkey", "l_linenumber", Z.match_action(Z.band(s), True).alias("action"), Z.parse_action(s).alias("parsed"))


@query("SELECT p_partkey, n::DOUBLE AS value, u AS unit, n * f AS mg FROM (SELECT p_partkey, p_size AS n, CASE p_size % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'mcg' ELSE 'g' END AS u, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 ELSE 1000.0 END AS f FROM part)")
def concentration_parse(t):
    unit = F.element_at(F.array(F.lit(" mg"), F.lit(" mcg"), F.lit("g")), (F.col("p_size") % 3 + 1).cast("int"))
    c = Z.concentration(F.concat(F.translate(F.col("p_size").cast("string"), *reversed(X.DIGITS)), unit))
    return t.part.withColumn("c", c).select("p_partkey", "c.value", "c.unit", "c.mg")


FORM = "['tablet', 'syrup', 'ampoule', 'gel', 'unknown']"


@query(f"""SELECT p_partkey, CASE WHEN a = b THEN 0.0 WHEN least(a, b) || greatest(a, b) = 'ampouletablet' THEN 0.8 WHEN least(a, b) || greatest(a, b) = 'syruptablet' THEN 0.7 WHEN least(a, b) || greatest(a, b) = 'ampoulesyrup' THEN 0.8 WHEN least(a, b) || greatest(a, b) = 'geltablet' THEN 0.8 ELSE 0.3 END AS penalty
    FROM (SELECT p_partkey, {FORM}[1 + p_size % 5] AS a, {FORM}[1 + p_partkey % 5] AS b FROM part)""")
def form_compat(t):
    forms = F.array(*map(F.lit, ("tablet", "Syrup", "AMP", "gel", "unknown")))
    at = lambda c: F.element_at(forms, (F.col(c) % 5 + 1).cast("int"))
    return t.part.select("p_partkey", Z.form_penalty(at("p_size"), at("p_partkey")).alias("penalty"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0.0, (1 - CASE WHEN d > 50 THEN 1 WHEN d > 20 THEN 0.3 + (d - 20) / 30 * 0.7 ELSE 0 END)), 6) AS pharma, round(CASE WHEN m < 0.7 THEN 0 ELSE least(1, 0.6 * m + 0.2 * greatest(0.0, (1 - CASE WHEN d > 50 THEN 1 WHEN d > 20 THEN 0.3 + (d - 20) / 30 * 0.7 ELSE 0 END)) + 0.1 * l_discount * 10) END, 6) AS total
    FROM (SELECT l_orderkey, l_linenumber, l_discount, l_quantity / 50 AS m, CASE WHEN l_quantity = p_size THEN 0 ELSE abs(l_quantity - p_size) / least(l_quantity, p_size) * 100 END AS d FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def match_score_full(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    none = F.lit(None).cast("string")
    pharma = Z.pharma_score(F.col("l_quantity"), F.col("p_size").cast("double"), none, none)
    total = Z.match_score({"medication": F.col("l_quantity") / 50, "pharmaceutical": pharma, "recency": F.col("l_discount") * 10})
    return j.select("l_orderkey", "l_linenumber", F.round(pharma, 6).alias("pharma"), F.round(total, 6).alias("total"))


# tokens and similarity


@query("SELECT item_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(translate(text, chr(10) || ',.-', '    ')), '\\s+'), lambda w: length(w) > 2))) AS tokens FROM benchmark")
def text_tokens(t):
    return t.benchmark.select("item_id", X.tokens(F.col("text")).alias("tokens"))


@query(f"SELECT p_name, list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)) AS grams FROM {NAMES} WHERE length(p_name) >= 3")
def name_trigrams(t):
    return names(t).filter(F.length("p_name") >= 3).select("p_name", X.trigrams(F.col("p_name")).alias("grams"))


@query("SELECT item_id, array_to_string(list_transform(list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(translate(substr(text, 1, 10000), chr(10) || ',.-', '    ')), '\\s+'), lambda w: length(w) > 2))), 1, 50), lambda w: '\"' || translate(w, '\"''*()^:+-~', '') || '\"'), ' OR ') AS q FROM benchmark")
def fts_exact_query(t):
    return t.benchmark.select("item_id", X.exact_query(F.col("text")).alias("q"))


@query(f"SELECT a, b, round(jaro_winkler_similarity(a, b), 8) AS jw, levenshtein(a, b) AS edits, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 8) AS resolver FROM {PAIRS} WHERE {MEET}")
def name_similarities(t):
    a, b = F.col("a"), F.col("b")
    return S.name_candidates(names(t)).select("a", "b", F.round(Y.jaro_winkler(a, b), 8).alias("jw"), F.levenshtein(a, b).cast("long").alias("edits"), F.round(Y.resolver_similarity(a, b), 8).alias("resolver"))


GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(f"SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 8) AS similarity FROM (SELECT a, b, {GRAMS.format('a')} AS x, {GRAMS.format('b')} AS y FROM {PAIRS} WHERE {MEET})")
def ngram_names(t):
    return S.name_candidates(names(t)).select("a", "b", F.round(Y.ngram_similarity(F.col("a"), F.col("b")), 8).alias("similarity"))


_SOUND = "(SELECT upper(substr(w, 1, 1)) || rpad(substr(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), ''), 1 + length(translate(substr(w, 1, 1), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556')), 3), 3, '0') FROM (SELECT w, string_split(translate(substr(w, 1, 1), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556') || translate(substr(w, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556'), '') AS c FROM (SELECT regexp_replace(upper({0}), '[^A-Z]', '', 'g') AS w)))"


@query(f"""WITH n AS (SELECT p_name, {_SOUND.format('p_name')} AS z, {GRAMS.format('p_name')} AS g FROM {NAMES}),
    p AS (SELECT a.p_name AS a, b.p_name AS b, jaro_winkler_similarity(a.p_name, b.p_name) AS jw, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS gr, len(list_filter([1, 2, 3, 4], lambda i: substr(a.z, i, 1) = substr(b.z, i, 1))) / 4.0::DOUBLE AS ph FROM n a JOIN n b ON a.p_name < b.p_name)
    SELECT a, b, round(greatest(0.5 * jw + 0.3 * gr + 0.2 * ph, jw), 6) AS similarity FROM p WHERE round(greatest(0.5 * jw + 0.3 * gr + 0.2 * ph, jw), 6) >= 0.7 AND {MEET}""")
def med_similarity(t):
    return S.name_candidates(names(t)).select("a", "b", F.round(Y.medication_similarity(F.col("a"), F.col("b")), 6).alias("similarity")).filter("similarity >= 0.7")


_WORD = "list_distinct(flatten(list_transform(list_filter(string_split(lower({0}), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"SELECT a, b, s AS similarity FROM (SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS s FROM (SELECT a, b, {_WORD.format('a')} AS x, {_WORD.format('b')} AS y FROM {PAIRS})) WHERE s >= 0.3")
def similar_pairs(t):
    n = names(t)
    return S.trigram_matches(n.select(F.col("p_name").alias("a")), n.select(F.col("p_name").alias("b")), 0.3).filter("a < b")


# vectors and search


VEC = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.v, q.v), 6) DESC, e.vec_id)::INT AS rank FROM {VEC} e JOIN {VEC} q ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def cosine_topk(t):
    return S.nearest_in_blocks(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), 10)


@query(f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.v, q.v), 6) DESC, e.vec_id)::INT AS rank FROM {VEC} e JOIN {VEC} q ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def cosine_neighbours(t):
    return S.nearest_in_blocks(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), 5)


@query(f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.v, q.v), 6) DESC, e.vec_id)::INT AS rank FROM {VEC} e JOIN {VEC} q ON e.vec_id <> q.vec_id AND e.label = q.label WHERE q.vec_id % 20 = 0 AND round(list_cosine_similarity(e.v, q.v), 6) >= 0.1) WHERE rank <= 3")
def knn_per_group(t):
    return S.nearest_in_blocks(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), 3, least=0.1, block=["label"])


_TOK = "list_filter(regexp_split_to_array(lower(translate(text, chr(10) || ',.-', '    ')), '\\s+'), lambda w: length(w) > 2)"


@query(f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents), p AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1),
    g AS (SELECT count(*) AS n, avg(len) AS a FROM l), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest({_TOK}) AS word FROM benchmark),
    s AS (SELECT item_id, doc_id, round(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN p USING (word) JOIN f USING (word) JOIN l USING (doc_id), g GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id)::INT AS rank FROM s WHERE score < -1.0) WHERE rank <= 5""")
def bm25_topk(t):
    return S.bm25(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 5)


@query("SELECT DISTINCT p_name, r_name FROM (SELECT DISTINCT p_name FROM part) JOIN (SELECT 'almond' AS r_name UNION ALL SELECT 'green' UNION ALL SELECT 'red') ON contains(lower(p_name), r_name)")
def dictionary_substring(t):
    words = t.spark.createDataFrame([("almond",), ("green",), ("red",)], "r_name string")
    return names(t).join(F.broadcast(words), F.lower("p_name").contains(F.col("r_name")))  # three stated words


# linkage and learning


@query("SELECT count(*) AS total, count(*) FILTER (r = 'stale') AS stale, count(*) FILTER (r = 'same_sender') AS same_sender, count(*) FILTER (r = 'concentration') AS concentration, count(*) FILTER (r = 'form') AS form, count(*) FILTER (r IS NULL) AS passed, round(100.0 * count(*) FILTER (r IS NULL) / count(*), 2) AS pass_rate FROM (SELECT CASE WHEN date_diff('day', l_shipdate::DATE, DATE '1998-12-01') > 1500 THEN 'stale' WHEN l_suppkey = l_partkey THEN 'same_sender' WHEN l_quantity > 40 THEN 'concentration' WHEN l_linestatus = 'F' THEN 'form' END AS r FROM lineitem)")
def candidate_filter_stats(t):
    age = F.datediff(F.lit("1998-12-01").cast("date"), F.col("l_shipdate").cast("date"))
    reason = K.reject_reason(age, 1500, F.col("l_suppkey") == F.col("l_partkey"), F.col("l_quantity") > 40, F.col("l_linestatus") == "F")
    return K.filter_stats(t.lineitem.select(reason.alias("reason")))


@query(f"""WITH p AS (SELECT a, b, jaro_winkler_similarity(a, b) AS f FROM (SELECT a.p_name AS a, b.p_name AS b FROM {NAMES} a JOIN {NAMES} b ON a.p_name <> b.p_name)),
    s AS (SELECT *, CASE WHEN split_part(a, ' ', 1) = split_part(b, ' ', 1) THEN 1 WHEN f >= 0.75 THEN 3 END AS stage FROM p)
    SELECT a, b, stage, round(CASE WHEN stage = 1 THEN 1 ELSE f END, 6) AS score FROM (SELECT *, min(stage) OVER (PARTITION BY a) AS m FROM s WHERE stage IS NOT NULL) WHERE stage = m""")
def hierarchical_match(t):
    n = names(t)
    met = S.name_candidates(n)
    pairs = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    head = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    out = K.cascade(pairs, "a", head(F.col("a")) == head(F.col("b")), F.lit(None).cast("double"), Y.jaro_winkler(F.col("a"), F.col("b")))
    return out.select("a", "b", "stage", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, mx AS positive, round(mean, 6) AS mean_negative, low AS max_negative, mx - mean >= 0.15 AND mx - low >= 0.10 AS passed FROM (SELECT l_orderkey AS o_orderkey, 0.9 AS mx, avg(l_quantity / 50) AS mean, max(l_quantity / 50) AS low FROM lineitem GROUP BY 1)")
def contrastive_margin(t):
    d = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(0.9).alias("p"), (F.col("l_quantity") / 50).alias("n"))
    return K.margins(d, ["o_orderkey"], "p", "n").withColumn("mean_negative", F.round("mean_negative", 6))


@query("SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size < 5 THEN 0 ELSE 1 END, md5(p_partkey::VARCHAR || ':42'), p_partkey)::INT AS rank FROM part) WHERE rank <= 3")
def hard_negatives(t):
    return K.sample_negatives(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", F.when(F.col("p_size") < 5, 0).otherwise(1), 3).select("p_brand", "p_partkey", "rank")


@query("SELECT l_orderkey, l_linenumber, round((0.55 * e + 0.3 * f + 0.05 * h + 0.05 * r) / 0.95, 6) AS score, list_sort([{'s': e * 0.55::DOUBLE, 'n': 'embedding'}, {'s': f * 0.3::DOUBLE, 'n': 'fuzzy'}, {'s': h * 0.05::DOUBLE, 'n': 'historical'}, {'s': r * 0.05::DOUBLE, 'n': 'recency'}])[4].n AS top, list_sort([{'s': e * 0.55::DOUBLE, 'n': 'embedding'}, {'s': f * 0.3::DOUBLE, 'n': 'fuzzy'}, {'s': h * 0.05::DOUBLE, 'n': 'historical'}, {'s': r * 0.05::DOUBLE, 'n': 'recency'}])[1].n AS weakest FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS e, l_discount * 10 AS f, l_tax * 10 AS h, 0.5 AS r FROM lineitem)")
def ensemble_score(t):
    c = K.ensemble({"embedding": (F.col("l_quantity") / 50, 0.55), "fuzzy": (F.col("l_discount") * 10, 0.30), "historical": (F.col("l_tax") * 10, 0.05), "recency": (F.lit(0.5), 0.05), "ai": (F.lit(1.0), 0.0)})
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(c["score"], 6).alias("score"), c["top"].alias("top"), c["weakest"].alias("weakest"))


@query("SELECT user_id, CASE WHEN a + r + f = 0 OR greatest(a, r, f) / (a + r + f) < 0.67 THEN 'Flagged' WHEN a = greatest(a, r, f) THEN 'Approved' WHEN r = greatest(a, r, f) THEN 'Rejected' ELSE 'Flagged' END AS verdict FROM (SELECT user_id, count(*) FILTER (value > 15) AS a, count(*) FILTER (value <= 5) AS r, count(*) FILTER (value > 5 AND value <= 15) AS f FROM events GROUP BY 1)")
def consensus_vote(t):
    v = F.col("value")
    g = t.events.groupBy("user_id").agg(F.count_if(v > 15).alias("a"), F.count_if(v <= 5).alias("r"), F.count_if((v > 5) & (v <= 15)).alias("f"))
    return g.select("user_id", L.vote(F.col("a"), F.col("r"), F.col("f")).alias("verdict"))


SCORE = "(SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS s, quality = 1 AS ok, toxic FROM documents JOIN labels USING (doc_id))"


def feedback(t):
    return t.documents.select("doc_id", (F.col("n_chars") % 1000 / 1000.0).alias("s")).join(t.labels, "doc_id").withColumn("ok", F.col("quality") == 1)


@query(f"SELECT least(floor(s / (1.0::DOUBLE / 10))::INT, 9) AS bin, count(*) AS n, count(*) FILTER (ok) AS positives, round(avg(s), 8) AS mean_score, round(count(*) FILTER (ok) / count(*), 8) AS rate FROM {SCORE} GROUP BY 1")
def calibration_bins(t):
    return L.bins(feedback(t), F.col("s"), F.col("ok")).withColumns({"mean_score": F.round("mean_score", 8), "rate": F.round("rate", 8)})


@query(f"SELECT round(sum(n * abs(m - r)) / sum(n), 6) AS ece, round(max(abs(m - r)), 6) AS mce FROM (SELECT count(*) AS n, avg(s) AS m, count(*) FILTER (ok) / count(*) AS r FROM {SCORE} GROUP BY least(floor(s / (1.0::DOUBLE / 10))::INT, 9))")
def ece_mce(t):
    return L.calibration_error(L.bins(feedback(t), F.col("s"), F.col("ok")))


@query(f"SELECT doc_id, round(CASE WHEN n >= 20 THEN 0.8 * r + 0.2 * s ELSE s END, 6) AS calibrated FROM (SELECT *, count(*) OVER w AS n, (count(*) FILTER (ok) OVER w) / count(*) OVER w AS r FROM {SCORE} WINDOW w AS (PARTITION BY least(floor(s / (1.0::DOUBLE / 10))::INT, 9)))")
def calibrate_scores(t):
    d = feedback(t)
    return L.calibrated(d, "s", L.bins(d, F.col("s"), F.col("ok"))).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


_F = "SELECT '{0}' AS factor, coalesce(avg(CASE WHEN ok THEN {1} END), 0) AS c, coalesce(avg(CASE WHEN NOT ok THEN {1} END), 0) AS r FROM f"
_FACTORS = f"WITH f AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c, l_returnflag = 'R' AS ok FROM lineitem), g AS ({_F.format('medication', 'a')} UNION ALL {_F.format('recency', 'b')} UNION ALL {_F.format('ai', 'c')}), h AS (SELECT factor, c, r, CASE WHEN greatest(c, r) = 0 THEN 0 ELSE (c - r) / greatest(c, r) END AS k FROM g)"


def factors(t):
    d = t.lineitem.select((F.col("l_quantity") / 50).alias("medication"), (F.col("l_discount") * 10).alias("recency"), (F.col("l_tax") * 10).alias("ai"), (F.col("l_returnflag") == "R").alias("ok"))
    return L.factor_stats(d, ["medication", "recency", "ai"], F.col("ok"))


@query(_FACTORS + " SELECT factor, round(c, 6) AS avg_confirmed, round(r, 6) AS avg_rejected, round(k, 6) AS correlation FROM h")
def factor_correlation(t):
    return factors(t).select("factor", *[F.round(c, 6).alias(c) for c in ("avg_confirmed", "avg_rejected", "correlation")])


@query(_FACTORS + ", w AS (SELECT * FROM (VALUES ('medication', 0.6), ('recency', 0.1), ('ai', 0.3)) AS x(factor, weight)), m AS (SELECT factor, weight::DOUBLE AS weight, weight * (1 + 5.0 * k) AS moved FROM w JOIN h USING (factor)), n AS (SELECT factor, weight, least(0.7, greatest(0.05, CASE WHEN abs(moved - weight) < 0.02 THEN weight ELSE moved END)) AS held FROM m) SELECT factor, weight, round(held / sum(held) OVER (), 6) AS new_weight FROM n")
def weight_update(t):
    w = t.spark.createDataFrame([("medication", 0.6), ("recency", 0.1), ("ai", 0.3)], "factor string, weight double")
    return L.new_weights(factors(t), w, rate=5.0)


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 10) AS confirmed, round(list_reduce(list(value > 10 ORDER BY ts, event_id), lambda a, x: CASE WHEN x THEN least(1.0::DOUBLE, a + 0.1) ELSE greatest(0.0::DOUBLE, a - 0.15) END, 0.5::DOUBLE), 6) AS affinity FROM events GROUP BY 1, 2")
def affinity_fold(t):
    return L.affinity(t.events, ["user_id", "event_type"], "ts", "event_id", F.col("value") > 10).withColumn("affinity", F.round("affinity", 6))


@query("WITH g AS (SELECT user_id % 10 < 5 AS arm, count(*) AS n, count(*) FILTER (value > 10) AS k, sum(floor(value * 10000)::BIGINT)::BIGINT AS total FROM events GROUP BY 1), x AS (SELECT a.n AS n1, a.k AS k1, b.n AS n2, b.k AS k2, (a.k + b.k) / (a.n + b.n) AS p FROM g a, g b WHERE a.arm AND NOT b.arm), z AS (SELECT *, (k2 / n2 - k1 / n1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM x), e AS (SELECT *, abs(z) / sqrt(2.0) AS u, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z) SELECT n1, k1, n2, k2, round(z, 6) AS z, round(2 * (1 - 0.5 * (1 + (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-u * u)))), 6) AS p FROM e")
def ab_test_result(t):
    arm = F.col("user_id") % 10 < 5
    hit = F.col("value") > 10
    g = t.events.agg(F.count_if(arm).alias("n1"), F.count_if(arm & hit).alias("k1"), F.count_if(~arm).alias("n2"), F.count_if(~arm & hit).alias("k2"))
    test = L.two_proportions(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return g.select("n1", "k1", "n2", "k2", F.round(test["z"], 6).alias("z"), F.round(test["p"], 6).alias("p"))


@query("SELECT event_id, round(recent, 6) AS recent, round(before, 6) AS before, coalesce(n >= 20 AND before > 0 AND (before - recent) / before > 0.2, false) AS drop FROM (SELECT event_id, avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent, avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS before, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def confidence_drop(t):
    return L.rolling(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("recent", 6).alias("recent"), F.round("before", 6).alias("before"), "drop")


@query("SELECT event_id, count(*) OVER w AS events_24h, count(*) FILTER (value > 15) OVER w AS overrides FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def override_rate_24h(t):
    e = t.events.withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, 0)
    return e.select("event_id", F.count("*").over(w).alias("events_24h"), F.count(F.when(F.col("value") > 15, 1)).over(w).alias("overrides"))


@query("SELECT event_id, (sum(h) OVER (PARTITION BY user_id, g ORDER BY ts, event_id))::BIGINT AS run FROM (SELECT *, sum(1 - h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (value > 10)::INT AS h FROM events))")
def consecutive_runs(t):
    return L.runs(t.events, ["user_id"], ["ts", "event_id"], F.col("value") > 10).select("event_id", "run")


_MEAN = "list_avg(a.h)"
_DEV = f"sqrt(list_avg(list_transform(a.h, lambda v: (v - {_MEAN}) * (v - {_MEAN}))))"


@query(f"""SELECT unnest(ids) AS event_id, unnest(o) AS outlier FROM (SELECT list(event_id ORDER BY ts, event_id) AS ids, list_reduce(list(value ORDER BY ts, event_id),
    lambda a, x: CASE WHEN len(a.h) >= 20 AND {_DEV} > 0 AND abs(x - {_MEAN}) / {_DEV} > 2.5 THEN {{'h': a.h, 'o': list_append(a.o, true)}} ELSE {{'h': CASE WHEN len(a.h) >= 100 THEN list_append(a.h[2:], x) ELSE list_append(a.h, x) END, 'o': list_append(a.o, false)}} END,
    {{'h': []::DOUBLE[], 'o': []::BOOLEAN[]}}).o AS o FROM events GROUP BY user_id)""")
def outlier_rolling(t):
    return L.outliers(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "outlier")


@query("""SELECT conv_id, unnest(ts) AS turn, unnest(o) AS batch FROM (SELECT conv_id, list(turn ORDER BY turn) AS ts, list_reduce(list(n ORDER BY turn),
    lambda a, x: CASE WHEN a.c > 0 AND (a.u + x > 300 OR a.c >= 10) THEN {'k': a.k + 1, 'u': x, 'c': 1::BIGINT, 'o': list_append(a.o, a.k + 1)} ELSE {'k': a.k, 'u': a.u + x, 'c': a.c + 1, 'o': list_append(a.o, a.k)} END,
    {'k': 0::BIGINT, 'u': 0::BIGINT, 'c': 0::BIGINT, 'o': []::BIGINT[]}).o AS o FROM (SELECT conv_id, turn, ceil(strlen(text) / 3.0)::BIGINT AS n FROM conversations) GROUP BY 1)""")
def token_batches(t):
    c = t.conversations.select("conv_id", "turn", X.token_estimate(F.col("text")).cast("long").alias("n"))
    return L.token_batches(c, ["conv_id"], ["turn"], "n", budget=300).select("conv_id", "turn", "batch")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 = 0 THEN 'Blocked' WHEN l_tax > 0.07 THEN 'Queued' WHEN l_quantity / 50 >= least(0.99, greatest(0.70, CASE l_returnflag WHEN 'R' THEN 0.95 WHEN 'A' THEN 0.5 ELSE 0.85 END)) THEN 'Approved' ELSE 'Queued' END AS decision FROM lineitem")
def auto_decision(t):
    limit = K.threshold_for(F.col("l_returnflag"), X.mapping({"R": 0.95, "A": 0.5}), 0.85)
    return t.lineitem.select("l_orderkey", "l_linenumber", K.decision(F.col("l_suppkey") % 50 == 0, F.col("l_tax") > 0.07, F.col("l_quantity") / 50, limit).alias("decision"))


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS pair_a, greatest(l_suppkey, l_partkey) AS pair_b FROM lineitem")
def pair_keys(t):
    return t.lineitem.select(*R.pair_key(F.col("l_suppkey"), F.col("l_partkey"))).distinct()


@query("SELECT p.pair_a, p.pair_b, c.pair_a IS NOT NULL AS cooling FROM (SELECT DISTINCT least(l_suppkey, l_partkey) AS pair_a, greatest(l_suppkey, l_partkey) AS pair_b FROM lineitem) p LEFT JOIN (SELECT DISTINCT least(o_custkey, o_orderkey % 100) AS pair_a, greatest(o_custkey, o_orderkey % 100) AS pair_b FROM orders WHERE o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1996-01-01') c USING (pair_a, pair_b)")
def pair_cooldowns(t):
    """The pairs of all lines, probed against pairs that cool down for a year from an order on."""
    pairs = t.lineitem.select(*R.pair_key(F.col("l_suppkey"), F.col("l_partkey"))).distinct()
    cooling = t.orders.filter("o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1996-01-01'").select(*R.pair_key(F.col("o_custkey"), F.col("o_orderkey") % 100))
    return R.probe(pairs, cooling, "cooling")
