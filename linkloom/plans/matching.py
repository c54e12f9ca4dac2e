"""The match path: candidates, filters, dictionaries, search and suggestions, cascades, scores, new matches and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as Y
from linkloom.functions import text as X
from linkloom.operators import linkage as K
from linkloom.operators import relational as R
from linkloom.operators import search as S
from linkloom.plans.adapting import _ASKED, _MASTERS, dictionary
from linkloom.plans.linking import _TOK, _WORD, MEET, NAMES, VEC, names
from linkloom.plans.registry import Tables, query

# candidates: open lines ask, the newest returned lines of the same part offer


_OFFERS = "(SELECT l_partkey, l_orderkey AS offer_order, l_linenumber AS offer_line, l_suppkey AS offer_supplier, l_quantity AS offer_quantity, l_shipdate AS offer_date, l_linestatus AS offer_form, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'R')"
_PAIRS = f"(SELECT q.l_orderkey, q.l_linenumber, o.offer_order, o.offer_line, q.l_quantity AS asked, o.offer_quantity, CASE WHEN date_diff('day', o.offer_date::DATE, DATE '1998-12-01') > 1500 THEN 'stale' WHEN o.offer_supplier = q.l_suppkey THEN 'same_sender' WHEN abs(q.l_quantity - o.offer_quantity) / least(q.l_quantity, o.offer_quantity) * 100 > 50 THEN 'concentration' WHEN q.l_linestatus <> o.offer_form THEN 'form' END AS reason FROM lineitem q JOIN {_OFFERS} o ON o.l_partkey = q.l_partkey AND o.r <= 6 WHERE q.l_returnflag = 'N')"


def pairs(t: Tables) -> DataFrame:
    asked = t.lineitem.filter("l_returnflag = 'N'").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_linestatus")
    c = F.col
    offers = t.lineitem.filter("l_returnflag = 'R'").select("l_partkey", c("l_orderkey").alias("offer_order"), c("l_linenumber").alias("offer_line"), c("l_suppkey").alias("offer_supplier"), c("l_quantity").alias("offer_quantity"), c("l_shipdate").alias("offer_date"), c("l_linestatus").alias("offer_form"))
    both = K.candidates(asked, offers, ["l_partkey"], [F.desc("offer_date"), F.asc("offer_order"), F.asc("offer_line")], 6)
    age = F.datediff(F.lit("1998-12-01").cast("date"), c("offer_date").cast("date"))
    far = F.abs(c("l_quantity") - c("offer_quantity")) / F.least("l_quantity", "offer_quantity") * 100 > 50
    return both.withColumn("reason", K.reject_reason(age, 1500, c("offer_supplier") == c("l_suppkey"), far, c("l_linestatus") != c("offer_form"))).withColumnRenamed("l_quantity", "asked")


@query(f"SELECT l_orderkey, l_linenumber, count(*) AS candidates, count(*) FILTER (reason IS NULL) AS passed, count(*) FILTER (reason = 'stale') AS stale FROM {_PAIRS} GROUP BY 1, 2")
def batch_candidates(t):
    r = F.col("reason")
    return pairs(t).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("candidates"), F.count_if(r.isNull()).alias("passed"), F.count_if(r == "stale").alias("stale"))


@query(f"SELECT offer_order, offer_line, count(*) FILTER (reason IS NULL) AS requests FROM {_PAIRS} GROUP BY 1, 2 HAVING count(*) FILTER (reason IS NULL) > 0")
def requests_for_offers(t):
    return pairs(t).filter("reason IS NULL").groupBy("offer_order", "offer_line").agg(F.count("*").alias("requests"))


@query(f"SELECT l_orderkey, l_linenumber, offer_order, offer_line, score, CASE WHEN score >= 0.9 THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM (SELECT *, round(least(asked, offer_quantity) / greatest(asked, offer_quantity), 6) AS score FROM {_PAIRS} WHERE reason IS NULL) WHERE score >= 0.85 AND (l_orderkey + offer_order) % 7 <> 0")
def match_creation(t):
    scored = pairs(t).filter("reason IS NULL").withColumn("score", F.round(F.least("asked", "offer_quantity") / F.greatest("asked", "offer_quantity"), 6))
    keys = ["l_orderkey", "l_linenumber", "offer_order", "offer_line"]
    there = pairs(t).filter((F.col("l_orderkey") + F.col("offer_order")) % 7 == 0).select(*keys)
    return K.new_matches(scored, there, keys, "score")


# the cascade: a shared first word is a shared master, BM25 prunes


_TEXT_PAIRS = f"(SELECT a.p_name AS a, b.p_name AS b FROM {NAMES} a JOIN {NAMES} b ON a.p_name <> b.p_name)"
_HITS = f"""WITH w AS (SELECT p_name AS doc_id, unnest({_TOK.replace('text', 'p_name')}) AS word FROM {NAMES}), p AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1),
    g AS (SELECT count(*) AS n, avg(len) AS a FROM l), f AS (SELECT word, count(*) AS df FROM p GROUP BY 1), q AS (SELECT DISTINCT p_name AS item_id, unnest({_TOK.replace('text', 'p_name')}) AS word FROM {NAMES}),
    s AS (SELECT item_id, doc_id, round(-sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN p USING (word) JOIN f USING (word) JOIN l USING (doc_id), g GROUP BY ALL),
    top AS (SELECT item_id AS a, doc_id AS b, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS r FROM s WHERE score < -1.0) WHERE r <= 21),
    h AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score, b) AS r FROM top WHERE a <> b AND {MEET})"""


@query(f"""{_HITS}, k AS (SELECT a, b FROM h WHERE r <= 20), pr AS (SELECT a, b FROM {_TEXT_PAIRS} x WHERE {MEET} AND (EXISTS (SELECT 1 FROM k WHERE k.a = x.a AND k.b = x.b) OR NOT EXISTS (SELECT 1 FROM k WHERE k.a = x.a))),
    e AS (SELECT a, b, CASE WHEN split_part(a, ' ', 2) = split_part(b, ' ', 2) THEN 0.9 ELSE 0.1 END AS e, jaro_winkler_similarity(a, b) AS f, split_part(a, ' ', 1) = split_part(b, ' ', 1) AND length(a) = length(b) AS m FROM pr),
    rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY e DESC, f DESC, b) AS rank FROM e),
    st AS (SELECT a, b, CASE WHEN m THEN 1 WHEN e >= 0.85 AND rank <= 10 AND f >= 0.7 AND 0.4 * e + 0.6 * f >= 0.75 THEN 2 WHEN f >= 0.75 THEN 3 END AS stage, e, f FROM rk)
    SELECT a, b, stage, round(CASE stage WHEN 1 THEN 1 WHEN 2 THEN 0.4 * e + 0.6 * f ELSE f END, 6) AS score FROM (SELECT *, min(stage) OVER (PARTITION BY a) AS first FROM st WHERE stage IS NOT NULL) WHERE stage = first""")
def text_search_match(t):
    return cascade(t).select("a", "b", "stage", F.round("score", 6).alias("score"))


def cascade(t: Tables) -> DataFrame:
    """Names against names: the candidates of each share letters with it; BM25 leaves twenty of them, or all where it finds none."""
    n = names(t)
    met = S.name_candidates(n)
    every = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hits = S.bm25(n, "p_name", "p_name", n.select(F.col("p_name").alias("a"), F.col("p_name").alias("text")), "a", "text", 21).select("a", F.col("p_name").alias("b"), "score")
    few = K.pruned(every, hits.filter("a <> b"), "a", "b", 20)
    a, b = F.col("a"), F.col("b")
    part = lambda c, i: F.split_part(c, F.lit(" "), F.lit(i))
    meant = F.when(part(a, 2) == part(b, 2), 0.9).otherwise(0.1)  # an embedding's similarity comes as a column
    return K.cascade(few, "a", (part(a, 1) == part(b, 1)) & (F.length(a) == F.length(b)), meant, Y.jaro_winkler(a, b), tie=F.asc("b"))


# dictionaries


_MESSAGES = "(SELECT p_partkey, 'want ' || p_name || ' of ' || lower(p_type) AS text FROM part)"


def messages(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("want "), "p_name", F.lit(" of "), F.lower("p_type")).alias("text"))


def masters(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("master")).agg(F.col("p_name").alias("english"), F.min("p_type").alias("arabic"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("ingredient"))


_DICT = "(SELECT p_name AS master, p_name AS english, lower(min(p_type)) AS arabic, split_part(p_name, ' ', 2) AS ingredient FROM part GROUP BY 1)"


@query(f"SELECT p_partkey, master, CASE WHEN contains(text, english) THEN 'english' WHEN contains(text, arabic) THEN 'arabic' ELSE 'ingredient' END AS method FROM {_MESSAGES} JOIN {_DICT} ON contains(text, english) OR contains(text, arabic) OR contains(text, ingredient)")
def dictionary_hits(t):
    return S.dictionary_hits(messages(t), "p_partkey", "text", masters(t), "master", ["english", "arabic", "ingredient"])


@query(f"SELECT count(DISTINCT p_partkey) AS messages, count(DISTINCT master) AS relevant, (SELECT count(*) FROM {_DICT}) AS masters, round(1 - count(DISTINCT master) / (SELECT count(*) FROM {_DICT}), 6) AS reduction FROM (SELECT * FROM {_MESSAGES} WHERE p_partkey % 50 = 0) JOIN {_DICT} ON contains(text, english)")
def rag_filter(t):
    hits = S.holding(messages(t).filter("p_partkey % 50 = 0"), "p_partkey", "text", masters(t).select("master", "english"), "english")
    g = hits.agg(F.countDistinct("p_partkey").alias("messages"), F.countDistinct("master").alias("relevant")).crossJoin(masters(t).agg(F.count("*").alias("masters")))  # one row
    return g.withColumn("reduction", F.round(1 - F.col("relevant") / F.col("masters"), 6))


_LIKE = "list_slice(list_filter(string_split(lower(text), ' '), lambda w: strlen(w) >= 3), 1, 20)"


@query(f"SELECT DISTINCT item_id, p_name FROM (SELECT item_id, unnest({_LIKE}) AS word FROM benchmark) JOIN {NAMES} ON contains(lower(p_name), word)")
def keyword_filter(t):
    words = F.slice(F.filter(F.split(F.lower("text"), " "), lambda w: F.octet_length(w) >= 3), 1, 20)
    asked = t.benchmark.select("item_id", F.explode(words).alias("word"))
    return S.holding(names(t).withColumn("low", F.lower("p_name")), "p_name", "low", asked, "word").select("item_id", "p_name").distinct()


@query(f"SELECT lower(p_name) AS name, list_sort(list(DISTINCT p_name)) AS names, split_part(p_name, ' ', 2) AS canonical FROM {NAMES} GROUP BY 1, 3")
def synonym_map(t):
    return names(t).groupBy(F.lower("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("canonical")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))


@query(f"SELECT a.p_name AS a, b.p_name AS b FROM {NAMES} a JOIN {NAMES} b ON a.p_name < b.p_name AND split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)")
def synonym_pairs(t):
    n = names(t).select("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("canonical"))
    return n.select("canonical", F.col("p_name").alias("a")).join(n.select("canonical", F.col("p_name").alias("b")), "canonical").filter("a < b").select("a", "b")


@query("SELECT key, arg_max(canonical, p_partkey * 3 + kind) AS canonical FROM (SELECT p_partkey, 0 AS kind, p_name AS key, p_name AS canonical FROM part UNION ALL SELECT p_partkey, 1, p_type, p_name FROM part UNION ALL SELECT p_partkey, 2, p_brand, p_name FROM part) GROUP BY 1")
def mapping_table(t):
    sides = [t.part.select("p_partkey", F.lit(k).alias("kind"), F.col(c).alias("key"), F.col("p_name").alias("canonical")) for k, c in enumerate(("p_name", "p_type", "p_brand"))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("key").agg(F.max_by("canonical", F.col("p_partkey") * 3 + F.col("kind")).alias("canonical"))  # the last write wins


# validity and priority


_PRIORITY = "(SELECT lower(p_name) AS name, p_type AS arabic, ['Low', 'Medium', 'High', 'Urgent', 'Critical'][1 + p_size % 5] AS level, TIMESTAMP '1998-01-01' + INTERVAL (p_size) DAY AS begins, CASE WHEN p_size % 3 > 0 THEN TIMESTAMP '1998-01-01' + INTERVAL (p_size * 2) DAY END AS ends, p_partkey FROM part WHERE p_size % 4 <> 1)"


def priorities(t: Tables) -> DataFrame:
    day = lambda n: F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=n)
    levels = F.array(*map(F.lit, ("Low", "Medium", "High", "Urgent", "Critical")))
    return t.part.filter("p_size % 4 <> 1").select(F.lower("p_name").alias("name"), F.col("p_type").alias("arabic"), F.element_at(levels, F.col("p_size") % 5 + 1).alias("level"), day(F.col("p_size")).alias("begins"), F.when(F.col("p_size") % 3 > 0, day(F.col("p_size") * 2)).alias("ends"), "p_partkey")


@query(f"SELECT p_partkey, name, level FROM {_PRIORITY} WHERE level <> 'Low' AND begins <= TIMESTAMP '1998-02-01' AND (ends IS NULL OR ends > TIMESTAMP '1998-02-01')")
def validity_interval(t):
    return R.active_at(priorities(t), "begins", "ends", "1998-02-01", F.col("level") != "Low").select("p_partkey", "name", "level")


@query(f"SELECT n.p_name, p.p_partkey AS priority_id, p.score FROM {NAMES} n JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, p_partkey) AS r FROM (SELECT *, CASE level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 3 WHEN 'High' THEN 5 WHEN 'Urgent' THEN 8 ELSE 10 END AS score FROM {_PRIORITY} WHERE begins <= TIMESTAMP '1998-02-01' AND (ends IS NULL OR ends > TIMESTAMP '1998-02-01'))) p ON p.name = lower(trim(n.p_name)) AND p.r = 1")
def priority_join(t):
    valid = R.active_at(priorities(t), "begins", "ends", "1998-02-01")
    return K.first_priority(names(t), "p_name", valid, ["name"]).select("p_name", F.col("p_partkey").alias("priority_id"), "score")


# search and suggestions


@query(f"""WITH m AS (SELECT p_name AS q FROM {NAMES} WHERE p_name < 'l'), n AS (SELECT p_name, min(p_partkey) AS id, min(p_type) AS kind FROM part GROUP BY 1),
    x AS (SELECT q, id, p_name, {_WORD.format('q')} AS g, {_WORD.format('p_name')} AS h, {_WORD.format('kind')} AS k, kind FROM m, n),
    s AS (SELECT q, id, p_name, kind, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS a, round(len(list_intersect(g, k)) / len(list_distinct(list_concat(g, k))), 6) AS b FROM x),
    f AS (SELECT q, id, greatest(a, b) AS score, (a >= 0.3 AND contains(lower(p_name), lower(q))) OR (b >= 0.3 AND contains(lower(kind), lower(q))) AS l FROM s WHERE greatest(a, b) >= 0.3)
    SELECT q, id, CASE WHEN l THEN 'like' ELSE 'trigram' END AS method, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM f) WHERE rank <= 5""")
def trigram_topk(t):
    n = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("kind"))
    return S.trigram_topk(names(t).filter("p_name < 'l'").select(F.col("p_name").alias("q")), n, ["p_name", "kind"])


_GRAMS3 = "list_distinct(flatten(list_transform(list_filter({0}, lambda w: length(w) >= {1}), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"


@query(f"""WITH b AS (SELECT item_id, list_distinct({_TOK}) AS ws FROM benchmark), n AS (SELECT p_name, list_distinct({_TOK.replace('text', 'p_name')}) AS ws FROM {NAMES}),
    j AS (SELECT item_id, p_name, list_has_any(b.ws, n.ws) AS exact, list_has_any({_GRAMS3.format('b.ws', 4)}, {_GRAMS3.format('n.ws', 3)}) AS fuzzy FROM b, n)
    SELECT item_id, p_name, CASE WHEN exact THEN 'exact' ELSE 'fuzzy' END AS method FROM j WHERE exact OR fuzzy""")
def fts_search(t):
    return S.exact_then_fuzzy(t.benchmark, "item_id", "text", names(t), "p_name")


@query(f"""WITH m AS ({_MASTERS}), n AS ({_ASKED}), x AS (SELECT name, master, canonical, {_WORD.format('name')} AS g, {_WORD.format('canonical')} AS h FROM n, m),
    p AS (SELECT name, master, 0 AS k, 'semantic' AS method, 0.75::DOUBLE AS score FROM n JOIN m ON split_part(name, ' ', 1) = split_part(canonical, ' ', 1)
        UNION ALL SELECT name, master, 1, 'trigram', round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) FROM x WHERE round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) >= 0.3
        UNION ALL SELECT name, master, 2, 'like', 0.6 FROM x WHERE contains(canonical, name)),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, master ORDER BY k) AS r FROM p) WHERE r = 1)
    SELECT name, master, method, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, master)::INT AS rank FROM f) WHERE rank <= 5""")
def suggest_fusion(t):
    asked, _, known = dictionary(t)
    head = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    semantic = asked.withColumn("w", head("name")).join(known.withColumn("w", head("canonical")), "w").select("name", "master", F.lit(0.75).alias("score"))  # as a column, embeddings aren't made here
    near = S.trigram_matches(asked.select(F.col("name").alias("a")), known.select(F.col("canonical").alias("b")), 0.3).join(known, F.col("b") == F.col("canonical")).select(F.col("a").alias("name"), "master", F.col("similarity").alias("score"))
    like = S.holding(known, "master", "canonical", asked, "name").select("name", "master", F.lit(0.6).alias("score"))
    return S.fuse([("semantic", semantic), ("trigram", near), ("like", like)], ["master"], 5, "name").select("name", "master", "method", "score", "rank")


@query(f"""WITH q AS (SELECT item_id, unnest(list_distinct({_TOK})) AS word FROM benchmark), k AS (SELECT DISTINCT item_id, p_name FROM q JOIN {NAMES} ON list_contains({_TOK.replace('text', 'p_name')}, word)),
    n AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1),
    v AS (SELECT item_id, p_name FROM (SELECT item_id, p_name, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(e.v, f.v), 6) DESC, n.id) AS r FROM benchmark JOIN {VEC} e ON e.vec_id = item_id, n JOIN {VEC} f ON f.vec_id = n.id) WHERE r <= 3)
    SELECT item_id, p_name, 'keyword' AS method FROM k UNION ALL SELECT item_id, p_name, 'vector' FROM v WHERE (item_id, p_name) NOT IN (SELECT item_id, p_name FROM k)""")
def hybrid_candidates(t):
    keyword = S.exact_then_fuzzy(t.benchmark, "item_id", "text", names(t), "p_name").filter("method = 'exact'").select("item_id", "p_name")
    known = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("vec_id"))
    v = t.embeddings.join(known, "vec_id").select("vec_id", "embedding")
    far = 1_000_000  # items' vectors have ids of their own, as a vector doesn't meet itself
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select((F.col("vec_id") + far).alias("vec_id"), "embedding")
    vector = S.nearest_in_blocks(v, q, 3).join(known, "vec_id").select((F.col("query_id") - far).alias("item_id"), "p_name")
    return S.merged([("keyword", keyword), ("vector", vector)], ["item_id", "p_name"])


@query(f"SELECT a.vec_id, b.vec_id AS earlier, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND b.vec_id * 30 < a.vec_id * 30 AND b.vec_id * 30 >= a.vec_id * 30 - 600 WHERE round(list_cosine_similarity(a.v, b.v), 6) > 0.2")
def semantic_dups(t):
    d = t.embeddings.withColumn("at", F.col("vec_id") * 30)
    return S.semantic_repeats(d, "vec_id", "label", "at", "embedding", 600, 0.2)


# scores, checks, curation


@query("""SELECT l_orderkey, l_linenumber, round(total, 6) AS total, CASE WHEN blocked THEN 'None' WHEN total >= 0.9 THEN 'Auto' WHEN total >= 0.7 THEN 'Suggest' WHEN total >= 0.5 THEN 'Review' ELSE 'None' END AS band, CASE WHEN blocked THEN 'Ignore' WHEN total >= 0.7 THEN 'Suggest' WHEN total >= 0.5 THEN 'Queue' ELSE 'Ignore' END AS action FROM (
    SELECT *, CASE WHEN blocked THEN 0 WHEN abs(bonus) > 0.001 THEN least(1, greatest(0, aged + bonus)) ELSE aged END AS total FROM (
    SELECT *, CASE WHEN days < 0 THEN 0 WHEN days <= 30 THEN greatest(0, held - (1 - days / 30.0) * 0.1) ELSE held END AS aged FROM (
    SELECT l_orderkey, l_linenumber, l_suppkey % 40 = 0 AS blocked, l_partkey % 300 - 5 AS days, (l_linenumber - 4) * 0.02 AS bonus, CASE WHEN greatest(l_quantity / 50, l_discount * 10) < 0.7 THEN 0 ELSE least(1, 0.6 * greatest(l_quantity / 50, l_discount * 10) + 0.3 * (1 - l_tax) + 0.1 * (l_suppkey % 10) / 10) END AS held FROM lineitem)))""")
def full_scorer(t):
    c = F.col
    parts = {"medication": c("l_quantity") / 50, "pharmaceutical": 1 - c("l_tax"), "recency": c("l_suppkey") % 10 / 10}
    s = K.full_score(parts, {"medication": F.lit(0.6), "pharmaceutical": F.lit(0.3), "recency": lambda x: x / 10}, c("l_suppkey") % 40 == 0, c("l_discount") * 10, c("l_partkey") % 300 - 5, (c("l_linenumber") - 4) * 0.02)
    return t.lineitem.select("l_orderkey", "l_linenumber", s.alias("x")).select("l_orderkey", "l_linenumber", F.round("x.total", 6).alias("total"), "x.band", "x.action")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN greatest(l_quantity / 50, 0.95) WHEN 'A' THEN least(l_quantity / 50, 0.7) ELSE 0.1 END AS score FROM lineitem")
def ai_scores(t):
    status = F.when(F.col("l_returnflag") == "R", "approved").when(F.col("l_returnflag") == "A", "flagged").otherwise("rejected")
    return t.lineitem.select("l_orderkey", "l_linenumber", K.ai_score(status, F.col("l_quantity") / 50).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 50 >= 0.8 AND ((a IS NOT NULL AND b IS NOT NULL AND a <> b) OR ((a IS NULL) <> (b IS NULL) AND l_quantity / 50 > 0.9)) AS mismatch FROM (SELECT *, nullif(l_returnflag, 'A') AS a, CASE WHEN l_linenumber < 5 THEN CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END END AS b FROM lineitem)")
def class_mismatches(t):
    a = F.nullif(F.col("l_returnflag"), F.lit("A"))
    b = F.when(F.col("l_linenumber") < 5, F.when(F.col("l_linestatus") == "F", "R").otherwise("N"))
    return t.lineitem.select("l_orderkey", "l_linenumber", K.class_mismatch(a, b, F.col("l_quantity") / 50).alias("mismatch"))


@query("SELECT event_id, CASE WHEN regexp_matches(m, 'CircuitBreaker|Network|Timeout') THEN 'retry_later' WHEN regexp_matches(m, 'IncompleteJson|ParseError') THEN 'reparse' ELSE 'other' END AS route FROM (SELECT event_id, ['CircuitBreaker open', 'Network down', 'Timeout', 'IncompleteJson at 5', 'ParseError', 'odd'][1 + event_id % 6] AS m FROM events)")
def retry_routes(t):
    errors = F.array(*map(F.lit, ("CircuitBreaker open", "Network down", "Timeout", "IncompleteJson at 5", "ParseError", "odd")))
    return t.events.select("event_id", K.retry_route(F.element_at(errors, (F.col("event_id") % 6 + 1).cast("int"))).alias("route"))


@query("SELECT o_orderkey, CASE WHEN s < 0.7 THEN 'below threshold' WHEN n = 0 THEN 'no negatives' END AS skipped, CASE WHEN s >= 0.7 AND n > 0 THEN CASE WHEN s - mean >= 0.15 AND s - top >= 0.10 THEN 'passed' ELSE 'failed' END ELSE 'skipped' END AS outcome FROM (SELECT o_orderkey, any_value(o_orderkey % 100 / 100.0) AS s, count(l_orderkey) AS n, avg(l_quantity / 50) AS mean, max(l_quantity / 50) AS top FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 4 GROUP BY 1)")
def contrastive_checks(t):
    neg = t.lineitem.filter("l_linenumber > 4").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), K.steady_mean(F.col("l_quantity") / 50).alias("mean"), F.max(F.col("l_quantity") / 50).alias("top"))
    d = t.orders.select("o_orderkey").distinct().withColumn("s", F.col("o_orderkey") % 100 / 100.0).join(neg, "o_orderkey", "left")
    skipped = K.contrast_status(True, F.col("s"), F.col("n"))
    passed = (F.col("s") - F.col("mean") >= 0.15) & (F.col("s") - F.col("top") >= 0.10)
    return d.select("o_orderkey", skipped.alias("skipped"), F.when(skipped.isNotNull(), "skipped").when(passed, "passed").otherwise("failed").alias("outcome"))


@query(f"""WITH n AS (SELECT p_name, split_part(p_name, ' ', 1) AS c, {_WORD.format('p_name')} AS g FROM {NAMES}),
    p AS (SELECT a.p_name AS a, b.p_name AS b, CASE WHEN a.c = b.c THEN 0 WHEN len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.3 THEN 1 ELSE 2 END AS k FROM n a JOIN n b ON a.p_name <> b.p_name)
    SELECT a, b, k AS stage, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY k, md5(b || ':42'), b)::INT AS rank FROM p) WHERE rank <= 8""")
def spelled_negatives(t):
    n = names(t)
    alike = S.trigram_matches(n.select(F.col("p_name").alias("a")), n.select(F.col("p_name").alias("b")), 0.3).select("a", "b", F.lit(1).alias("like"))
    head = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    met = alike.filter("a <> b").withColumn("stage", F.lit(1)).select("a", "b", "stage")
    w = n.withColumn("w", head("p_name"))
    same = w.select("w", F.col("p_name").alias("a")).join(w.select("w", F.col("p_name").alias("b")), "w").filter("a <> b").select("a", "b", F.lit(0).alias("stage"))
    return K.hard_negatives(met.unionByName(same), n, "p_name", 8)


@query("""SELECT l_partkey AS part, l_suppkey AS supplier, coalesce(severity, 'none') AS severity FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) LEFT JOIN (SELECT least(o_custkey % 200, o_orderkey % 100) AS a, greatest(o_custkey % 200, o_orderkey % 100) AS b, min(CASE WHEN o_orderstatus = 'P' THEN 'critical' ELSE 'high' END) AS severity FROM orders GROUP BY ALL) ON a = least(l_partkey, l_suppkey) AND b = greatest(l_partkey, l_suppkey)""")
def blocklist_probe(t):
    pairs_ = t.lineitem.select("l_partkey", "l_suppkey").distinct().select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), *R.pair_key(F.col("l_partkey"), F.col("l_suppkey")))
    listed = t.orders.select(*R.pair_key(F.col("o_custkey") % 200, F.col("o_orderkey") % 100), F.when(F.col("o_orderstatus") == "P", "critical").otherwise("high").alias("severity")).groupBy("pair_a", "pair_b").agg(F.min("severity").alias("severity"))
    return pairs_.join(listed, ["pair_a", "pair_b"], "left").select("part", "supplier", F.coalesce("severity", F.lit("none")).alias("severity"))


@query(f"SELECT strategy, count(*) AS n FROM (SELECT unnest(['deterministic', 'queue', 'reject', 'embeddings']) AS strategy) JOIN (SELECT a.p_name AS a, b.p_name AS b, jaro_winkler_similarity(a.p_name, b.p_name) AS s FROM {NAMES} a JOIN {NAMES} b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_name < b.p_name) ON strategy = 'queue' OR strategy IN ('deterministic', 'embeddings') AND (s >= 0.843 OR strategy = 'embeddings' AND length(a) = length(b)) GROUP BY 1")
def fallback_strategies(t):
    n = names(t).withColumn("w", F.split_part("p_name", F.lit(" "), F.lit(1)))
    p = n.select("w", F.col("p_name").alias("a")).join(n.select("w", F.col("p_name").alias("b")), "w").filter("a < b")
    none, s = F.lit(None).cast("int"), Y.jaro_winkler(F.col("a"), F.col("b"))
    out = None
    for strategy in ("deterministic", "queue", "reject", "embeddings"):
        kept = F.when(F.length("a") == F.length("b"), 0.85) if strategy == "embeddings" else None
        m = p.withColumn("match", K.fallback_match((none, none), (F.lit(0.9), F.lit(0.9)), F.col("a") == F.col("b"), s, s, embedding=kept, least=0.843))
        one = K.by_strategy(m, strategy).groupBy(F.lit(strategy).alias("strategy")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT alias, n, CASE WHEN status = 'pending' AND alias LIKE 'blue%' THEN 'approved' ELSE status END AS status, CASE WHEN alias LIKE 'blue%' THEN master END AS master FROM (SELECT lower(p_name) AS alias, count(*) AS n, CASE WHEN count(*) % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status, min(p_partkey) AS master FROM part GROUP BY 1)")
def curation_bulk(t):
    d = t.part.groupBy(F.lower("p_name").alias("alias")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("m")).withColumn("status", F.when(F.col("n") % 3 == 0, "rejected").otherwise("pending"))
    wanted = d.filter(F.col("alias").startswith("blue")).select(F.col("alias").alias("k"), F.col("m").alias("v"))
    linked = R.filled_from(d.withColumn("master", F.lit(None).cast("bigint")), "master", F.col("alias"), wanted)
    return linked.select("alias", "n", F.when((F.col("status") == "pending") & F.col("master").isNotNull(), "approved").otherwise(F.col("status")).alias("status"), "master")


@query(f"SELECT name AS stage, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM (SELECT CASE WHEN l_quantity >= 45 THEN 'master' WHEN l_quantity >= 35 THEN 'embedding' WHEN l_quantity >= 30 THEN 'fuzzy' ELSE 'none' END AS name FROM lineitem) GROUP BY 1")
def stage_stats(t):
    q = F.col("l_quantity")
    return K.stage_stats(t.lineitem.select(F.when(q >= 45, 1).when(q >= 35, 2).when(q >= 30, 3).alias("stage")))


@query(f"SELECT a, b, round(jaro_winkler_similarity(a, b), 8) AS similarity FROM (SELECT a.p_name AS a, b.p_name AS b FROM {NAMES} a JOIN {NAMES} b ON a.p_name < b.p_name) WHERE round(jaro_winkler_similarity(a, b), 8) >= 0.8")
def similar_spellings(t):
    return S.name_candidates(names(t)).select("a", "b", F.round(Y.jaro_winkler(F.col("a"), F.col("b")), 8).alias("similarity")).filter("similarity >= 0.8")


@query("SELECT c_custkey, c_name, CASE WHEN regexp_matches(c_name, '^[0-9+ -]+$') OR contains(c_name, '@') THEN 'participant' ELSE 'text' END AS kind FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '+20 ' || c_custkey || '-7' WHEN 2 THEN c_custkey || '@g.us' ELSE lower(c_mktsegment) END AS c_name FROM customer)")
def search_dispatch(t):
    k, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    q = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("+20 "), key, F.lit("-7"))).when(k == 2, F.concat(key, F.lit("@g.us"))).otherwise(F.lower("c_mktsegment"))
    return t.customer.select("c_custkey", q.alias("c_name")).withColumn("kind", X.search_kind(F.col("c_name")))
