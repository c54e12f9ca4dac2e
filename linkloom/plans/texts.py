"""Text, similarity and scoring functions, JSON in and out, gates of learning: each over a table or a list of stated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import json_beam, json_repair
from linkloom.functions import scoring as Z
from linkloom.functions import similarity as Y
from linkloom.functions import text as X
from linkloom.operators import learning as L
from linkloom.operators import search as S
from linkloom.plans.linking import _FACTORS, _TOK, GRAMS, MEET, PAIRS, SCORE, factors, feedback, names
from linkloom.plans.registry import query

#: Stated texts: marks, letters to unify, digits, doses, spellings, blanks.
TEXTS = ["أَوجمنتين 500 ملغ", "Panadol  Extra 500mg ", "اوغ منتين", "صضطظحعق", "Ibuprofen 200 mg tablet", "", "بنادول إكسترا ١٠٠", "a-b,c.d", "مختلط mixed نص", "123 456", "كونكور", "اوغمنتين", "ASPIRIN plus"]
_T = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(TEXTS)) + ") AS v(id, x))"


def texts(t):
    return t.spark.createDataFrame(list(enumerate(TEXTS)), "id int, x string")


def _tr(c: str, pair: tuple[str, str]) -> str:
    return f"translate({c}, '{pair[0]}', '{pair[1]}')"


def _arabic(c: str) -> str:
    return _tr(c, (X.UNIFIED[0] + X.MARKS, X.UNIFIED[1]))


_DOSE = X.DOSE.replace("(?iU)", "(?i)")


def _plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({_arabic(c)}), '{_DOSE}', ''), '\\s+', ' ', 'g'))"


_SPELLED = "CASE replace({0}, ' ', '') " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, vs in X.SPELLINGS.items() for v in vs.split()) + " ELSE replace({0}, ' ', '') END"
_AR = "[\\x{0600}-\\x{06FF}]"
_SHARE = f"len(regexp_extract_all(x, '{_AR}')) / len(regexp_extract_all(x, '\\p{{L}}'))"


@query(f"""SELECT id, {_arabic('x')} AS arabic, regexp_matches(x, '{_AR}') AS has_arabic, {_tr(_arabic('x'), X.SOUND)} AS sound, {_plain('x')} AS matching, {_tr(_arabic(_plain('x')), X.SOUND)} AS matching_sound, {_SPELLED.format(_arabic('x'))} AS canonical, {_tr('lower(trim(x))', X.DIGITS)} AS alias,
    trim(regexp_replace(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key, regexp_replace(lower(trim(x)), '\\s+', ' ', 'g') AS name,
    CASE WHEN len(regexp_extract_all(x, '\\p{{L}}')) = 0 THEN 'unknown' WHEN {_SHARE} > 0.7 THEN 'arabic' WHEN {_SHARE} < 0.3 THEN 'english' ELSE 'mixed' END AS language FROM {_T}""")
def normalized_texts(t):
    x = F.col("x")
    return texts(t).select("id", X.normalize_arabic(x).alias("arabic"), X.contains_arabic(x).alias("has_arabic"), X.phonetic_key(x).alias("sound"), X.normalize_for_matching(x).alias("matching"), X.normalize_for_phonetic_matching(x).alias("matching_sound"), X.canonical_name(x).alias("canonical"), X.normalize_alias(x).alias("alias"), X.normalize_key(x).alias("key"), X.normalize_name(x).alias("name"), X.language(x).alias("language"))


_JID = "(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_custkey || '@s.whatsapp.net' WHEN 1 THEN c_custkey || '@g.us' WHEN 2 THEN c_name WHEN 3 THEN '@g.us' WHEN 4 THEN c_custkey || '@example.org' ELSE 'a@b@lid' END AS j FROM customer)"


@query(f"SELECT c_custkey, len(string_split(j, '@')) = 2 AND split_part(j, '@', 1) <> '' AND split_part(j, '@', 2) IN ('s.whatsapp.net', 'g.us', 'lid') AS valid, ends_with(j, '@g.us') AS is_group, CASE WHEN strpos(j, '@') > 1 THEN split_part(j, '@', 1) ELSE '' END AS phone, repeat('*', greatest(length(j) - 4, 0)) || substr(j, greatest(length(j) - 4, 0) + 1) AS masked, substr(j, 1, 8) AS short, CASE WHEN length(j) > 10 THEN substr(j, 1, 7) || '...' ELSE j END AS cut FROM {_JID}")
def chat_addresses(t):
    k, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    j = F.when(k == 0, F.concat(key, F.lit("@s.whatsapp.net"))).when(k == 1, F.concat(key, F.lit("@g.us"))).when(k == 2, F.col("c_name")).when(k == 3, "@g.us").when(k == 4, F.concat(key, F.lit("@example.org"))).otherwise("a@b@lid")
    d = t.customer.select("c_custkey", j.alias("j"))
    j = F.col("j")
    return d.select("c_custkey", X.valid_chat(j).alias("valid"), X.is_group_chat(j).alias("is_group"), X.phone_of(j).alias("phone"), X.masked(j).alias("masked"), X.short_id(j).alias("short"), X.truncated(j, 10).alias("cut"))


_G4 = "list_sort(list_distinct(flatten(list_transform(list_slice(list_filter(list_sort(list_distinct({0})), lambda w: length(w) >= 4), 1, 20), lambda w: list_transform(range(1, length(translate(w, '\"''*()^:+-~', '')) - 1), lambda i: substr(translate(w, '\"''*()^:+-~', ''), i, 3))))))"


@query(f"SELECT item_id, array_to_string(list_transform({_G4.format(_TOK.replace('text', 'substr(text, 1, 10000)'))}, lambda g: '\"' || g || '\"'), ' OR ') AS q FROM benchmark")
def fts_fuzzy_query(t):
    return t.benchmark.select("item_id", X.fuzzy_query(F.col("text")).alias("q"))


_SOUNDEX = "(SELECT CASE WHEN w = '' THEN '0000' ELSE substr(w, 1, 1) || rpad(substr(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), ''), 1 + length(translate(substr(w, 1, 1), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556')), 3), 3, '0') END FROM (SELECT w, string_split(translate(substr(w, 1, 1), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556') || translate(substr(w, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556'), '') AS c FROM (SELECT regexp_replace(upper({0}), '[^A-Z]', '', 'g') AS w)))"


@query(f"SELECT p_name, {_SOUNDEX.format('p_name')} AS soundex FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT c_mktsegment, {_SOUNDEX.format('c_mktsegment')} FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT x, {_SOUNDEX.format('x')} FROM (SELECT unnest(['Tymczak', 'Pfister', 'Ashcraft', '', '77']) AS x)")
def soundex_names(t):
    all_ = names(t).union(t.customer.select("c_mktsegment").distinct()).union(t.spark.createDataFrame([(x,) for x in ("Tymczak", "Pfister", "Ashcraft", "", "77")], "p_name string"))
    return all_.select("p_name", Y.soundex(F.col("p_name")).alias("soundex"))


_PH = "len(list_filter([1, 2, 3, 4], lambda i: substr(x, i, 1) = substr(y, i, 1))) / 4.0::DOUBLE"


@query(f"""WITH p AS (SELECT a, b, {_SOUNDEX.format('a')} AS x, {_SOUNDEX.format('b')} AS y, {GRAMS.format('a')} AS g, {GRAMS.format('b')} AS h, jaro_winkler_similarity(a, b) AS jw FROM {PAIRS} WHERE {MEET}), s AS (SELECT a, b, jw, {_PH} AS ph, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS gr FROM p),
    r AS (SELECT *, greatest(0.5 * jw + 0.3 * gr + 0.2 * ph, jw) AS parsed, jw AS raw FROM s)
    SELECT a, b, ph AS phonetic, round((0.5 * jw + 0.25 * gr + 0.5 * ph) / 1.25, 6) AS weighted, round(CASE WHEN raw < 0.3 THEN raw * 0.5 WHEN raw < 0.5 THEN least(sqrt(parsed * raw), raw + 0.1) ELSE 0.4 * parsed + 0.6 * raw END, 6) AS held, round(least(1, jw + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.1 ELSE 0 END), 6) AS ensemble FROM r""")
def similarity_variants(t):
    a, b = F.col("a"), F.col("b")
    return S.name_candidates(names(t)).select("a", "b", Y.phonetic_similarity(a, b).alias("phonetic"), F.round(Y.weighted_similarity(a, b, (0.5, 0.25, 0.5)), 6).alias("weighted"), F.round(Y.with_raw(Y.medication_similarity(a, b), Y.jaro_winkler(a, b)), 6).alias("held"), F.round(Y.ensemble_similarity(a, b), 6).alias("ensemble"))


#: Letters in pairs that sound alike or not, for distances; in SQL they become ASCII first, as its distances count bytes.
_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهويء"
_ASCII = "abtQjHKdDrzsSOPTZEGfqklmnhwyA"
_ALIKE_ASCII = tuple("".join(_ASCII[_LETTERS.index(c)] for c in side) for side in Y.ALIKE)
WORDS = ["بنادول", "بندول", "اوجمنتين", "اوغمنتين", "بروفين", "برفين", "كونكور", "قونكور", "صبرا", "سبرا"]
_W = "(SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) AS w)"


@query(f"""WITH p AS (SELECT a.w AS a, b.w AS b, translate(a.w, '{_LETTERS}', '{_ASCII}') AS x, translate(b.w, '{_LETTERS}', '{_ASCII}') AS y, translate({_tr('a.w', X.SOUND)}, '{_LETTERS}', '{_ASCII}') AS u, translate({_tr('b.w', X.SOUND)}, '{_LETTERS}', '{_ASCII}') AS v FROM {_W} a, {_W} b WHERE a.w < b.w),
    d AS (SELECT *, levenshtein(translate(x, '{_ALIKE_ASCII[0]}', '{_ALIKE_ASCII[1]}'), translate(y, '{_ALIKE_ASCII[0]}', '{_ALIKE_ASCII[1]}')) AS edits, jaro_winkler_similarity(u, v) AS sound FROM p)
    SELECT a, b, edits, round(greatest(1 - edits / greatest(length(x), length(y)), sound), 6) AS similarity, round(sound, 6) AS phonetic FROM d""")
def arabic_similarities(t):
    w = t.spark.createDataFrame([(x,) for x in WORDS], "w string")
    p = w.select(F.col("w").alias("a")).crossJoin(w.select(F.col("w").alias("b"))).filter("a < b")  # ten stated words
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", Y.arabic_edit_distance(a, b).cast("long").alias("edits"), F.round(Y.arabic_similarity(a, b), 6).alias("similarity"), F.round(Y.arabic_phonetic_similarity(a, b), 6).alias("phonetic"))


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(Y.vector_distance(F.col("embedding"), F.col("b")), 6).alias("distance"))


# scores


@query("SELECT o_orderkey, round(CASE WHEN h <= 0 THEN 1 ELSE pow(0.5, h / CASE o_orderpriority WHEN '1-URGENT' THEN 24 WHEN '2-HIGH' THEN 1 ELSE 72 END) END, 8) AS recency, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 10 ELSE 1 END AS priority FROM (SELECT *, floor((epoch(TIMESTAMP '1998-12-01') - floor(epoch(o_orderdate))) / 60) / 60.0 / 100 AS h FROM orders)")
def category_recency(t):
    life = Z.half_life(F.col("o_orderpriority"), {"1-URGENT": 24.0, "2-HIGH": 0.5})
    h = Z.age_hours(F.col("o_orderdate"), F.lit("1998-12-01")) / 100
    level = F.when(F.col("o_orderpriority") == "2-HIGH", "Critical").when(F.col("o_orderpriority") == "1-URGENT", "Low")
    return t.orders.select("o_orderkey", F.round(F.when(h <= 0, 1.0).otherwise(F.pow(F.lit(0.5), h / life)), 8).alias("recency"), Z.priority(level).alias("priority"))


@query("SELECT l_orderkey, l_linenumber, round(a / (a + b + c), 8) AS wa, round(c / (a + b + c), 8) AS wc, a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AND abs(a + b + c - 1) <= 0.1 AS valid, round(a * 0.5, 8) AS share, 'Med:' || CASE WHEN q / 50 * 100 = floor(q / 50 * 100) THEN (q / 50 * 100)::BIGINT ELSE round_even(q / 50 * 100, 0)::BIGINT END || '%' AS shown FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount AS b, l_tax AS c, l_quantity AS q FROM lineitem)")
def weight_shares(t):
    a, b, c = F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")
    w = Z.normalized_weights([a, b, c])
    parts = Z.breakdown({"name": (a, F.lit(0.5)), "rest": (b, F.lit(0.5))})
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(w[0], 8).alias("wa"), F.round(w[2], 8).alias("wc"), Z.weights_valid([a, b, c], 0.1).alias("valid"), F.round(parts[0]["share"], 8).alias("share"), Z.percent_text(a, "Med").alias("shown"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN r < 0.5 THEN 0 WHEN r > 1 THEN 1 ELSE r END AS fulfilment, CASE WHEN u < 0.5 THEN 'test' ELSE 'control' END AS arm FROM (SELECT l_orderkey, l_linenumber, l_quantity / p_size AS r, ('0x' || substr(md5(l_suppkey::VARCHAR || ':weights'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM lineitem JOIN part ON p_partkey = l_partkey)")
def fulfilment_and_arms(t):
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.select("l_orderkey", "l_linenumber", Z.fulfilment(F.col("l_quantity"), F.col("p_size")).alias("fulfilment"), L.arm_of(F.col("l_suppkey"), "weights").alias("arm"))


# learning


@query(f"SELECT count(*) AS n, count(*) FILTER (s >= 0.7 AND NOT ok) AS over_confident, count(*) FILTER (s < 0.5 AND ok) AS under_confident FROM {SCORE}")
def misjudged_scores(t):
    return L.misjudged(feedback(t), F.col("s"), F.col("ok"))


_PERF = "SELECT l_linestatus AS side, count(*) AS n, count(*) FILTER (l_returnflag = 'R') / count(*) AS rate, coalesce(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity / 50 END), 0) AS c, coalesce(avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50 END), 0) AS r FROM lineitem GROUP BY 1"


@query(f"SELECT side, n, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN 2 * rate * rate / (rate + rate) ELSE 0 END, 6) AS f1, round(c, 6) AS avg_confirmed, round(r, 6) AS avg_rejected FROM ({_PERF})")
def learner_metrics(t):
    p = L.performance(t.lineitem, F.col("l_quantity") / 50, F.col("l_returnflag") == "R", ["l_linestatus"])
    return p.select(F.col("l_linestatus").alias("side"), "n", *[F.round(c, 6).alias(c) for c in ("rate", "f1", "avg_confirmed", "avg_rejected")])


@query(f"WITH p AS ({_PERF}) SELECT n.c - n.r > o.c - o.r AND n.rate >= o.rate - 0.05 AS apply, o.c - o.r > n.c - n.r AND o.rate >= n.rate - 0.05 AS back FROM p o, p n WHERE o.side = 'F' AND n.side = 'O'")
def weight_apply_gate(t):
    p = L.performance(t.lineitem, F.col("l_quantity") / 50, F.col("l_returnflag") == "R", ["l_linestatus"]).select("l_linestatus", F.struct("rate", "avg_confirmed", "avg_rejected").alias("m"))
    old, new = p.filter("l_linestatus = 'F'").select(F.col("m").alias("old")), p.filter("l_linestatus = 'O'").select(F.col("m").alias("new"))
    return old.crossJoin(new).select(L.should_apply(F.col("old"), F.col("new")).alias("apply"), L.should_apply(F.col("new"), F.col("old")).alias("back"))  # one row each


@query(_FACTORS + ", w AS (SELECT * FROM (VALUES ('medication', 0.6, 99), ('recency', 0.1, 100), ('ai', 0.3, 500)) AS x(factor, weight, n)), m AS (SELECT factor, weight::DOUBLE AS weight, CASE WHEN n >= 100 THEN weight * (1 + 5.0 * k) ELSE weight END AS moved FROM w JOIN h USING (factor)), n AS (SELECT factor, weight, least(0.7, greatest(0.05, CASE WHEN abs(moved - weight) < 0.02 THEN weight ELSE moved END)) AS held FROM m) SELECT factor, weight, round(held / sum(held) OVER (), 6) AS new_weight FROM n")
def weight_update_gated(t):
    w = t.spark.createDataFrame([("medication", 0.6, 99), ("recency", 0.1, 100), ("ai", 0.3, 500)], "factor string, weight double, n int")
    return L.new_weights(factors(t).join(w.select("factor", "n"), "factor"), w.drop("n"), rate=5.0, n=F.col("n"))


_AFF = "SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 10) AS confirmed, list_reduce(list(value > 10 ORDER BY ts, event_id), lambda a, x: CASE WHEN x THEN least(1.0::DOUBLE, a + 0.1) ELSE greatest(0.0::DOUBLE, a - 0.15) END, 0.5::DOUBLE) AS affinity FROM events GROUP BY 1, 2"


def affinities(t):
    return L.affinity(t.events, ["user_id", "event_type"], "ts", "event_id", F.col("value") > 10).withColumn("affinity", F.round("affinity", 6))


@query(f"SELECT count(*) AS pairs, count(*) FILTER (n >= 5 AND (confirmed >= 3 OR a < 0.5)) AS confident, round(avg(a), 6) AS mean, count(*) FILTER (a > 0.8) AS high, count(*) FILTER (a < 0.3) AS low FROM (SELECT *, round(affinity, 6) AS a FROM ({_AFF}))")
def affinity_summary(t):
    return L.affinity_stats(affinities(t))


@query(f"WITH a AS (SELECT user_id, event_type, round(affinity, 6) AS affinity FROM ({_AFF})) SELECT * FROM (SELECT *, 'top' AS side FROM a ORDER BY affinity DESC, user_id, event_type LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'bottom' FROM a ORDER BY affinity, user_id, event_type LIMIT 10)")
def affinity_extremes(t):
    return L.extremes(affinities(t).select("user_id", "event_type", "affinity"), "affinity", ["user_id", "event_type"], 10)


_CDF = "(1 - 0.5 * (1 + (1 - ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-v * v))))"


@query(f"""WITH g AS (SELECT event_type, count(*) FILTER (user_id % 10 < 5) AS n1, count(*) FILTER (user_id % 10 < 5 AND ok) AS k1, count(*) FILTER (user_id % 10 >= 5) AS n2, count(*) FILTER (user_id % 10 >= 5 AND ok) AS k2 FROM (SELECT *, value > CASE WHEN event_type = 'click' AND user_id % 10 >= 5 THEN 6 WHEN event_type = 'view' AND user_id % 10 >= 5 THEN 14 ELSE 10 END AS ok FROM events) GROUP BY 1),
    z AS (SELECT *, (k2 / n2 - k1 / n1) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM g), p AS (SELECT *, 2 * {_CDF} AS p FROM (SELECT *, abs(z) / sqrt(2.0) AS v, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS u FROM z))
    SELECT event_type, CASE WHEN (1 - k2 / n2) / (1 - k1 / n1) > 1.2 AND p < 0.05 THEN 'Rollback' WHEN (k2 / n2 / (k1 / n1) - 1) * 100 >= 5 AND p < 0.05 THEN 'Promote' ELSE 'Continue' END AS decision FROM p""")
def ab_decisions(t):
    arm, kind = F.col("user_id") % 10 < 5, F.col("event_type")
    ok = F.col("value") > F.when((kind == "click") & ~arm, 6).when((kind == "view") & ~arm, 14).otherwise(10)
    side = lambda c: F.struct(F.count_if(c).alias("n"), F.count_if(c & ok).alias("confirmed"), F.count_if(c & ~ok).alias("rejected"))
    g = t.events.groupBy("event_type").agg(side(arm).alias("control"), side(~arm).alias("test"))
    return g.select("event_type", L.test_decision(F.col("control"), F.col("test")).alias("decision"))


# JSON


@query("SELECT o_custkey, string_agg(o_orderkey || ' x ' || (o_orderkey % 9), '; ' ORDER BY o_orderkey) AS items FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def format_items(t):
    items = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 9).alias("quantity")))))
    d = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(items.alias("j"))  # a customer's open orders
    return d.select("o_custkey", json_repair.items_text(F.col("j")).alias("items"))


@query("SELECT user_id, nth, event_id, k FROM (SELECT user_id, event_id, json_extract_string(props, '$.k')::BIGINT AS k, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS nth FROM events)")
def json_root_split(t):
    whole = F.to_json(F.array_sort(F.collect_list(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))))
    d = t.events.groupBy("user_id").agg(whole.alias("text"))
    parts = json_repair.root_items(d, "text")
    return parts.select("user_id", "nth", F.get_json_object("item", "$.event_id").cast("long").alias("event_id"), F.get_json_object("item", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.0 ELSE 0.5 END AS score FROM events")
def json_schema_scores(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, '{"a": 1, "b": "x"}').when(k == 1, '{"a": 1}').when(k == 2, "[1]").otherwise('{"a": "1", "b": true}')
    return t.events.select("event_id", json_repair.schema_scores(["a", "b"], {"a": "number"})(text).alias("score"))


@query("SELECT event_id, '<' || event_type || '>' || substr(props, 3) AS patched FROM events")
def json_patched(t):
    ops = F.array(json_repair.op("replace", 0, 2, F.concat(F.lit("<"), "event_type", F.lit(">"))))
    return t.events.select("event_id", json_repair.patched_text(F.col("props"), ops).alias("patched"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k": ' || k || ', "b": [1, 2]}' WHEN 1 THEN '{"k": ' || k || ', "t": true}' ELSE '[' || k || ', {"a": "x y"}]' END AS best FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def json_beam_best(t):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    broken = F.when(n == 0, F.concat(F.lit('{"k" '), k, F.lit(' "b": [1 2'))).when(n == 1, F.concat(F.lit("{k: "), k, F.lit(", 't': True,,}"))).otherwise(F.concat(F.lit("["), k, F.lit(', {"a": "x y"}}')))
    best = json_beam.candidates(5)(broken)
    return t.events.select("event_id", best[0]["json"].alias("best"))
