"""Streams replayed from files, JSON repair and message cutting on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import json_repair, splitting
from linkloom.plans.registry import query
from linkloom.streaming import ingest as I


def events(t):
    schema = t.events.schema
    return I.source(t.spark, t.sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    return I.drained(I.window_counts(events(t), "ts", ["event_type"], "1 hour", "10 minutes"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    # one batch and a delay longer than the log: one row a key, whichever; so the row's id is left out. The ten-second rule is replay_dedup's
    kept = I.deduplicated(events(t), "user_id", "event_type", "ts", window="3650 days")
    return I.drained(kept, "append").select("user_id", "event_type")


def timed(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


_FLAGS_OF = "SELECT unnest(ids) AS event_id, unnest(o) AS {1} FROM (SELECT list(event_id ORDER BY ts, event_id) AS ids, list_reduce(list(epoch_us(ts)::BIGINT ORDER BY ts, event_id), lambda a, x: {2}, {3}).o AS o FROM {4} GROUP BY {0})"
_FLAGS = _FLAGS_OF.replace("{4}", "events")


@query(_FLAGS.format("user_id % 5, event_type", "duplicate", "CASE WHEN a.r IS NOT NULL AND abs(x - a.r) < 10000000 THEN {'r': a.r, 'o': list_append(a.o, true)} ELSE {'r': x, 'o': list_append(a.o, false)} END", "{'r': NULL::BIGINT, 'o': []::BOOLEAN[]}"))
def replay_dedup(t):
    return I.replay_duplicates(timed(t).withColumn("sender", F.col("user_id") % 5), "sender", "event_type", "ts", "event_id", 10.0).select("event_id", "duplicate")


@query(_FLAGS.format("user_id % 5, event_type", "duplicate", "CASE WHEN a.r IS NOT NULL AND abs(x - a.r) < 600000000 THEN {'r': a.r, 'o': list_append(a.o, true)} ELSE {'r': x, 'o': list_append(a.o, false)} END", "{'r': NULL::BIGINT, 'o': []::BOOLEAN[]}"))
def stream_repeats(t):
    source = events(t).withColumn("sender", F.col("user_id") % 5)
    return I.with_state(t.spark, lambda: I.drained(I.marked_repeats(source, "sender", "event_type", "ts", "event_id", 600.0), "append")).select("event_id", "duplicate")


_LEFT = "(CASE WHEN a.t IS NULL THEN 5.0::DOUBLE ELSE least(5.0::DOUBLE, a.l + (x - a.t) / 1000000.0::DOUBLE * 0.02::DOUBLE / 60) END)"


@query(_FLAGS.format("user_id", "allowed", f"{{'l': CASE WHEN {_LEFT} >= 1 THEN {_LEFT} - 1 ELSE {_LEFT} END, 't': x, 'o': list_append(a.o, {_LEFT} >= 1)}}", "{'l': 5.0::DOUBLE, 't': NULL::BIGINT, 'o': []::BOOLEAN[]}"))
def rate_limit(t):
    return I.rate_limited(timed(t), ["user_id"], "ts", "event_id", per_minute=0.02, burst=5).select("event_id", "allowed")


@query(_FLAGS.format("event_type", "batch", "CASE WHEN a.n >= 10 OR a.n > 0 AND x - a.f >= 7200000000 THEN {'k': a.k + 1, 'n': 1::BIGINT, 'f': x, 'o': list_append(a.o, a.k + 1)} ELSE {'k': a.k, 'n': a.n + 1, 'f': CASE WHEN a.n > 0 THEN a.f ELSE x END, 'o': list_append(a.o, a.k)} END", "{'k': 0::BIGINT, 'n': 0::BIGINT, 'f': 0::BIGINT, 'o': []::BIGINT[]}"))
def micro_batches(t):
    return I.micro_batches(timed(t), ["event_type"], "ts", "event_id", most=10, seconds=7200).select("event_id", "batch")


@query(_FLAGS.format("user_id", "allowed", "CASE WHEN a.l IS NULL OR x - a.l >= 36000000000 THEN {'l': x, 'o': list_append(a.o, true)} ELSE {'l': a.l, 'o': list_append(a.o, false)} END", "{'l': NULL::BIGINT, 'o': []::BOOLEAN[]}"))
def history_guard(t):
    return I.history_guard(timed(t), ["user_id"], "ts", "event_id", cooldown=36000).select("event_id", "allowed")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 240 HOUR) WHERE r <= 12")
def history_backfill(t):
    return I.backfill(timed(t), ["user_id"], "ts", "event_id", F.lit("2024-01-25").cast("timestamp"), 240, 12).select("event_id", "user_id")


_GUARD = "(SELECT event_id, ts AS timestamp, CASE WHEN user_id % 4 = 0 THEN 'c' || user_id || '@s.whatsapp.net' ELSE 'g' || (user_id % 7) || '@g.us' END AS group_jid, user_id % 10 = 0 AS is_from_me, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS content FROM events)"


@query(f"SELECT event_id FROM {_GUARD} WHERE group_jid LIKE '%@g.us' AND NOT is_from_me AND trim(content) <> '' AND timestamp >= TIMESTAMP '2024-01-25' - INTERVAL 240 HOUR AND group_jid IN ('g1@g.us', 'g2@g.us', 'g3@g.us')")
def guarded_messages(t):
    u = F.col("user_id")
    m = timed(t).select("event_id", F.col("ts").alias("timestamp"), F.when(u % 4 == 0, F.concat(F.lit("c"), u.cast("string"), F.lit("@s.whatsapp.net"))).otherwise(F.concat(F.lit("g"), (u % 7).cast("string"), F.lit("@g.us"))).alias("group_jid"), (u % 10 == 0).alias("is_from_me"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("content"))
    monitored = t.nation.filter("n_nationkey BETWEEN 1 AND 3").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string"), F.lit("@g.us")).alias("group_jid"))
    return I.guarded(m, monitored, F.lit("2024-01-25").cast("timestamp"), 240).select("event_id")


_SAME = "CASE WHEN a.r IS NOT NULL AND abs(x - a.r) < 3600000000 THEN {'r': a.r, 'o': list_append(a.o, true)} ELSE {'r': x, 'o': list_append(a.o, false)} END"
_BUCKET = f"{{'l': CASE WHEN {_LEFT} >= 1 THEN {_LEFT} - 1 ELSE {_LEFT} END, 't': x, 'o': list_append(a.o, {_LEFT} >= 1)}}"


@query(f"""WITH g AS (SELECT e.event_id, e.ts, m.group_jid, m.content FROM events e JOIN {_GUARD} m USING (event_id) WHERE m.group_jid LIKE '%@g.us' AND NOT m.is_from_me AND trim(m.content) <> '' AND m.group_jid IN ('g1@g.us', 'g2@g.us', 'g3@g.us')),
    r AS ({_FLAGS_OF.format("group_jid", "allowed", _BUCKET, "{'l': 5.0::DOUBLE, 't': NULL::BIGINT, 'o': []::BOOLEAN[]}", "g")}),
    a AS (SELECT g.* FROM g JOIN r USING (event_id) WHERE allowed),
    d AS ({_FLAGS_OF.format("group_jid, content", "duplicate", _SAME, "{'r': NULL::BIGINT, 'o': []::BOOLEAN[]}", "a")})
    SELECT event_id FROM d WHERE NOT duplicate""")
def guard_chain(t):
    u = F.col("user_id")
    m = timed(t).select("event_id", F.col("ts").alias("timestamp"), F.when(u % 4 == 0, F.concat(F.lit("c"), u.cast("string"), F.lit("@s.whatsapp.net"))).otherwise(F.concat(F.lit("g"), (u % 7).cast("string"), F.lit("@g.us"))).alias("group_jid"), (u % 10 == 0).alias("is_from_me"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("content"))
    monitored = t.nation.filter("n_nationkey BETWEEN 1 AND 3").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string"), F.lit("@g.us")).alias("group_jid"))
    allowed = I.rate_limited(I.guarded(m, monitored), ["group_jid"], "timestamp", "event_id", per_minute=0.02, burst=5).filter("allowed")
    return I.replay_duplicates(allowed, "group_jid", "content", "timestamp", "event_id", 3600.0).filter("NOT duplicate").select("event_id")


@query("SELECT subscriber, count(*) AS n FROM (SELECT 'errors' AS subscriber FROM events WHERE event_type = 'error' UNION ALL SELECT 'large' FROM events WHERE value > 15 UNION ALL SELECT 'all' FROM events) GROUP BY 1")
def event_fan_out(t):
    sink = I.fan_out({"errors": F.col("event_type") == "error", "large": F.col("value") > 15, "all": F.lit(True)})
    source = events(t)
    out = I.drained(source, "append", sink, schema=T.StructType([*source.schema.fields, T.StructField("subscriber", T.StringType())]))
    return out.groupBy("subscriber").agg(F.count("*").alias("n"))


@query("SELECT event_type, any_value(list_reduce(list_transform(string_split(event_type, ''), lambda c: ord(c)::BIGINT), lambda h, b: (h * 31 + b) & 2147483647, 0::BIGINT) % 4)::INT AS worker, count(*) AS n FROM events GROUP BY 1")
def group_shards(t):
    return I.sharded(t.events, "event_type", "ts", 4).groupBy("event_type", "worker").agg(F.count("*").alias("n"))


_K = "json_extract_string(props, '$.k')"


@query(f"SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'failed' ELSE 'strict_ok' END AS status, CASE event_id % 4 WHEN 0 THEN '{{\"k\": ' || {_K} || '}}' WHEN 1 THEN '[' || {_K} || ', {{\"z\": []}}]' WHEN 2 THEN '\"' || event_type || '\"' END AS json FROM events")
def json_strict(t):
    n, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    text = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit(" [ "), k, F.lit(' ,{"z":[]}]\n'))).when(n == 2, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("event_type"))
    return t.events.select("event_id", json_repair.repair_json(text).alias("r")).select("event_id", "r.status", "r.json")


@query(f"SELECT event_id, 'repaired' AS status, CASE event_id % 5 WHEN 0 THEN '{{\"k\": ' || {_K} || ', \"ok\": true}}' WHEN 1 THEN '{{\"k\": ' || {_K} || '}}' WHEN 2 THEN '{{\"k\": ' || {_K} || ', \"list\": [1, 2]}}' WHEN 3 THEN '{{\"k\": ' || {_K} || ', \"b\": null}}' ELSE '[{{\"k\": ' || {_K} || '}}, {{\"t\": \"' || event_type || '\"}}]' END AS json FROM events")
def json_repaired(t):
    n, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    broken = F.when(n == 0, F.concat(F.lit("Sure: {k: "), k, F.lit(", 'ok': True,} // done"))).when(n == 1, F.concat(F.lit('```json\n{"k": '), k, F.lit("}\n```"))).when(n == 2, F.concat(F.lit('{"k": '), k, F.lit(', "list": [1, 2')))
    broken = broken.when(n == 3, F.concat(F.lit("{\u201ck\u201d: "), k, F.lit(' /* c */ "b": None}'))).otherwise(F.concat(F.lit('[{"k": '), k, F.lit("} {'t': "), "event_type", F.lit("}]")))
    return t.events.select("event_id", json_repair.repair_json(broken).alias("r")).select("event_id", "r.status", "r.json")


def _marked(kind: str, pattern: str, text: str) -> str:
    """SQL that puts the kind before each hit of a pattern, and a mark on both sides of it."""
    return f"regexp_replace({text}, '({pattern})', chr(1) || '{kind}' || '\\1' || chr(2), 'g')"


_CUT = f"string_split({_marked('R', splitting.REQUEST.pattern, _marked('O', splitting.OFFER.pattern, 'text'))}, chr(1))"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH m AS (SELECT conv_id, turn, text, {_CUT} AS p FROM conversations),
    s AS (SELECT conv_id, turn, CASE WHEN len(p) = 1 THEN [{{'intent': 'Unknown', 'marker': NULL, 'segment': text}}]
        ELSE list_filter(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN {{'intent': 'Unknown', 'marker': NULL, 'segment': {_STRIP.format('x')}}} ELSE {{'intent': CASE x[1] WHEN 'O' THEN 'Offer' ELSE 'Request' END, 'marker': {_STRIP.format("split_part(substr(x, 2), chr(2), 1)")}, 'segment': {_STRIP.format("split_part(x, chr(2), 2)")}}} END), lambda x: x.segment <> '') END AS l FROM m)
    SELECT conv_id, turn, unnest(range(len(l)))::INT AS number, unnest(list_transform(l, lambda x: x.intent)) AS intent, unnest(list_transform(l, lambda x: x.marker)) AS marker, unnest(list_transform(l, lambda x: x.segment)) AS segment FROM s""")
def intent_split(t):
    splitting.register(t.spark)
    t.conversations.createOrReplaceTempView("linkloom_messages")
    return t.spark.sql("SELECT conv_id, turn, s.number, s.intent, s.marker, s.segment FROM linkloom_messages, LATERAL split_by_intent(text) s")


_SAID = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'hello available ' || event_type || ' need ' || user_id WHEN 1 THEN 'I have ' || event_type || chr(10) || 'for sale' WHEN 2 THEN 'plain ' || event_type WHEN 3 THEN 'مطلوب ' || event_type || ' متوفر x' ELSE ' wanted ' END AS text FROM events)"


def said(t):
    """Messages with markers of both kinds, made from events, as the conversations hardly hold any."""
    k, kind = F.col("event_id") % 5, F.col("event_type")
    text = F.when(k == 0, F.concat(F.lit("hello available "), kind, F.lit(" need "), F.col("user_id").cast("string"))).when(k == 1, F.concat(F.lit("I have "), kind, F.lit("\nfor sale"))).when(k == 2, F.concat(F.lit("plain "), kind)).when(k == 3, F.concat(F.lit("مطلوب "), kind, F.lit(" متوفر x"))).otherwise(" wanted ")
    return t.events.select("event_id", text.alias("text"))


@query(f"""WITH m AS (SELECT event_id, text, {_CUT} AS p FROM {_SAID}),
    s AS (SELECT event_id, CASE WHEN len(p) = 1 THEN [{{'intent': 'Unknown', 'marker': NULL, 'segment': text}}]
        ELSE list_filter(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN {{'intent': 'Unknown', 'marker': NULL, 'segment': {_STRIP.format('x')}}} ELSE {{'intent': CASE x[1] WHEN 'O' THEN 'Offer' ELSE 'Request' END, 'marker': {_STRIP.format("split_part(substr(x, 2), chr(2), 1)")}, 'segment': {_STRIP.format("split_part(x, chr(2), 2)")}}} END), lambda x: x.segment <> '') END AS l FROM m)
    SELECT event_id, unnest(range(len(l)))::INT AS number, unnest(list_transform(l, lambda x: x.intent)) AS intent, unnest(list_transform(l, lambda x: x.marker)) AS marker, unnest(list_transform(l, lambda x: x.segment)) AS segment FROM s""")
def intent_segments(t):
    splitting.register(t.spark)
    said(t).createOrReplaceTempView("linkloom_said")
    return t.spark.sql("SELECT event_id, s.number, s.intent, s.marker, s.segment FROM linkloom_said, LATERAL split_by_intent(text) s")


@query(f"SELECT event_id, regexp_matches(text, '{splitting.OFFER.pattern}') AND regexp_matches(text, '{splitting.REQUEST.pattern}') AS mixed FROM {_SAID}")
def mixed_intent(t):
    return said(t).select("event_id", (F.col("text").rlike(splitting.OFFER.pattern) & F.col("text").rlike(splitting.REQUEST.pattern)).alias("mixed"))


_BREAK = "CASE WHEN contains(h, {0}) THEN length(h) - strpos(reverse(h), {0}) + 1 END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, text, 1::BIGINT AS s, 0::BIGINT AS e FROM documents WHERE length(text) > 500 UNION ALL
        SELECT doc_id, text, e, CASE WHEN e + 500 > length(text) THEN length(text) + 1 ELSE e + coalesce({_BREAK.format('chr(10)')}, {_BREAK.format("' '")}, {_BREAK.format("'،'")}, 500) END FROM (SELECT doc_id, text, e, substr(text, e, 500) AS h FROM (SELECT doc_id, text, CASE WHEN e = 0 THEN 1 ELSE e END AS e FROM c) WHERE e <= length(text))),
    p AS (SELECT doc_id, s, {_STRIP.format('substr(text, s, e - s)')} AS chunk FROM c WHERE e > 0)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS number, chunk FROM p WHERE chunk <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) BETWEEN 1 AND 500""")
def chunk_text(t):
    splitting.register(t.spark)
    t.documents.createOrReplaceTempView("linkloom_documents")
    return t.spark.sql("SELECT doc_id, c.number, c.chunk FROM linkloom_documents, LATERAL chunk_text(text, 500) c")


@query("SELECT doc_id, unnest(range((len(l) + 3) // 4))::INT AS number, unnest(list_transform(range((len(l) + 3) // 4), lambda i: array_to_string(l[4 * i + 1 : 4 * i + 4], chr(10)))) AS chunk FROM (SELECT doc_id, list_transform(string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10)), lambda x: CASE WHEN ends_with(x, chr(13)) THEN substr(x, 1, length(x) - 1) ELSE x END) AS l FROM documents) WHERE len(l) > 4")
def chunk_lines(t):
    splitting.register(t.spark)
    t.documents.filter("size(split(regexp_replace(text, '\\n\\\\z', ''), '\\n')) > 4").createOrReplaceTempView("linkloom_lined")
    return t.spark.sql("SELECT doc_id, c.number, c.chunk FROM linkloom_lined, LATERAL chunk_lines(text, 4, 500) c")
