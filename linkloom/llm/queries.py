"""One query for each operator, with production parameters, over its whole table; and SQL for the same rows where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import embeddings, licenses, media, mixing, pieces, secrets, simhash, simhash_sql, substrings, tokens, toxicity
from linkloom.llm.common import table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"


def sha(column) -> object:
    return F.sha2(column.cast("binary"), 256)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.counts(docs, public_tokenizers.path(BYTES), public_tokenizers.PATTERN, tokens.scrub).drop("text", "edited")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.runs(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_decode(docs, public_tokenizers.path(PIECES))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    s = F.col("toxic_score")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.7).cast("int").alias("predicted"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, public_tokenizers.path(BYTES), public_tokenizers.PATTERN)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), sha(secrets.joined(base)).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secret_scans(spark, sf_dir).drop("spans")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_token_counts, op3_license_scans, op4_sentencepiece, op5_media_columns, op6_toxicity, op7_secret_scans, op8_suffix_array_dedup, op9_simhash_near_dedup, op10_mixing)}
#: Beside the first query of an operator: lines and blocks as wholes, where that one takes any run of words; what SQL can say of secrets.
MORE = {"op3_license_lines": op3_license_lines, "op7_secret_patterns": op7_secret_patterns}


def marked(kind: str, pattern: str, keep: str) -> str:
    """SQL for the places of a pattern's matches m that are kept: the text is cut at marks that are put around them."""
    cut = f"string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    places = f"SELECT doc_id, list_sum(list_transform(p[1 : i], lambda x: length(replace(x, chr(2), ''))))::BIGINT AS s, split_part(p[i + 1], chr(2), 1) AS m FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, {cut} AS p FROM d))"
    return f"SELECT doc_id, '{kind}' AS kind, s AS a, s + length(m) AS z FROM ({places}) WHERE {keep}"


ASSIGN = secrets.ASSIGN.pattern.replace("'", "''")

ORACLES = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT vec_id AS u, vec_id AS r FROM e UNION SELECT l.w, reach.r FROM reach JOIN links l ON l.u = reach.u),
        c AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
        n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op3_license_scans": licenses.runs_oracle(),
    "op3_license_lines": licenses.oracle(),
    "op7_secret_patterns": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({marked("assign", ASSIGN, f"length(regexp_extract(m, '{ASSIGN}', 1)) >= 6")} UNION ALL {marked("access", "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {marked("hex", "[0-9a-f]+", "length(m) >= 24")}),
        g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, list_position(['assign', 'access', 'hex'], kind)) AS j FROM s GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(j, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    # each window of 100 bytes, two hexadecimal digits a byte
    "op8_suffix_array_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, md5_number_lower(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS p FROM b WHERE length(x) >= 200)),
        l AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
        j AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM l),
        i AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM j) GROUP BY doc_id, g),
        k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list({'a': a, 'z': z} ORDER BY a) AS s FROM i GROUP BY 1)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(CASE WHEN s IS NULL THEN x ELSE array_to_string(list_transform(s, lambda e, i: substr(x, 1 + CASE WHEN i = 1 THEN 0 ELSE 2 * s[i - 1].z END, 2 * (e.a - CASE WHEN i = 1 THEN 0 ELSE s[i - 1].z END))), '')
                || substr(x, 2 * s[-1].z + 1) END)) AS kept_sha256
        FROM b LEFT JOIN k USING (doc_id)""",
    "op9_simhash_near_dedup": simhash_sql.oracle(),
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
                ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
            FROM d GROUP BY source),
        r AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
                sum(w) OVER () AS w_all, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k
            FROM s),
        l AS (
            SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (w_all - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM r),
        f AS (SELECT level FROM l WHERE level * w < cap ORDER BY k LIMIT 1),
        t AS (
            SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * w), cap) AS target,
                CASE WHEN source_size > 0 THEN floor(coalesce(least(cap, (SELECT level FROM f) * w), cap) / source_size) ELSE 0 END::BIGINT AS copies
            FROM l),
        o AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.copies,
                sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
            (size * (copies + CASE WHEN upto <= target - copies * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM o""",
}
