"""Queries A22, A23 and B1-B10."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionspark import dims
from regionspark.functions import geometry as g
from regionspark.operators import checks as c
from regionspark.surrogates import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _reasons_sql(*checks: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce({bad}, TRUE) THEN '{name}' END" for bad, name in checks) + "], lambda r: r IS NOT NULL)"


@query("a22_confidence_status", "SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS confidence, CASE WHEN least(1.0, greatest(0.0, value / 100)) < 0.5 THEN 'low_confidence' ELSE 'ok' END AS status FROM events WHERE CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END <> ''")
def a22(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("confidence"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("text"))
    return c.confidence_status(rows, "confidence", "text").drop("text")


@query("a23_accept_refinement", """WITH r AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, 100.0 * l_linenumber AS x, 60.0 + l_quantity AS w, l_linenumber % 3 AS k, l_discount AS dc FROM lineitem),
n AS (SELECT *, x + w AS old, least(1999.0, x + w + w / 3 * CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END * 1.1) AS grown, k < 2 AND dc <= 0.055 AS ok FROM r),
h AS (SELECT DISTINCT a.image_id, a.seq FROM n a JOIN n b ON a.ok AND a.image_id = b.image_id AND a.seq <> b.seq
      WHERE greatest(0, least(a.grown, b.old) - greatest(a.x, b.x)) * 20 > greatest(0, least(a.old, b.old) - greatest(a.x, b.x)) * 20 + 1)
SELECT n.image_id, n.seq, ok AND h.seq IS NULL AS accepted, round(CASE WHEN ok AND h.seq IS NULL THEN grown ELSE old END, 6) AS max_x FROM n LEFT JOIN h ON h.image_id = n.image_id AND h.seq = n.seq""")
def a23(spark, d):
    x, w, k = 100.0 * F.col("l_linenumber"), 60.0 + F.col("l_quantity"), F.col("l_linenumber") % 3
    quad = F.array(g.point(x, F.lit(10.0)), g.point(x + w, F.lit(10.0)), g.point(x + w, F.lit(30.0)), g.point(x, F.lit(30.0)))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), F.lit("abc").alias("text"), F.lit(0.9).alias("confidence"), quad.alias("polygon"),
        F.when(k == 0, "abcd").when(k == 1, "abcde").otherwise("xyz").alias("candidate"), F.when(F.col("l_discount") <= 0.055, 0.899).otherwise(0.8).alias("candidate_confidence"), F.lit(2000).alias("width"), F.lit(100).alias("height"))
    out = c.accept_refinement(rows)
    return out.select("image_id", "seq", "accepted", F.round(g.bbox(F.col("polygon"))["max_x"], 6).alias("max_x"))


@query("b1_image_limits", f"""WITH i AS (SELECT l_orderkey AS id, l_linenumber AS n, (l_quantity * 100)::INT AS width, (l_partkey % 3000)::INT AS height, floor(l_extendedprice)::BIGINT AS file_size FROM lineitem)
SELECT id, n, width, height, file_size, CASE WHEN file_size > 50000 THEN 'file_too_large' WHEN width < 300 OR height < 100 THEN 'dimensions_too_small' WHEN width > 4000 OR height > 1900 THEN 'dimensions_too_large' WHEN width::BIGINT * height > 3000000 THEN 'pixel_count_too_large' END AS violation FROM i""")
def b1(spark, d):
    limits = spark.createDataFrame([(300, 100, 4000, 1900, 50_000, 3_000_000)], "min_width int, min_height int, max_width int, max_height int, max_bytes long, max_pixels long")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 100).cast("int").alias("width"), (F.col("l_partkey") % 3000).cast("int").alias("height"), F.floor("l_extendedprice").alias("file_size"))
    return c.check_image_limits(rows, limits)


_LIMITS = "p_partkey AS id, p_size - 5 AS min_width, (p_partkey % 11)::INT AS min_height, 40 AS max_width, (p_partkey % 7)::INT + 2 AS max_height, (p_partkey % 5)::INT AS max_bytes"


@query("b2_limit_values", f"WITH x AS (SELECT {_LIMITS} FROM part) SELECT id, {_reasons_sql(*[(f'{k} <= 0', f'{k}_not_positive') for k in ('min_width', 'min_height', 'max_width', 'max_height', 'max_bytes')], ('min_width > max_width', 'width_range'), ('min_height > max_height', 'height_range'))} AS reasons FROM x")
def b2(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", "p_size - 5 AS min_width", "p_partkey % 11 AS min_height", "40 AS max_width", "p_partkey % 7 + 2 AS max_height", "p_partkey % 5 AS max_bytes")
    return c.check_limit_values(rows).select("id", "reasons")


_SPEC = ["p_partkey AS id", "CASE WHEN p_partkey % 9 = 0 THEN '-bad' ELSE 'model-' || p_size END AS model_id", "'1.' || (p_partkey % 4) AS version", "CASE WHEN p_partkey % 3 = 0 THEN 'windows' WHEN p_partkey % 3 = 1 THEN 'macos' ELSE 'linux' END AS platform",
         "CASE WHEN p_partkey % 3 = 0 THEN 'x86_64' ELSE 'arm64' END AS architecture", "p_name AS filename", "CASE WHEN p_partkey % 8 = 0 THEN 'a/../b' WHEN p_partkey % 8 = 1 THEN '/abs' ELSE 'models/' || p_brand END AS object_key", "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'v' END AS object_version",
         "p_size - 3 AS size_bytes", "CASE WHEN p_partkey % 6 = 0 THEN 'abc' ELSE {sha} END AS sha256"]
_NAME = "regexp_full_match({c}, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}')"


@query("b3_release_spec", f"""WITH x AS (SELECT {', '.join(_SPEC).format(sha='sha256(p_name)')} FROM part) SELECT id, {_reasons_sql(*[('NOT ' + _NAME.format(c=k), k) for k in ('model_id', 'version', 'filename')],
("length(object_version) = 0 OR length(object_version) > 256", 'object_version'), ("NOT ((platform = 'windows' AND architecture = 'x86_64') OR (platform = 'macos' AND architecture = 'arm64'))", 'target'),
("object_key = '' OR object_key LIKE '/%' OR list_contains(string_split(object_key, '/'), '..')", 'object_key'), ('size_bytes <= 0', 'size'), ("NOT regexp_full_match(sha256, '[0-9a-f]{64}')", 'sha256'))} AS reasons FROM x""")
def b3(spark, d):
    rows = table(spark, d, "part").selectExpr(*[s.format(sha="sha2(p_name, 256)") for s in _SPEC])
    return c.check_release_spec(rows).select("id", "reasons")


_PLAN = ["c_custkey AS id", "CASE WHEN c_custkey % 9 = 0 THEN chr(9) || chr(10) WHEN c_custkey % 9 = 1 THEN chr(9) || c_name || ' ' ELSE c_name END AS name", "CAST(floor(c_acctbal * 100) AS BIGINT) AS amount_minor", "CASE WHEN c_custkey % 4 = 0 THEN lower(substring(c_mktsegment, 1, 3)) ELSE substring(c_mktsegment, 1, 3) END AS currency", "c_custkey % 4000 * 3 AS duration_days"]


@query("b4_plan", f"WITH x AS (SELECT {', '.join(_PLAN)} FROM customer) SELECT id, {_reasons_sql(('NOT length(trim(name, chr(32) || chr(9) || chr(10))) BETWEEN 1 AND 100', 'name'), ('amount_minor < 0', 'amount'), (chr(78) + 'OT regexp_full_match(currency, ' + chr(39) + '[A-Z]{3}' + chr(39) + ')', 'currency'), ('NOT duration_days BETWEEN 1 AND 3650', 'duration'))} AS reasons FROM x")
def b4(spark, d):
    return c.check_plan(table(spark, d, "customer").selectExpr(*_PLAN)).select("id", "reasons")


@query("b5_translation_request", f"""WITH i AS (SELECT conv_id AS request_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'xx' ELSE 'en' END AS source, CASE WHEN conv_id % 7 = 0 THEN 'tlh' ELSE 'fr' END AS target, CASE WHEN conv_id % 11 = 0 THEN 'same' ELSE 't' || turn END AS item_id, CASE WHEN (conv_id + turn) % 13 = 0 THEN chr(9) || chr(10) ELSE text END AS text FROM conversations),
e AS (SELECT request_id, count(*) AS n, count(DISTINCT item_id) AS ids, sum(length(text))::BIGINT AS chars, bool_or(NOT (regexp_full_match(item_id, '[A-Za-z0-9._-]{{1,64}}') AND length(text) BETWEEN 1 AND 5000 AND trim(text, ' ' || chr(9) || chr(10)) <> '')) AS bad, any_value(source) AS source, any_value(target) AS target FROM i GROUP BY request_id)
SELECT request_id, n, chars, {_reasons_sql(('NOT n BETWEEN 1 AND 100', 'item_count'), ('ids <> n', 'item_ids'), ('bad', 'item'), ('chars > 20000', 'characters'), (f"source IS NOT NULL AND source NOT IN {dims.LANGUAGES}", 'source_language'), (f"target NOT IN {dims.LANGUAGES}", 'target_language'))} AS reasons FROM e""")
def b5(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id AS request_id", "CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'xx' ELSE 'en' END AS source_language", "CASE WHEN conv_id % 7 = 0 THEN 'tlh' ELSE 'fr' END AS target_language",
        "CASE WHEN conv_id % 11 = 0 THEN 'same' ELSE 't' || turn END AS item_id", "CASE WHEN (conv_id + turn) % 13 = 0 THEN chr(9) || chr(10) ELSE text END AS text")
    return c.check_translation_requests(rows)


_ITEMS = ["o_custkey AS batch_id", "o_orderkey % 50 AS item_id", "o_orderkey AS row_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status", "CASE WHEN o_orderkey % 5 = 0 THEN 'layout' END AS current_stage", "CASE WHEN o_orderkey % 3 = 0 THEN 'ref' END AS result_ref", "CASE WHEN o_orderkey % 4 = 0 THEN 'boom' END AS error"]


@query("b6_batch_invariants", f"""WITH x AS (SELECT {', '.join(_ITEMS)} FROM orders), y AS (SELECT *, count(*) OVER (PARTITION BY batch_id, item_id) AS k FROM x)
SELECT row_id, {_reasons_sql(("status = 'completed' AND result_ref IS NULL", 'result_missing'), ("status = 'failed' AND error IS NULL", 'error_missing'), ("current_stage IS NOT NULL AND status <> 'running'", 'stage_not_running'), ('k > 1', 'duplicate_item'))} AS reasons FROM y""")
def b6(spark, d):
    return c.check_batch_invariants(table(spark, d, "orders").selectExpr(*_ITEMS)).select("row_id", "reasons")


@query("b7_provider_response", """WITH t AS (SELECT conv_id AS request_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT request_id, n, request_id % 4 NOT IN (1, 2) AND (request_id % 4 <> 3 OR n = 1) AS ok FROM t""")
def b7(spark, d):
    conv = table(spark, d, "conversations")
    pos = conv.selectExpr("conv_id AS request_id", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos", "'t' || turn AS item_id", "text")
    r = F.col("request_id") % 4
    items = pos.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("item_id").alias("id"), F.when(r == 2, None).otherwise(F.col("text")).alias("text")))).alias("a"))
    items = items.withColumn("a", F.when(r == 1, F.slice("a", F.lit(1), F.size("a") - 1)).when(r == 3, F.reverse("a")).otherwise(F.col("a")))
    bodies = items.select("request_id", F.to_json(F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))).alias("body"))
    return c.parse_provider_responses(pos.select("request_id", "pos", "item_id"), bodies)


@query("b8_exactly_one", "SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 'x' END IS NULL) <> (CASE WHEN event_id % 3 = 0 THEN 'x' END IS NULL) AS valid FROM events")
def b8(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", c.exactly_one(F.when(k % 2 == 0, "x"), F.when(k % 3 == 0, "x")).alias("valid"))


_TOKEN = (("token", r"token = \"[0-9a-f]{32,}\""),)


@query("b9_secret_findings", r"""SELECT 'doc/' || doc_id || CASE WHEN doc_id % 100 = 7 THEN '.pem' ELSE '.txt' END AS path, CASE WHEN doc_id % 100 = 7 THEN 'sensitive-file' ELSE 'token' END AS label FROM documents
WHERE doc_id % 100 = 7 OR regexp_matches(text, 'token = "[0-9a-f]{32,}"')""")
def b9(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc/"), "doc_id", F.when(F.col("doc_id") % 100 == 7, ".pem").otherwise(".txt")).alias("path"), "text")
    return c.secret_findings(rows, "path", "text", (*c.SECRET_RULES, *_TOKEN), gate=False)


@query("b9_textual_gate", r"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN repeat('a', 66000) || repeat('é', 9000) WHEN doc_id % 10 = 4 THEN repeat('é', 40000) || repeat('a', 90000) WHEN doc_id % 10 = 5 THEN text || chr(1) ELSE text END AS text FROM documents),
h AS (SELECT doc_id, hex(encode(text))[:131072] AS h FROM x),
b AS (SELECT doc_id, length(h) / 2 AS n, length(regexp_replace(h, '(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])|..', '\1', 'g')) / 2 AS p FROM h) SELECT doc_id, n = 0 OR p >= 0.85 * n AS textual FROM b""")
def b9_gate(spark, d):
    k = F.col("doc_id") % 10
    long = F.when(k == 3, F.concat(F.repeat(F.lit("a"), F.lit(66000)), F.repeat(F.lit("é"), F.lit(9000)))).when(k == 4, F.concat(F.repeat(F.lit("é"), F.lit(40000)), F.repeat(F.lit("a"), F.lit(90000)))).when(k == 5, F.concat("text", F.chr(F.lit(1)))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", c.looks_textual(long).alias("textual"))


@query("b10_forbidden_literals", "WITH n AS (SELECT unnest(['track(1)', '/fr/', 'charset', 'Apache License']) AS needle) SELECT page_id AS path, needle FROM pages JOIN n ON contains(html, needle)")
def b10(spark, d):
    return c.forbidden_literals(table(spark, d, "pages"), "page_id", "html", ["track(1)", "/fr/", "charset", "Apache License"])
