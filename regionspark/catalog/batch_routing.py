"""Queries G1-G3, G21, W5-W8, P7, J1-J7, J10, J12, J15, T3, U1-U3."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionspark import dims
from regionspark.operators import batch as b
from regionspark.operators import routing as r
from regionspark.surrogates import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_UNITS = ["image_id", "seq", "CASE (image_id + seq) % 4 WHEN 0 THEN 'translated' WHEN 1 THEN 'skipped_language' WHEN 2 THEN 'skipped_protected' ELSE 'failed' END AS status"]
_LINES = "l AS (SELECT doc_id AS image_id, (unnest(range(len(string_split(text, chr(10))))))::INT AS seq FROM documents)"
_UNITS_SQL = f"{_LINES}, units AS (SELECT {', '.join(_UNITS)} FROM l)"


def _lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text")).drop("text")


def _units(spark, d):
    return _lines(spark, d).selectExpr(*_UNITS)


@query("g1_counts_by_status", f"WITH {_UNITS_SQL} SELECT image_id, count(*) AS n, {', '.join(chr(99) + f'ount(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in ('translated', 'skipped_language', 'skipped_protected', 'failed'))} FROM units GROUP BY image_id")
def g1(spark, d):
    return b.counts_by_status(_units(spark, d))


_ITEMS = ["o_custkey AS batch_id", "o_orderkey AS item_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status", "CASE WHEN o_orderkey % 3 > 0 THEN 'ref' END AS result_ref", "o_orderpriority AS stem"]
_ITEMS_SQL = f"items AS (SELECT {', '.join(_ITEMS)} FROM orders)"


def _items(spark, d):
    return table(spark, d, "orders").selectExpr(*_ITEMS)


@query("g2_batch_progress", f"""WITH {_ITEMS_SQL} SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS finished, count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) / count(*) AS progress FROM items GROUP BY batch_id""")
def g2(spark, d):
    return b.batch_progress(_items(spark, d))


@query("g3_run_totals", "SELECT o_orderpriority AS run, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY 1")
def g3(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderpriority AS run", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status")
    return b.batch_progress(rows, "run").selectExpr("run", "total", "completed AS succeeded", "failed")


@query("g21_memory_growth", """WITH x AS (SELECT user_id AS run, event_id AS ord, value AS rss_mb FROM events), y AS (SELECT *, rss_mb - lag(rss_mb) OVER w AS d1, lag(rss_mb) OVER w - lag(rss_mb, 2) OVER w AS d0 FROM x WINDOW w AS (PARTITION BY run ORDER BY ord))
SELECT run, max(rss_mb) AS peak_mb, arg_max(rss_mb, ord) <= arg_min(rss_mb, ord) * 1.25::DOUBLE AS ratio_ok, bool_or(coalesce(d1 > 4 AND d0 > 4, FALSE)) AS grew_twice FROM y GROUP BY run""")
def g21(spark, d):
    return b.memory_growth(table(spark, d, "events").selectExpr("user_id AS run", "event_id AS ord", "value AS rss_mb"))


@query("w6_consecutive_growth", """WITH x AS (SELECT event_type AS run, event_id AS ord, value FROM events), y AS (SELECT *, value - lag(value) OVER w AS d1, lag(value) OVER w - lag(value, 2) OVER w AS d0 FROM x WINDOW w AS (PARTITION BY run ORDER BY ord))
SELECT run, max(value) AS peak_mb, arg_max(value, ord) <= arg_min(value, ord) * 2.0::DOUBLE AS ratio_ok, bool_or(coalesce(d1 > 40 AND d0 > 40, FALSE)) AS grew_twice FROM y GROUP BY run""")
def w6(spark, d):
    return b.memory_growth(table(spark, d, "events").selectExpr("event_type AS run", "event_id AS ord", "value AS rss_mb"), 40.0, 2.0)


@query("w5_unique_names", """WITH i AS (SELECT p_partkey AS ord, p_brand AS stem FROM part WHERE p_partkey % 2 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) AS k FROM i),
e AS (SELECT DISTINCT p_brand AS stem, (p_size % 9 + 1)::INT AS slot FROM part WHERE p_partkey % 2 = 1), g AS (SELECT b.stem, n.n FROM (SELECT DISTINCT stem FROM i) b, (SELECT unnest(range(1, 2000)) AS n) n),
f AS (SELECT g.stem, g.n, row_number() OVER (PARTITION BY g.stem ORDER BY g.n) AS k FROM g LEFT JOIN e ON e.stem = g.stem AND e.slot = g.n WHERE e.slot IS NULL)
SELECT k.ord, k.stem, k.stem || '-translated' || CASE WHEN f.n > 1 THEN '-' || f.n ELSE '' END || '.png' AS target FROM k JOIN f ON f.stem = k.stem AND f.k = k.k""")
def w5(spark, d):
    part = table(spark, d, "part")
    slot = F.col("p_size") % 9 + 1
    have = part.where("p_partkey % 2 = 1").select(F.concat("p_brand", F.lit("-translated"), F.when(slot > 1, F.concat(F.lit("-"), slot)).otherwise(""), F.lit(".png")).alias("name"))
    return b.unique_names(part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS ord", "p_brand AS stem"), have, ".png")


_STAGE = ["user_id AS job_id", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'complete' ELSE 'advance' END AS event", "CASE event_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'translation' WHEN 2 THEN 'inpainting' WHEN 3 THEN 'layout' ELSE 'rendering' END AS stage"]


@query("w7_stage_order", f"""WITH x AS (SELECT {', '.join(_STAGE)} FROM events), y AS (SELECT *, sum((event = 'advance')::INT) OVER w AS n, coalesce(sum((event = 'complete')::INT) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM x WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
z AS (SELECT *, o > 0 OR (event = 'advance' AND NOT coalesce(stage = ['ocr', 'translation', 'inpainting', 'layout', 'rendering'][n::BIGINT], FALSE)) OR (event = 'complete' AND n <> 5) AS bad FROM y)
SELECT job_id, NOT bool_or(bad) AS valid, count(*) FILTER (bad) AS n_violations FROM z GROUP BY job_id""")
def w7(spark, d):
    return b.stage_violations(table(spark, d, "events").selectExpr(*_STAGE))


@query("w8_latest_state", "SELECT user_id AS batch_id, event_id % 10 AS item_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY ALL")
def w8(spark, d):
    return b.latest_state(table(spark, d, "events").selectExpr("user_id AS batch_id", "event_id % 10 AS item_id", "event_type AS status", "event_id AS seq"))


_SEL = "SELECT o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000 ELSE 0 END AS batch_id, o_orderkey - CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 2 ELSE 0 END AS item_id, o_orderkey AS ord FROM orders"


def _selection(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000 ELSE 0 END AS batch_id", "o_orderkey - CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 2 ELSE 0 END AS item_id", "o_orderkey AS ord")


_J10 = f"""{_ITEMS_SQL}, s AS ({_SEL}), n AS (SELECT *, count(*) OVER (PARTITION BY batch_id, item_id) AS n FROM s),
chk AS (SELECT n.batch_id, n.item_id, n.ord, i.stem, CASE WHEN i.item_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN status <> 'completed' OR result_ref IS NULL THEN 'not_completed' END AS problem FROM n LEFT JOIN items i ON i.batch_id = n.batch_id AND i.item_id = n.item_id)"""


@query("j10_check_selection", f"WITH {_J10} SELECT batch_id, item_id, ord, problem FROM chk")
def j10(spark, d):
    return b.check_selection(_selection(spark, d), _items(spark, d))


@query("p7_plan_exports", f"""WITH {_J10}, k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) AS k FROM chk WHERE problem IS NULL)
SELECT chk.batch_id, chk.item_id, chk.ord, chk.problem, CASE WHEN k.k IS NOT NULL THEN k.stem || '-translated' || CASE WHEN k.k + (k.k >= 3)::INT > 1 THEN '-' || (k.k + (k.k >= 3)::INT) ELSE '' END || '.png' END AS target FROM chk LEFT JOIN k ON k.ord = chk.ord""")
def p7(spark, d):
    have = table(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("-translated-3.png")).alias("name")).distinct()
    return b.plan_exports(_selection(spark, d), _items(spark, d), have, ".png")


@query("u1_pending", "SELECT DISTINCT o_orderkey % 5000 AS item FROM orders WHERE o_orderstatus IN ('F', 'O') EXCEPT SELECT o_orderkey % 5000 FROM orders WHERE o_orderstatus = 'P'")
def u1(spark, d):
    part = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).selectExpr("o_orderkey % 5000 AS item")
    return b.pending(part("F"), part("O"), part("P"))


@query("j1_route_profiles", f"WITH {dims.LANGUAGES_SQL}, x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'bn' WHEN 1 THEN 'xx' WHEN 2 THEN 'ko' ELSE lang END AS lang FROM documents) SELECT doc_id, lang, profile_id, CASE WHEN language_code IS NULL THEN 'unknown_language' WHEN profile_id IS NULL THEN 'unsupported_language' END AS reason FROM x LEFT JOIN languages ON language_code = lang")
def j1(spark, d):
    return r.route_profiles(table(spark, d, "documents").selectExpr("doc_id", "CASE doc_id % 6 WHEN 0 THEN 'bn' WHEN 1 THEN 'xx' WHEN 2 THEN 'ko' ELSE lang END AS lang"), "lang")


@query("j2_coverage_matrix", "SELECT k AS key, n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey * 7 % 50 = k) AS supported FROM (SELECT n_nationkey AS k, n_name FROM nation)")
def j2(spark, d):
    return r.coverage_matrix(table(spark, d, "nation").selectExpr("n_nationkey AS key", "n_name"), table(spark, d, "supplier").selectExpr("s_nationkey * 7 % 50 AS key"), "key")


@query("j3_coverage_mismatch", f"WITH {dims.LANGUAGES_SQL}, f AS (SELECT DISTINCT CASE WHEN doc_id % 6 = 1 THEN 'xx' ELSE lang END AS k FROM documents) SELECT coalesce(language_code, k) AS language_code, CASE WHEN k IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM languages FULL JOIN f ON k = language_code WHERE k IS NULL OR language_code IS NULL")
def j3(spark, d):
    found = table(spark, d, "documents").selectExpr("CASE WHEN doc_id % 6 = 1 THEN 'xx' ELSE lang END AS language_code")
    return r.coverage_mismatch(dims.languages(spark), found, "language_code")


@query("j4_required_models", """WITH p AS (SELECT p_partkey AS profile_id, p_partkey % 200 AS det, p_size AS cls, p_partkey % 90 + 50 AS rec FROM part), n AS (SELECT profile_id, 'det' AS role, det AS model_id FROM p UNION ALL SELECT profile_id, 'cls', cls FROM p UNION ALL SELECT profile_id, 'rec', rec FROM p)
SELECT model_id, profile_id, role, s_name AS active_version FROM n LEFT JOIN supplier ON s_suppkey = model_id""")
def j4(spark, d):
    need = table(spark, d, "part").selectExpr("p_partkey AS profile_id", "p_partkey % 200 AS det", "CAST(p_size AS BIGINT) AS cls", "p_partkey % 90 + 50 AS rec")
    return r.required_models(need, table(spark, d, "supplier").selectExpr("s_suppkey AS model_id", "s_name AS version"))


_LAB = "SELECT doc_id, CASE WHEN quality = 1 THEN 'translated' ELSE 'failed' END AS status FROM labels"


@query("j5_erase_set", f"WITH {_LINES}, u AS ({_LAB}) SELECT image_id, seq FROM l WHERE image_id IN (SELECT doc_id FROM u WHERE status = 'translated')")
def j5(spark, d):
    units = table(spark, d, "labels").selectExpr("doc_id AS image_id", "CASE WHEN quality = 1 THEN 'translated' ELSE 'failed' END AS status")
    return r.erase_set(_lines(spark, d), units, ["image_id"])


@query("j5_no_erase_regions", f"WITH u AS ({_LAB}) SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u WHERE status = 'translated')")
def j5_none(spark, d):
    units = table(spark, d, "labels").selectExpr("doc_id AS image_id", "CASE WHEN quality = 1 THEN 'translated' ELSE 'failed' END AS status")
    return r.without_erase(table(spark, d, "documents").selectExpr("doc_id AS image_id"), units, "image_id")


@query("j6_unit_regions", f"WITH {_UNITS_SQL} SELECT image_id, seq, status, quality FROM units JOIN labels ON doc_id = image_id")
def j6(spark, d):
    return r.unit_regions(_units(spark, d), table(spark, d, "labels").selectExpr("doc_id AS image_id", "quality"), ["image_id"])


_POS = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"


@query("j7_join_by_position", f"""WITH q AS (SELECT conv_id AS request_id, {_POS} AS pos, turn FROM conversations), a AS (SELECT conv_id AS request_id, {_POS} AS pos, upper(role) AS answer FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 0)),
n AS (SELECT request_id, count(*) AS n FROM q GROUP BY 1), m AS (SELECT request_id, count(*) AS m FROM a GROUP BY 1)
SELECT q.request_id, q.pos, turn, coalesce(n = m, FALSE) AS complete, CASE WHEN n = m THEN answer END AS answer FROM q JOIN n USING (request_id) LEFT JOIN m USING (request_id) LEFT JOIN a ON a.request_id = q.request_id AND a.pos = q.pos""")
def j7(spark, d):
    conv = table(spark, d, "conversations")
    requests = conv.selectExpr("conv_id AS request_id", f"CAST({_POS} AS BIGINT) AS pos", "turn")
    answers = conv.where("NOT (conv_id % 3 = 0 AND turn = 0)").selectExpr("conv_id AS request_id", f"CAST({_POS} AS BIGINT) AS pos", "upper(role) AS answer")
    return r.join_by_position(requests, answers)


_BK = "SELECT o_custkey % 700 AS case_id, count(*) AS line_count, max(o_orderpriority) AS directions FROM orders WHERE o_orderkey % 2 = {k} GROUP BY 1"


@query("j12_compare_backends", f"WITH a AS ({_BK.format(k=0)}), b AS ({_BK.format(k=1)}) SELECT case_id, a.line_count AS line_count_left, a.directions AS directions_left, b.line_count AS line_count_right, b.directions AS directions_right, a.line_count IS NOT DISTINCT FROM b.line_count AS line_count_match, a.directions IS NOT DISTINCT FROM b.directions AS directions_match FROM a JOIN b USING (case_id)")
def j12(spark, d):
    side = lambda k: table(spark, d, "orders").where(f"o_orderkey % 2 = {k}").groupBy(F.expr("o_custkey % 700").alias("case_id")).agg(F.count("*").alias("line_count"), F.max("o_orderpriority").alias("directions"))
    return r.compare_backends(side(0), side(1), "case_id", ["line_count", "directions"])


@query("j15_resolve_preference", """WITH p AS (SELECT c_custkey AS query, unnest([0, 1, 2]) AS rank, unnest(['BRAND#' || (c_custkey % 70), 'Brand#' || (c_custkey % 60), 'brand#' || (c_custkey % 50)]) AS name FROM customer), a AS (SELECT DISTINCT p_brand AS name FROM part),
h AS (SELECT query, min((rank, a.name)) AS m FROM p JOIN a ON lower(a.name) = lower(p.name) GROUP BY query), q AS (SELECT DISTINCT query FROM p)
SELECT query, coalesce(m[2], (SELECT min(name) FROM a)) AS resolved, m IS NULL OR m[1] > 0 AS degraded, CASE WHEN m IS NULL THEN 'script_unavailable' WHEN m[1] > 0 THEN 'preferred_unavailable' END AS reason FROM q LEFT JOIN h USING (query)""")
def j15(spark, d):
    names = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(s), (F.col("c_custkey") % m).cast("string")).alias("name")) for i, (s, m) in enumerate((("BRAND#", 70), ("Brand#", 60), ("brand#", 50)))])
    prefs = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.explode(names).alias("n")).select("query", "n.*")
    return r.resolve_preference(prefs, table(spark, d, "part").selectExpr("p_brand AS name"))


_Q = [("serif", ["blue", "red"]), ("sans", ["small", "steel"]), ("mono", ["zz"]), ("none", ["a"])]
_SUP = "CASE p_partkey % 3 WHEN 0 THEN 'serif' WHEN 1 THEN 'sans' ELSE 'mono' END"


@query("t3_top_candidates", f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b})" for a, b in _Q)}) t(query, tokens)), n AS (SELECT p_name || '-' || p_partkey AS name, {_SUP} AS query FROM part),
h AS (SELECT query, name, len(list_filter(tokens, lambda t: contains(lower(name), t)))::INT AS hits FROM n JOIN q USING (query)), k AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY hits DESC, lower(name), name)::INT AS rank, name, hits FROM h)
SELECT * FROM k WHERE rank <= 8 UNION ALL SELECT query, 1, 'default', 0 FROM q WHERE query NOT IN (SELECT query FROM k)""")
def t3(spark, d):
    queries = spark.createDataFrame(_Q, "query string, tokens array<string>")
    names = table(spark, d, "part").select(F.concat_ws("-", "p_name", "p_partkey").alias("name"), F.array(F.expr(_SUP)).alias("supports"))
    return r.top_candidates(queries, names)


@query("u2_common_cases", "SELECT o_orderkey AS case_id FROM orders INTERSECT SELECT l_orderkey + l_linenumber FROM lineitem")
def u2(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS case_id").intersect(table(spark, d, "lineitem").selectExpr("l_orderkey + l_linenumber AS case_id"))


@query("u3_union_branches", f"WITH {_UNITS_SQL} SELECT image_id, seq, status FROM units")
def u3(spark, d):
    units = _units(spark, d)
    branches = [units.where(F.col("status") == s) for s in ("translated", "skipped_language", "skipped_protected", "failed")]
    out = branches[0]
    for x in branches[1:]:
        out = out.unionByName(x)
    return out.orderBy("image_id", "seq")
