"""Queries W1, W2, W4, W9, P8-P13, J8, J9, J11, T1, T2, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionspark.operators import registry as r
from regionspark.surrogates import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_RELEASES = ["p_partkey AS release_id", "p_brand AS model_id", "CASE WHEN p_partkey % 2 = 0 THEN 'windows' ELSE 'macos' END AS platform", "CASE WHEN p_partkey % 2 = 0 THEN 'x86_64' ELSE 'arm64' END AS architecture",
             "CASE p_size % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' ELSE 'withdrawn' END AS status", "'1.' || p_size AS version"]


@query("w1_latest_published", f"WITH x AS (SELECT {', '.join(_RELEASES)} FROM part) SELECT * FROM x WHERE status = 'published' AND platform = 'windows' AND architecture = 'x86_64' QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY release_id DESC) = 1")
def w1(spark, d):
    return r.latest_published(table(spark, d, "part").selectExpr(*_RELEASES, "p_name AS object_key"), "windows", "x86_64")


_LOG = ["o_custkey % 40 AS scope", "o_orderkey AS seq", "CASE o_orderkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'create' WHEN 2 THEN 'publish' WHEN 3 THEN 'publish' ELSE 'rollback' END AS action", "o_custkey % 97 AS version"]


_VERSION_LOG = ["o_custkey % 40 AS scope", "o_orderkey AS seq", "CASE o_orderkey % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'create' WHEN 2 THEN 'publish' WHEN 3 THEN 'publish' WHEN 4 THEN 'publish' ELSE 'rollback' END AS action", "o_custkey % 23 AS version"]


@query("w2_config_versions", f"""WITH RECURSIVE x AS (SELECT {', '.join(_VERSION_LOG)} FROM orders), e AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS k FROM x),
r AS (SELECT scope, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS action, 0::BIGINT AS version, 0::BIGINT AS n, []::BIGINT[] AS drafts, '' AS outcome, NULL::BIGINT AS made, NULL::BIGINT AS source_version FROM (SELECT DISTINCT scope FROM x) UNION ALL
SELECT scope, k, seq, action, version, CASE WHEN outcome = 'ok' AND action <> 'publish' THEN n + 1 ELSE n END,
       CASE WHEN outcome = 'ok' AND action = 'create' THEN list_append(drafts, n + 1) WHEN outcome = 'ok' AND action = 'publish' THEN list_filter(drafts, lambda v: v <> version) ELSE drafts END, outcome,
       CASE WHEN outcome = 'ok' THEN CASE WHEN action = 'publish' THEN version ELSE n + 1 END END, CASE WHEN outcome = 'ok' AND action = 'rollback' THEN version END
FROM (SELECT e.scope, e.k, e.seq, e.action, e.version, r.n, r.drafts, CASE WHEN e.action = 'create' THEN 'ok' WHEN e.version < 1 OR e.version > r.n THEN 'not_found' WHEN list_contains(r.drafts, e.version) <> (e.action = 'publish') THEN 'conflict' ELSE 'ok' END AS outcome
      FROM r JOIN e ON e.scope = r.scope AND e.k = r.k + 1)),
l AS (SELECT scope, max(seq) FILTER (outcome = 'ok' AND action <> 'create') AS last FROM r WHERE k > 0 GROUP BY scope)
SELECT scope, seq, action, version, outcome, made, source_version, CASE WHEN outcome = 'ok' AND action <> 'create' THEN CASE WHEN seq = last THEN 'published' ELSE 'superseded' END END AS status FROM r JOIN l USING (scope) WHERE k > 0""")
def w2_versions(spark, d):
    return r.config_versions(table(spark, d, "orders").selectExpr(*_VERSION_LOG))


@query("w2_config_lifecycle", f"""WITH x AS (SELECT {', '.join(_LOG)} FROM orders),
c AS (SELECT scope, version, min(seq) FILTER (action = 'create') AS made FROM x GROUP BY ALL),
p AS (SELECT x.scope, x.version, min(x.seq) AS pub FROM x JOIN c USING (scope, version) WHERE action = 'publish' AND x.seq > c.made GROUP BY ALL),
o AS (SELECT x.*, CASE WHEN action = 'create' THEN CASE WHEN seq = c.made THEN 'ok' ELSE 'conflict' END WHEN c.made IS NULL OR seq < c.made THEN 'not_found'
             WHEN action = 'publish' THEN CASE WHEN seq = p.pub THEN 'ok' ELSE 'conflict' END WHEN seq > p.pub THEN 'ok' ELSE 'conflict' END AS outcome
      FROM x LEFT JOIN c ON c.scope = x.scope AND c.version = x.version LEFT JOIN p ON p.scope = x.scope AND p.version = x.version),
l AS (SELECT scope, max(seq) AS last FROM o WHERE outcome = 'ok' AND action <> 'create' GROUP BY scope)
SELECT o.*, CASE WHEN outcome = 'ok' AND action <> 'create' THEN CASE WHEN seq = l.last THEN 'published' ELSE 'superseded' END END AS status, CASE WHEN outcome = 'ok' AND action = 'rollback' THEN version END AS source_version
FROM o LEFT JOIN l ON l.scope = o.scope""")
def w2(spark, d):
    return r.config_lifecycle(table(spark, d, "orders").selectExpr(*_LOG))


_STEPS = ["o_custkey AS release_id", "o_orderkey AS seq", "CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' WHEN 2 THEN 'withdrawn' ELSE 'draft' END AS status"]


@query("p13_release_lifecycle", f"""WITH x AS (SELECT {', '.join(_STEPS)} FROM orders),
a AS (SELECT release_id, count(*) AS n, min(seq) FILTER (status = 'draft') AS d FROM x GROUP BY release_id),
b AS (SELECT a.*, (SELECT min(seq) FROM x WHERE x.release_id = a.release_id AND x.status = 'published' AND x.seq > a.d) AS p FROM a),
c AS (SELECT b.*, (SELECT min(seq) FROM x WHERE x.release_id = b.release_id AND x.status = 'withdrawn' AND x.seq > b.p) AS w FROM b)
SELECT release_id, CASE WHEN w IS NOT NULL THEN 'withdrawn' WHEN p IS NOT NULL THEN 'published' WHEN d IS NOT NULL THEN 'draft' END AS status, n - (d IS NOT NULL)::BIGINT - (p IS NOT NULL)::BIGINT - (w IS NOT NULL)::BIGINT AS n_illegal FROM c""")
def p13(spark, d):
    return r.release_lifecycle(table(spark, d, "orders").selectExpr(*_STEPS))


_MAN = ["p_partkey AS model_id", "'1.' || (p_size % 3) AS version", "p_brand AS object_version", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS sha256", "p_size AS size_bytes", "p_partkey % 10 <> 0 AS target_ok"]
_INS = ["s_suppkey AS model_id", "'1.' || (s_suppkey % 3) AS version", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'x' END AS sha256"]


@query("j8_compare_installed", f"""WITH m AS (SELECT {', '.join(_MAN)} FROM part), i AS (SELECT {', '.join(_INS)} FROM supplier)
SELECT m.*, CASE WHEN NOT target_ok THEN 'target_mismatch' WHEN i.model_id IS NOT NULL AND m.version = i.version AND m.sha256 IS NOT DISTINCT FROM i.sha256 THEN 'up_to_date' ELSE 'install' END AS action FROM m LEFT JOIN i USING (model_id)""")
def j8(spark, d):
    return r.compare_installed(table(spark, d, "part").selectExpr(*_MAN), table(spark, d, "supplier").selectExpr(*_INS), ("version", "sha256"))


@query("j9_verify_content", """SELECT doc_id AS name, strlen(text) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN doc_id % 10 = 1 THEN 'x' ELSE sha256(text) END AS sha256,
CASE WHEN doc_id % 10 = 2 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'size_mismatch' WHEN doc_id % 10 = 1 THEN 'hash_mismatch' ELSE 'ok' END AS verdict FROM documents""")
def j9(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 10
    declared = docs.select(F.col("doc_id").alias("name"), (F.octet_length("text").cast("long") + F.when(k == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k == 1, "x").otherwise(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"))
    return r.verify_content(declared, docs.where(k != 2).select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("content")))


_NOW = "TIMESTAMP '1998-01-01 00:00:00'"
_CODES = ["c_custkey AS code", "'t' || c_custkey AS token_digest", "c_custkey % 7 = 0 AS disabled", "{ts} AS expires_at", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'd' || (c_custkey % 5) END AS device"]
_TS = {"spark": "TIMESTAMP '1997-06-01 00:00:00' + make_dt_interval(CAST(c_custkey % 400 AS INT))", "duck": "TIMESTAMP '1997-06-01 00:00:00' + to_days((c_custkey % 400)::INT)"}


def _codes(spark, d):
    return table(spark, d, "customer").selectExpr(*[c.format(ts=_TS["spark"]) for c in _CODES])


_CODES_SQL = f"codes AS (SELECT {', '.join(_CODES).format(ts=_TS['duck'])} FROM customer)"


@query("j11_authorise", f"WITH {_CODES_SQL} SELECT o_orderkey AS request_id, 't' || o_custkey % 1600 AS token_digest, coalesce(NOT disabled AND expires_at > {_NOW}, FALSE) AS authorised FROM orders LEFT JOIN codes ON token_digest = 't' || o_custkey % 1600")
def j11(spark, d):
    requests = table(spark, d, "orders").selectExpr("o_orderkey AS request_id", "'t' || o_custkey % 1600 AS token_digest")
    return r.authorise(requests, _codes(spark, d), F.expr(_NOW))


@query("p11_code_status", f"WITH {_CODES_SQL} SELECT code, CASE WHEN disabled THEN 'disabled' WHEN expires_at <= {_NOW} THEN 'expired' WHEN device IS NOT NULL THEN 'active' ELSE 'unbound' END AS status FROM codes")
def p11(spark, d):
    return _codes(spark, d).select("code", r.code_status(F.col("disabled"), F.col("device"), F.col("expires_at"), F.expr(_NOW)).alias("status"))


_ATT = ["o_orderkey AS attempt_id", "o_custkey AS code", "'d' || o_orderkey % 3 AS device", "CAST(o_orderdate AS TIMESTAMP) AS ts"]
_DUR = {"spark": "CAST(c_custkey % 900 + 1 AS INT) AS duration_days", "duck": "(c_custkey % 900 + 1)::INT AS duration_days"}
_OFF = "CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' END AS disabled_at"
_FIRST = "SELECT code, min((ts, attempt_id, device, duration_days)) AS m FROM b GROUP BY code"


def _attempts(spark, d):
    return table(spark, d, "orders").selectExpr(*_ATT)


@query("w4_first_binder", f"""WITH b AS (SELECT {', '.join(_ATT)}, (o_custkey % 900 + 1)::INT AS duration_days FROM orders), f AS ({_FIRST})
SELECT code, m[3] AS device, m[1] AS activated_at, m[1] + to_days(m[4]) AS expires_at FROM f""")
def w4(spark, d):
    return r.first_binder(table(spark, d, "orders").selectExpr(*_ATT, "CAST(o_custkey % 900 + 1 AS INT) AS duration_days"))


@query("p10_activation_outcomes", f"""WITH a AS (SELECT {', '.join(_ATT)} FROM orders), c AS (SELECT c_custkey AS code, {_DUR['duck']}, {_OFF} FROM customer WHERE c_custkey % 10 <> 3),
j AS (SELECT a.*, c.code AS known, duration_days, coalesce(disabled_at <= ts, FALSE) AS off FROM a LEFT JOIN c USING (code)), b AS (SELECT * FROM j WHERE known IS NOT NULL AND NOT off), f AS ({_FIRST})
SELECT attempt_id, j.code, device, ts, CASE WHEN known IS NULL THEN 'invalid_code' WHEN off THEN 'code_disabled' WHEN device <> m[3] THEN 'device_mismatch' WHEN m[1] + to_days(m[4]) <= ts THEN 'code_expired' ELSE 'ok' END AS outcome FROM j LEFT JOIN f ON f.code = j.code""")
def p10(spark, d):
    codes = table(spark, d, "customer").where("c_custkey % 10 <> 3").selectExpr("c_custkey AS code", _DUR["spark"], _OFF)
    return r.activation_outcomes(_attempts(spark, d), codes)


@query("w9_last_token", f"WITH a AS (SELECT {', '.join(_ATT)}, o_orderpriority AS token FROM orders), l AS (SELECT code, arg_max(token, (ts, attempt_id)) AS token FROM a GROUP BY code) SELECT code, CASE WHEN code % 9 <> 0 THEN token END AS token FROM l")
def w9(spark, d):
    rows = table(spark, d, "orders").selectExpr(*_ATT, "o_orderpriority AS token")
    return r.last_token(rows, table(spark, d, "customer").where("c_custkey % 9 = 0").selectExpr("c_custkey AS code"))


_SYMBOL = "['" + "', '".join(r.ALPHABET) + "'][('0x' || substr(h, {k}, 2))::BIGINT % 32 + 1]"


@query("p8_issue_codes", f"""WITH p AS (SELECT c_custkey AS plan_id, unnest(range(1, (c_custkey % 4 + 1)::BIGINT)) AS i, (c_custkey % 365 + 1)::INT AS duration_days FROM customer WHERE c_custkey % 5 <> 0),
h AS (SELECT *, sha256('seed|' || plan_id || '|' || i) AS h FROM p)
SELECT plan_id, duration_days, TRUE AS "unique", 'IT-' || {" || '-' || ".join(" || ".join(_SYMBOL.format(k=2 * (4 * b + k) + 1) for k in range(4)) for b in range(8))} AS code FROM h""")
def p8(spark, d):
    plans = table(spark, d, "customer").selectExpr("c_custkey AS plan_id", "CAST(c_custkey % 4 AS INT) AS n", "CAST(c_custkey % 365 + 1 AS INT) AS duration_days", "c_custkey % 5 <> 0 AS enabled")
    return r.issue_codes(plans, "seed")


_KEY = "0123456789abcdef0123456789abcdef"


def _pad(x: int) -> str:
    return "".join(f"\\x{b ^ x:02X}" for b in _KEY.encode().ljust(64, b"\0"))


@query("p9_hmac_sha256", f"SELECT c_custkey, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode('code:' || c_name)))) AS digest FROM customer")
def p9(spark, d):
    return table(spark, d, "customer").select("c_custkey", r.hmac_sha256(_KEY, "code", F.col("c_name")).alias("digest"))


_REQ = ["event_id", "CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'user' || user_id END AS actor", "CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'PUT' END AS method",
        "CASE event_id % 3 WHEN 0 THEN '/v1/admin/' || event_type WHEN 1 THEN '/admin' ELSE '/v1/translate' END AS path", "props AS correlation_id", "CAST(200 + event_id % 5 * 100 AS INT) AS status_code"]


@query("p12_audit_writes", f"""WITH x AS (SELECT {', '.join(_REQ)} FROM events) SELECT event_id, substr(actor, 1, 100) AS actor, substr(method, 1, 20) AS action, substr(path, 1, 500) AS resource, substr(correlation_id, 1, 64) AS correlation_id, status_code
FROM x WHERE method <> 'GET' AND status_code < 400 AND (path LIKE '/v1/admin/%' OR path LIKE '/admin%') AND actor IS NOT NULL""")
def p12(spark, d):
    return r.audit_writes(table(spark, d, "events").selectExpr(*_REQ))


@query("t1_recent_audit", "SELECT event_id, ts AS occurred_at, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def t1(spark, d):
    return r.recent_audit(table(spark, d, "events").selectExpr("event_id", "ts AS occurred_at", "event_type"))


@query("t2_registry_listing", "SELECT p_partkey AS release_id, p_brand AS model_id, p_size FROM part ORDER BY release_id DESC")
def t2(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS release_id", "p_brand AS model_id", "p_size").orderBy(F.desc("release_id"))


@query("u4_effective_config", """WITH b AS (SELECT o_orderstatus AS status, max(o_orderkey) AS version FROM orders GROUP BY ALL),
c(n, rank, source, status) AS (VALUES (0, 0, 'remote', 'P'), (0, 1, 'cache', 'O'), (0, 2, 'builtin', 'F'), (1, 0, 'remote', ''), (1, 1, 'cache', 'O'), (1, 2, 'builtin', 'F'), (2, 0, 'remote', ''), (2, 1, 'cache', ''), (2, 2, 'builtin', 'F')),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY rank) AS k FROM c JOIN b USING (status)) SELECT n, version, source, source <> 'remote' AS warning FROM r WHERE k = 1""")
def u4(spark, d):
    """All sources, two of them, the last one only, and none."""
    best = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy().agg(F.max("o_orderkey").alias("version")).where("version is not null")
    cases = [r.effective_config(*map(best, sources)).select(F.lit(n).alias("n"), "version", "source", "warning") for n, sources in enumerate(("POF", ("", "O", "F"), ("", "", "F"), ("", "", "")))]
    return cases[0].union(cases[1]).union(cases[2]).union(cases[3])
