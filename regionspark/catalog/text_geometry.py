"""Queries A1-A21 over documents and the regions derived from them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regionspark import dims
from regionspark.functions import geometry as g
from regionspark.functions import text as t
from regionspark.surrogates import REGIONS_SQL, regions, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_BLANK = t.BLANK


@query("a1_normalize_text", f"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '{_BLANK}+', ' ', 'g')) AS text FROM documents")
def a1(spark, d):
    return table(spark, d, "documents").select("doc_id", t.normalize_text(F.col("text")).alias("text"))


def _script_sql(text: str, fallback: str) -> str:
    plain = " ".join(f"WHEN regexp_matches({text}, '[{c}]') THEN '{code}'" for c, code in t.SCRIPTS)
    return (f"CASE {plain} WHEN regexp_matches({text}, '[{t.ARABIC}]') THEN CASE WHEN {fallback} IN ('ar', 'fa', 'ur') THEN {fallback} ELSE 'ar' END "
            f"WHEN regexp_matches({text}, '[{t.HAN}]') THEN CASE WHEN {fallback} IN ('zh-Hans', 'zh-Hant', 'ja') THEN {fallback} ELSE 'zh-Hans' END END")


# A prefix in another script by doc_id, so that every branch is met.
_MARKS = ["", "가", "ก", "अ", "অ", "б", "ب", "字"]


def _marked(spark, d):
    marks = F.array(*[F.lit(m) for m in _MARKS])
    return table(spark, d, "documents").select("doc_id", "lang", F.concat("text", F.get(marks, (F.col("doc_id") % 8).cast("int"))).alias("text"))


_MARKED_SQL = "marked AS (SELECT doc_id, lang, text || [" + ", ".join(f"'{m}'" for m in _MARKS) + "][(doc_id % 8)::BIGINT + 1] AS text FROM documents)"


@query("a2_script_language", f"WITH {_MARKED_SQL} SELECT doc_id, {_script_sql('text', 'lang')} AS script_language FROM marked")
def a2(spark, d):
    return _marked(spark, d).select("doc_id", t.script_language(F.col("text"), F.col("lang")).alias("script_language"))


_FIRST_CASE = " ".join(f"WHEN regexp_matches(c, '[{cls}]') THEN '{code}'" for cls, code in t.FIRST)


@query("a3_first_script_language", f"WITH {_MARKED_SQL}, f AS (SELECT doc_id, regexp_extract(text, '[{''.join(c for c, _ in t.FIRST)}]') AS c FROM marked) SELECT doc_id, CASE {_FIRST_CASE} ELSE 'en' END AS first_language FROM f")
def a3(spark, d):
    return _marked(spark, d).select("doc_id", t.first_script_language(F.col("text")).alias("first_language"))


@query("a4_wrap_rules", f"WITH {_MARKED_SQL} SELECT doc_id, regexp_matches(text, '[{t.HAN}]') AS has_cjk, NOT regexp_matches(right(text, 1), '{_BLANK}') AND regexp_matches(right(text, 1), '[{t.HAN}{t.KANA}{t.HANGUL}]') AS last_wraps FROM marked")
def a4(spark, d):
    return _marked(spark, d).select("doc_id", t.contains_cjk(F.col("text")).alias("has_cjk"), t.requires_char_wrap(F.right("text", F.lit(1))).alias("last_wraps"))


@query("a5_graphemes", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)
SELECT doc_id, seq::INT AS seq, len(string_split(s, '')) - CASE WHEN s = '' THEN 1 ELSE 0 END AS n_graphemes FROM l""")
def a5(spark, d):
    return regions(spark, d).select(F.col("image_id").alias("doc_id"), "seq", F.size(t.graphemes(F.col("text"))).cast("long").alias("n_graphemes"))


_FLAGS = "\U0001F1E9\U0001F1EA\U0001F1EB\U0001F1F7\U0001F1EA"  # two flags and half of a third


@query("a5_grapheme_bounds", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), n AS (SELECT doc_id, seq::INT AS seq, length(s) AS n FROM l)
SELECT doc_id, seq, n + 5 AS n_ends, concat_ws(',', 1, n + 3, n + 5, n + 8, n + 9) AS inside, n >= 0 AS ends_ok, n < 0 AS flag_cut_ok, n < 0 AS past_ok FROM n""")
def a5_bounds(spark, d):
    """Lines between graphemes of several characters: all places of each line, and bounds at all ends, inside a flag, past the end."""
    rows = regions(spark, d).select(F.col("image_id").alias("doc_id"), "seq", F.concat(F.lit("e\u0301"), F.translate("text", "\r", " "), F.lit(_FLAGS), F.lit("\U0001F469\u200D\U0001F4BB")).alias("text"))
    rows = rows.select("doc_id", "seq", F.length("text").alias("n"), t.grapheme_ends(F.col("text")).alias("ends"))  # once a line
    n, ends = F.col("n"), F.col("ends")
    inside = F.array_join(F.array_except(F.sequence(F.lit(1), n), ends).cast("array<string>"), ",")
    ok = [t.ends_hold(ends, bounds) for bounds in (F.concat(F.array(F.lit(0)), ends), F.array(F.lit(0), n - 5), F.array(n + 1))]
    return rows.select("doc_id", "seq", F.size(ends).cast("long").alias("n_ends"), inside.alias("inside"), ok[0].alias("ends_ok"), ok[1].alias("flag_cut_ok"), ok[2].alias("past_ok"))


_GLOSSARY = [("the", "LE"), ("and the", "ET LE"), ("of", "DE")]


@query("a6_glossary_translate", r"""WITH x AS (SELECT doc_id, ' ' || regexp_replace(text, '[^A-Za-z]', ' ', 'g') || ' ' AS s FROM documents),
a AS (SELECT doc_id, s, regexp_replace(regexp_replace(s, ' ', '  ', 'g'), '(?i) and  the ', ' ET LE ', 'g') AS b FROM x),
c AS (SELECT doc_id, s, regexp_replace(regexp_replace(regexp_replace(b, '(?i) the ', ' LE ', 'g'), '(?i) of ', ' DE ', 'g'), '  ', ' ', 'g') AS r FROM a)
SELECT doc_id, CASE WHEN r <> s THEN r ELSE '【模拟 fr】' || s END AS translated FROM c""")
def a6(spark, d):
    plain = F.concat(F.lit(" "), F.regexp_replace("text", "[^A-Za-z]", " "), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", t.glossary_translate(plain, "fr", _GLOSSARY).alias("translated"))


@query("a7_correlation_id", r"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN event_type || '-' || event_id END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9._-]{1,64}') THEN raw ELSE sha256(event_id::VARCHAR)[:32] END AS correlation_id FROM e""")
def a7(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat_ws("-", "event_type", "event_id"))
    fresh = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 32)
    return table(spark, d, "events").select("event_id", t.normalize_correlation_id(raw, fresh).alias("correlation_id"))


_KIND = "[ 'ActivationNotFound', 'ModelReleaseConflict', 'ImageLimitError' ][(event_id % 3)::BIGINT + 1]"


@query("a8_outcome_class", f"SELECT event_type, {_KIND} AS error, CASE WHEN {_KIND} LIKE '%NotFound' THEN 404 WHEN {_KIND} LIKE '%Conflict' THEN 409 ELSE 422 END AS status, count(*) AS n FROM events GROUP BY ALL")
def a8(spark, d):
    error = F.get(F.array(F.lit("ActivationNotFound"), F.lit("ModelReleaseConflict"), F.lit("ImageLimitError")), (F.col("event_id") % 3).cast("int"))
    return table(spark, d, "events").select("event_type", error.alias("error")).withColumn("status", t.outcome_class(F.col("error"))).groupBy("event_type", "error", "status").agg(F.count("*").alias("n"))


_STATUSES = [400, 401, 403, 408, 413, 422, 429, 500, 502, 503, 504, 200]


@query("a9_provider_outcome", f"""WITH e AS (SELECT event_id, [{', '.join(map(str, _STATUSES))}][(event_id % 12)::BIGINT + 1] AS status, CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE (value / 10)::VARCHAR END AS h, value FROM events)
SELECT event_id, CASE WHEN status IN (401, 403) THEN 'provider_authentication_failed' WHEN status = 429 THEN 'provider_rate_limited' WHEN status IN (408, 500, 503) THEN 'provider_unavailable' WHEN status = 400 THEN 'provider_rejected_request' ELSE 'provider_failed' END AS code,
status IN (429, 408, 500, 503) AS retryable, CASE WHEN status = 401 THEN 'backend_authentication_failed' WHEN status = 429 THEN 'backend_rate_limited' WHEN status IN (408, 500, 502, 503, 504) THEN 'backend_unavailable' WHEN status IN (400, 413, 422) THEN 'backend_rejected_request' ELSE 'backend_failed' END AS client_code,
CASE WHEN try_cast(h AS DOUBLE) IS NOT NULL THEN least(2.0, greatest(0.0, try_cast(h AS DOUBLE))) END AS retry_after FROM e""")
def a9(spark, d):
    status = F.get(F.array(*[F.lit(s) for s in _STATUSES]), (F.col("event_id") % 12).cast("int"))
    header = F.when(F.col("event_id") % 5 == 0, "soon").otherwise((F.col("value") / 10).cast("string"))
    rows = table(spark, d, "events").select("event_id", status.alias("status"), header.alias("h"))
    code, retry = t.provider_outcome(F.col("status"))
    wait = F.when(F.col("h").try_cast("double").isNotNull(), t.retry_after(F.col("h")))
    return rows.select("event_id", code.alias("code"), retry.alias("retryable"), t.backend_outcome(F.col("status")).alias("client_code"), wait.alias("retry_after"))


_CODES = "CASE WHEN doc_id % 4 = 0 THEN 'pt-BR' WHEN doc_id % 4 = 1 THEN 'PT-PT' WHEN doc_id % 4 = 2 THEN 'xx' ELSE lang END"


@query("a10_provider_language", f"""WITH {dims.LANGUAGES_SQL}, x AS (SELECT doc_id, {_CODES} AS code FROM documents),
r AS (SELECT lower(provider_code) AS p, arg_min(language_code, ord) AS c FROM languages GROUP BY 1)
SELECT doc_id, code, coalesce(l.provider_code, code) AS provider, coalesce(r.c, code) AS internal FROM x LEFT JOIN languages l ON l.language_code = code LEFT JOIN r ON r.p = lower(code)""")
def a10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_CODES).alias("code"))
    return t.from_provider_language(t.to_provider_language(rows, "code", "provider"), "code", "internal")


# --- geometry ---------------------------------------------------------------------------------------------------------

_AREA = "list_sum(list_transform(range(1, 5), lambda i: {p}[i].x * {p}[i % 4 + 1].y - {p}[i % 4 + 1].x * {p}[i].y)) / 2"
_BOX = "list_min(list_transform({p}, lambda q: q.{c}))"


@query("a11_signed_area", f"WITH {REGIONS_SQL}, r AS (SELECT image_id, seq, CASE WHEN image_id % 3 = 0 THEN list_reverse(p) ELSE p END AS p FROM regions) SELECT image_id, seq::INT AS seq, {_AREA.format(p='p')} AS area FROM r")
def a11(spark, d):
    p = F.when(F.col("image_id") % 3 == 0, F.reverse("polygon")).otherwise(F.col("polygon"))
    return regions(spark, d).select("image_id", "seq", g.signed_area(p).alias("area"))


@query("a12_order_quad", f"""WITH {REGIONS_SQL}
SELECT image_id, seq::INT AS seq, w > 0 AS valid, CASE WHEN w > 0 THEN 0.0 END AS x0, CASE WHEN w > 0 THEN y END AS y0, CASE WHEN w > 0 THEN w END AS x1, CASE WHEN w > 0 THEN y END AS y1,
CASE WHEN w > 0 THEN w END AS x2, CASE WHEN w > 0 THEN y + 30 END AS y2, CASE WHEN w > 0 THEN 0.0 END AS x3, CASE WHEN w > 0 THEN y + 30 END AS y3 FROM regions""")
def a12(spark, d):
    p = F.when(F.col("image_id") % 3 == 0, F.reverse("polygon")).otherwise(F.col("polygon"))
    q = regions(spark, d).select("image_id", "seq", g.order_quad(p).alias("q"))
    return q.select("image_id", "seq", F.col("q").isNotNull().alias("valid"), *[F.col("q")[i][c].alias(f"{c}{i}") for i in range(4) for c in "xy"])


@query("a13_bbox_iou", f"""WITH {REGIONS_SQL}, b AS (SELECT image_id, seq, w, y, lead(w) OVER (PARTITION BY image_id ORDER BY seq) AS w2 FROM regions),
o AS (SELECT image_id, seq, least(w, w2) * 10.0 AS o, w * 30 + w2 * 30 - least(w, w2) * 10.0 AS u FROM b WHERE w2 IS NOT NULL)
SELECT image_id, seq::INT AS seq, o AS overlap, round(CASE WHEN u > 0 THEN o / u ELSE 0 END, 9) AS iou FROM o""")
def a13(spark, d):
    b = g.bbox(F.col("polygon"))
    rows = regions(spark, d).select("image_id", "seq", b.alias("b"))
    rows = rows.withColumn("c", F.lead("b").over(W.partitionBy("image_id").orderBy("seq"))).where("c is not null")
    up = F.struct(F.col("c.min_x").alias("min_x"), (F.col("c.min_y") - 20).alias("min_y"), F.col("c.max_x").alias("max_x"), (F.col("c.max_y") - 20).alias("max_y"))
    return rows.select("image_id", "seq", g.overlap_area(F.col("b"), up).alias("overlap"), F.round(g.bbox_iou(F.col("b"), up), 9).alias("iou"))


@query("a14_quad_to_box", f"""WITH {REGIONS_SQL}, s AS (SELECT *, sqrt((p[2].x - p[1].x) ** 2 + (p[2].y - p[1].y) ** 2) AS a, sqrt((p[4].x - p[1].x) ** 2 + (p[4].y - p[1].y) ** 2) AS b FROM regions)
SELECT image_id, seq::INT AS seq, round(w / 2, 6) AS center_x, round(y + 15, 6) AS center_y, round(greatest(1.0, a), 6) AS width, round(greatest(1.0, b), 6) AS height, round(degrees(atan2(p[2].y - p[1].y, p[2].x - p[1].x)), 6) AS rotation FROM s""")
def a14(spark, d):
    b = regions(spark, d).select("image_id", "seq", g.quad_to_box(F.col("polygon")).alias("b"))
    return b.select("image_id", "seq", *[F.round(F.col(f"b.{c}"), 6).alias(n) for c, n in (("center_x", "center_x"), ("center_y", "center_y"), ("width", "width"), ("height", "height"), ("rotation_degrees", "rotation"))])


_PARTS = "SELECT p_partkey AS id, p_retailprice AS cx, p_size * 10.0 AS cy, 20.0 + p_size AS bw, 10.0 + p_size / 2.0 AS bh, (p_partkey % 12) * 7.0 AS deg FROM part"


def _boxes(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), g.box(F.col("p_retailprice"), F.col("p_size") * 10.0, 20.0 + F.col("p_size"), 10.0 + F.col("p_size") / 2.0, (F.col("p_partkey") % 12) * 7.0).alias("b"))
    return rows


@query("a15_box_to_quad", f"""WITH b AS ({_PARTS}), c AS (SELECT *, radians(deg) AS a FROM b),
k AS (SELECT id, list_transform([[-bw / 2, -bh / 2], [bw / 2, -bh / 2], [bw / 2, bh / 2], [-bw / 2, bh / 2]], lambda v: {{'x': cx + v[1] * cos(a) - v[2] * sin(a), 'y': cy + v[1] * sin(a) + v[2] * cos(a)}}) AS p FROM c),
m AS (SELECT id, p, list_min(list_transform(p, lambda q: {{'k': q.x + q.y, 'y': q.y, 'x': q.x}})) AS m FROM k)
SELECT id, round(m.x, 6) AS x0, round(m.y, 6) AS y0, round({_AREA.format(p='p')}, 5) AS area, list_bool_and(list_transform(p, lambda q: q.x >= 0 AND q.y >= 0 AND q.x <= 1200 AND q.y <= 500)) AS inside FROM m""")
def a15(spark, d):
    rows = _boxes(spark, d).select("id", "b", g.box_to_quad(F.col("b")).alias("q"))
    return rows.select("id", F.round(F.col("q")[0]["x"], 6).alias("x0"), F.round(F.col("q")[0]["y"], 6).alias("y0"), F.round(g.signed_area(F.col("q")), 5).alias("area"), g.box_inside(F.col("b"), F.lit(1200), F.lit(500)).alias("inside"))


@query("a16_extend_quad", f"""WITH {REGIONS_SQL}, e AS (SELECT image_id, seq, w, y, length(text) AS n, least(999.0, greatest(0.0, w + w / length(text) * 2 * 1.1)) AS x1, least(999.0, y) AS ya, least(999.0, y + 30) AS yb FROM regions WHERE length(text) > 0)
SELECT image_id, seq::INT AS seq, yb > ya AS valid, CASE WHEN yb > ya THEN round(x1, 6) END AS x1, CASE WHEN yb > ya THEN round(yb, 6) END AS y2 FROM e""")
def a16(spark, d):
    rows = regions(spark, d).where(F.length("text") > 0)
    q = rows.select("image_id", "seq", g.extend_quad(g.order_quad(F.col("polygon")), F.lit(1), F.lit(2), F.length("text"), F.lit(1000), F.lit(1000)).alias("q"))
    return q.select("image_id", "seq", F.col("q").isNotNull().alias("valid"), F.round(F.col("q")[1]["x"], 6).alias("x1"), F.round(F.col("q")[2]["y"], 6).alias("y2"))


_ARC = "SELECT p_partkey AS id, 0.0 AS sx, 20.0 AS sy, p_retailprice / 20 AS kx, -1.0 * p_size AS ky, 100.0 AS ex, 20.0 + p_partkey % 7 AS ey FROM part"


def _arcs(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), g.arc(g.point(F.lit(0.0), F.lit(20.0)), g.point(F.col("p_retailprice") / 20, -1.0 * F.col("p_size")), g.point(F.lit(100.0), 20.0 + F.col("p_partkey") % 7)).alias("a"))


_AT = "(1 - {t}) * (1 - {t}) * s{c} + 2 * (1 - {t}) * {t} * k{c} + {t} * {t} * e{c}"


def _steps_sql(n: int) -> str:
    hop = lambda i: "sqrt(" + " + ".join(f"power(({_AT.format(t=f'({i} / {n}.0::DOUBLE)', c=c)}) - ({_AT.format(t=f'(({i} - 1) / {n}.0::DOUBLE)', c=c)}), 2)" for c in "xy") + ")"
    return f"list_transform(range(1, {n + 1}), lambda i: {hop('i')})"


@query("a17_arc", f"""WITH a AS ({_ARC}) SELECT id, round({_AT.format(t='0.25', c='x')}, 6) AS x, round({_AT.format(t='0.25', c='y')}, 6) AS y, round(2 * (0.75 * (kx - sx) + 0.25 * (ex - kx)), 6) AS tx, round(2 * (0.75 * (ky - sy) + 0.25 * (ey - ky)), 6) AS ty, round(list_sum({_steps_sql(96)}), 6) AS length FROM a""")
def a17(spark, d):
    q = F.lit(0.25)
    return _arcs(spark, d).select("id", F.round(g.arc_point(F.col("a"), q)["x"], 6).alias("x"), F.round(g.arc_point(F.col("a"), q)["y"], 6).alias("y"), F.round(g.arc_tangent(F.col("a"), q)["x"], 6).alias("tx"), F.round(g.arc_tangent(F.col("a"), q)["y"], 6).alias("ty"), F.round(g.arc_length(F.col("a")), 6).alias("length"))


@query("a18_transform_arc", f"""WITH b AS ({_PARTS}), c AS (SELECT *, radians(deg) AS a FROM b)
SELECT id, round(cx + bh * 0.35 * sin(a), 6) AS kx, round(cy - bh * 0.35 * cos(a), 6) AS ky, round(300.0 + 20.0, 6) AS moved_sx, round(400.0 - 40.0 / 2, 6) AS moved_sy, round(300.0 + 60.0 * 0.35, 6) AS moved_kx FROM c""")
def a18(spark, d):
    target = g.box(F.lit(320.0), F.lit(400.0), F.lit(40.0), F.lit(60.0), F.lit(90.0))
    rows = _boxes(spark, d).select("id", "b", g.default_arc(F.col("b"), F.lit(0.35)).alias("a")).select("id", "a", g.transform_arc(F.col("a"), F.col("b"), target).alias("m"))
    return rows.select("id", F.round("a.control.x", 6).alias("kx"), F.round("a.control.y", 6).alias("ky"), F.round("m.start.x", 6).alias("moved_sx"), F.round(F.col("m.start.y"), 6).alias("moved_sy"), F.round(F.col("m.control.x") - 20, 6).alias("moved_kx"))


@query("a19_arc_position", f"""WITH a AS ({_ARC}), s AS (SELECT id, {_steps_sql(192)} AS d FROM a), u AS (SELECT id, unnest(d) AS d, generate_subscripts(d, 1) AS i FROM s),
r AS (SELECT id, i, d, sum(d) OVER (PARTITION BY id ORDER BY i) AS run, 20.0 + id % 50 AS goal FROM u),
f AS (SELECT id, min(i) FILTER (goal <= run) AS k FROM r GROUP BY id)
SELECT f.id, round(coalesce((f.k - 1 + (r.goal - (r.run - r.d)) / r.d) / 192, 1.0), 6) AS position FROM f LEFT JOIN r ON r.id = f.id AND r.i = f.k""")
def a19(spark, d):
    return _arcs(spark, d).select("id", F.round(g.arc_position_at(F.col("a"), 20.0 + F.col("id") % 50), 6).alias("position"))


_CROP = """c AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity::INT AS x, (l_suppkey % 60)::INT AS y, 200 AS w, 100 AS h FROM lineitem),
k AS (SELECT *, greatest(0, x - 8) AS x0, greatest(0, y - 8) AS y0, least(w, x + 40 + 8 + 1) AS x1, least(h, y + 15 + 8 + 1) AS y1 FROM c),
q AS (SELECT *, greatest(x1 - x0, y1 - y0) AS side FROM k), z AS (SELECT *, greatest(0, least(w - side, (x0 + x1) // 2 - side // 2)) AS sx, greatest(0, least(h - side, (y0 + y1) // 2 - side // 2)) AS sy FROM q)"""


@query("a20_crops", f"WITH {_CROP} SELECT id, n, x0, y0, x1, y1, sx, sy, least(w, sx + side) AS sx1, least(h, sy + side) AS sy1, least(w, (x + 0.5 + 20.25 + 0.999)::DECIMAL(9, 3)::DOUBLE).trunc()::INT AS mx1 FROM z")
def a20(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("x"), (F.col("l_suppkey") % 60).cast("int").alias("y"))
    w, h = F.lit(200), F.lit(100)
    rows = rows.withColumn("c", g.clamp_crop(F.col("x"), F.col("y"), F.col("x") + 40, F.col("y") + 15, 8, w, h)).withColumn("s", g.square_crop(F.col("c"), w, h))
    b = g.box(F.col("x") + 0.5, F.col("y") + 20.0, F.lit(40.5), F.lit(10.0), F.lit(0.0))
    return rows.select("id", "n", "c.*", F.col("s.x0").alias("sx"), F.col("s.y0").alias("sy"), F.col("s.x1").alias("sx1"), F.col("s.y1").alias("sy1"), g.manual_crop(b, w, h)["x1"].alias("mx1"))


_LUM = "({c}[1] * 0.2126 + {c}[2] * 0.7152 + {c}[3] * 0.0722)"
_LIN = "list_transform({v}, lambda v: CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE power((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


@query("a21_contrast_ratio", f"""WITH c AS (SELECT p_partkey AS id, {_LIN.format(v='[p_partkey % 256, (p_partkey * 7) % 256, p_size * 5]')} AS a, {_LIN.format(v='[p_size * 3, 255 - p_size, (p_partkey * 3) % 256]')} AS b FROM part),
l AS (SELECT id, {_LUM.format(c='a')} AS a, {_LUM.format(c='b')} AS b FROM c) SELECT id, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio FROM l""")
def a21(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("id"), F.round(g.contrast_ratio(F.array(k % 256, k * 7 % 256, s * 5), F.array(s * 3, 255 - s, k * 3 % 256)), 6).alias("ratio"))
