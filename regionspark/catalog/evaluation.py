"""Queries G4-G8, G10-G20, J13, J14, W3, P4."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionspark.functions import geometry as g
from regionspark.operators import evaluate as e
from regionspark.plans import groups
from regionspark.surrogates import REGIONS_SQL, regions, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _shifted(spark, d):
    rows = regions(spark, d).where(F.length("text") > 0).select(F.col("image_id").alias("sample_id"), "seq", "polygon")
    move, q = (F.col("seq") % 3) * 10.0, F.col("polygon")
    return rows, rows.withColumn("polygon", F.array(*[g.point(q[i]["x"], q[i]["y"] + move) for i in range(4)]))  # a lambda is not compiled


_PAIRS = f"""{REGIONS_SQL}, e AS (SELECT image_id AS sample_id, seq::INT AS seq, w, y FROM regions WHERE w > 0), p AS (SELECT sample_id, seq, w, y + seq % 3 * 10.0 AS y FROM e),
o AS (SELECT e.sample_id, e.seq AS seq_e, p.seq AS seq_p, least(e.w, p.w) * greatest(0.0, least(e.y, p.y) + 30 - greatest(e.y, p.y)) AS o, 30 * e.w + 30 * p.w AS s FROM e JOIN p ON p.sample_id = e.sample_id AND abs(p.seq - e.seq) <= 1),
pairs AS (SELECT sample_id, seq_e, seq_p, o / (s - o) AS iou FROM o WHERE o > 0)"""


@query("j13_score_pairs", f"WITH {_PAIRS} SELECT sample_id, seq_e, seq_p, round(iou, 9) AS iou FROM pairs")
def j13(spark, d):
    return e.score_pairs(*_shifted(spark, d)).withColumn("iou", F.round("iou", 9))


@query("g5_greedy_matching", f"WITH {_PAIRS} SELECT sample_id, seq_e::BIGINT AS seq_e, seq_p::BIGINT AS seq_p FROM pairs WHERE iou >= 0.5")
def g5(spark, d):
    return e.match_greedily(e.score_pairs(*_shifted(spark, d)))


# DuckDB's edit distance counts bytes, so the letters beyond ASCII (32 at most) become control characters first
@query("g6_character_errors", f"""WITH {REGIONS_SQL}, f AS (SELECT string_agg(c, '' ORDER BY c) AS letters FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM documents)),
x AS (SELECT image_id AS sample_id, seq::INT AS seq, text, translate(text, letters, {' || '.join(f'chr({i})' for i in (*range(1, 32), 127))}) AS a FROM regions, f)
SELECT sample_id, seq, (CASE WHEN seq % 5 = 4 THEN greatest(1, length(text)) ELSE levenshtein(a, replace(a, 'e', 'o') || 'x') END)::INT AS errors FROM x""")
def g6(spark, d):
    """Whole lines against an edited copy; every fifth has no counterpart."""
    rows = regions(spark, d).select(F.col("image_id").alias("sample_id"), "seq", F.col("text").alias("a"))
    b = F.when(F.col("seq") % 5 != 4, F.concat(F.regexp_replace("a", "e", "o"), F.lit("x")))
    return rows.select("sample_id", "seq", e.character_errors(F.col("a"), b).alias("errors"))


@query("g4_recognition_metrics", f"""WITH {_PAIRS}, l AS (SELECT image_id AS sample_id, language_code AS language, seq::INT AS seq, length(text) AS n FROM regions WHERE w > 0),
k AS (SELECT l.*, seq % 11 <> 10 AND EXISTS (SELECT 1 FROM pairs WHERE pairs.sample_id = l.sample_id AND seq_e = l.seq AND iou >= 0.5) AS hit FROM l),
s AS (SELECT language, sample_id, count(*) AS n_expected, count(*) FILTER (hit) AS n_matched, sum(n) AS n_chars, sum(CASE WHEN hit THEN 1 ELSE greatest(1, n) END) AS n_errors FROM k GROUP BY ALL),
a AS (SELECT language, count(*) AS samples, sum(n_expected)::BIGINT AS expected, sum(n_matched)::BIGINT AS matched, sum(n_chars)::BIGINT AS characters, sum(n_errors)::BIGINT AS errors, round(avg(n_chars * 0.5), 6) AS mean_elapsed_ms, max(sample_id * 10) AS max_rss, count(*) FILTER (n_matched < n_expected) AS n_failed FROM s GROUP BY language),
b AS (SELECT *, round(matched / expected, 9) AS recall, round(greatest(0.0, 1 - errors / characters), 9) AS accuracy FROM a)
SELECT *, CASE WHEN recall >= 0.9 AND accuracy >= 0.9 THEN 'passed' ELSE 'failed' END AS verdict FROM b""")
def g4(spark, d):
    """Lines as expected regions against shifted ones, each eleventh not recognised: matched by G5, compared by G6."""
    expected, found = _shifted(spark, d)
    texts = regions(spark, d).where(F.length("text") > 0).select(F.col("image_id").alias("sample_id"), "seq", F.col("language_code").alias("language"), "text")
    matched = e.match_greedily(e.score_pairs(expected, found.where("seq % 11 <> 10"))).select("sample_id", F.col("seq_e").cast("int").alias("seq"), "seq_p")
    each = texts.join(matched, ["sample_id", "seq"], "left").withColumn("errors", e.character_errors(F.col("text"), F.when(F.col("seq_p").isNotNull(), F.concat("text", F.lit("x"))), ends=True))
    n, hit = F.count("*"), F.count("seq_p")
    samples = each.groupBy("language", "sample_id").agg(n.alias("n_expected"), hit.alias("n_matched"), F.sum(F.length("text")).alias("n_chars"), F.sum("errors").alias("n_errors"))
    samples = samples.withColumns({"elapsed_ms": F.col("n_chars") * 0.5, "rss": F.col("sample_id") * 10, "failed": F.col("n_matched") < F.col("n_expected")})
    return e.recognition_metrics(samples).withColumns({c: F.round(c, 9) for c in ("recall", "accuracy")}).withColumn("mean_elapsed_ms", F.round("mean_elapsed_ms", 6))


@query("g7_repair_summary", "SELECT l_returnflag AS backend, l_linestatus AS strategy, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS max, sum(l_quantity) AS sum FROM lineitem GROUP BY ALL")
def g7(spark, d):
    out = e.repair_summary(table(spark, d, "lineitem").selectExpr("l_returnflag AS backend", "l_linestatus AS strategy", "l_quantity"), ["backend", "strategy"], "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p95")})


@query("g7_sketched_summary", "SELECT l_returnflag AS backend, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS max, count(*) > 0 AS median_ok, count(*) > 0 AS p95_ok FROM lineitem GROUP BY 1")
def g7_sketched(spark, d):
    """Sketches by flag and status, merged to flags; whether the quantiles' own ranks among all rows are near enough."""
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag AS backend", "l_linestatus AS strategy", "l_extendedprice AS v")
    out = e.sketched_summary(e.repair_sketches(rows, ["backend", "strategy"], "v"), ["backend"])
    near = lambda q, rank: (F.avg((F.col("v") < F.col(q)).cast("int")) <= rank + e.RANK_ERROR) & (F.avg((F.col("v") <= F.col(q)).cast("int")) >= rank - e.RANK_ERROR)
    ok = rows.join(out.select("backend", "median", "p95"), "backend").groupBy("backend").agg(near("median", 0.5).alias("median_ok"), near("p95", 0.95).alias("p95_ok"))
    return out.join(ok, "backend").select("backend", "n", F.round("mean", 4).alias("mean"), "max", "median_ok", "p95_ok")


@query("g8_risk_cases", """WITH x AS (SELECT l_orderkey AS case_id, l_linenumber AS n, list_filter([CASE WHEN 1 - l_discount < 0.95 THEN 'low_ssim' END, CASE WHEN l_quantity > 10 THEN 'high_mae' END, CASE WHEN l_tax * 5 > 0.2 THEN 'high_gmsd' END], lambda v: v IS NOT NULL) AS flags FROM lineitem) SELECT * FROM x WHERE len(flags) > 0""")
def g8(spark, d):
    flags = e.risk_flags(1 - F.col("l_discount"), F.col("l_quantity"), F.col("l_tax") * 5)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), flags.alias("flags")).where(F.size("flags") > 0)


_BK = "SELECT o_custkey % {m} AS case_id, count(*) AS line_count, max(o_orderpriority) AS directions FROM orders GROUP BY 1"


def _layouts(spark, d):
    """Lines as layouts of two lines each: every fifth is cut inside a grapheme, some lack a glyph or end beyond the width."""
    rows = regions(spark, d).select("image_id", "seq", F.concat(F.lit("e\u0301"), "text").alias("text")).withColumn("n", F.length("text"))
    cut = F.when(F.col("seq") % 5 == 0, 1).otherwise(2)
    line = lambda a, b, glyph: F.struct(a.alias("text_start"), b.alias("text_end"), F.lit("ltr").alias("direction"), F.array(F.struct(a.alias("text_start"), b.alias("text_end"), F.array(F.lit(7), glyph).alias("glyph_ids"))).alias("clusters"))
    lines = F.array(line(F.lit(0), cut, F.lit(5)), line(cut, F.col("n"), (F.col("seq") % 7).cast("int")))
    return rows.select(F.concat_ws("-", "image_id", "seq").alias("case_id"), "text", F.lit(100).alias("width"), lines.alias("lines"), F.array(F.lit(2.0), F.lit(0.0), F.least(F.col("n") * 1.0, F.lit(120.0)), F.lit(9.0)).alias("ink_bounds"))


@query("g9_layout_violations", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), x AS (SELECT *, length(t) + 2 AS n FROM l)
SELECT doc_id || '-' || seq AS case_id, list_filter([CASE WHEN seq % 7 = 0 THEN 'missing_glyph' END, CASE WHEN seq % 5 = 0 THEN 'splits_grapheme' END, CASE WHEN seq % 5 <> 0 AND n = 2 THEN 'range' END, CASE WHEN 2 + least(n, 120) > 101 THEN 'outside' END], lambda v: v IS NOT NULL) AS violations FROM x""")
def g9(spark, d):
    return e.layout_violations(_layouts(spark, d))


@query("g10_comparison_report", f"""WITH a AS ({_BK.format(m=700)}), b AS ({_BK.format(m=350)}) SELECT count(*) AS common, count(*) FILTER (a.line_count = b.line_count) AS line_count_matches, count(*) FILTER (a.directions = b.directions) AS directions_matches,
(SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b)) - count(*) AS missing_pairs FROM a JOIN b USING (case_id)""")
def g10(spark, d):
    side = lambda m: table(spark, d, "orders").groupBy(F.expr(f"o_custkey % {m}").alias("case_id")).agg(F.count("*").alias("line_count"), F.max("o_orderpriority").alias("directions"))
    return e.comparison_report(side(700), side(350), "case_id", ["line_count", "directions"])


@query("g11_evidence_gate", """WITH x AS (SELECT count(*) >= 100 AS enough, bool_and(l_quantity > 0) AS preserved, max(l_quantity) - min(l_quantity) <= 5 AS stable FROM lineitem)
SELECT unnest(['enough', 'preserved', 'stable', 'passed']) AS "check", unnest([enough, preserved, stable, enough AND preserved AND stable]) AS ok FROM x""")
def g11(spark, d):
    q = F.col("l_quantity")
    return e.evidence_gate(table(spark, d, "lineitem"), {"enough": F.count("*") >= 100, "preserved": F.bool_and(q > 0), "stable": F.max(q) - F.min(q) <= 5})


_W = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS w{i}" for i in range(8))


@query("g12_layout_signature", f"""WITH x AS (SELECT o_orderstatus AS backend, sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}}') AS h FROM orders), s AS (SELECT backend, count(*) AS n, {_W} FROM x GROUP BY backend)
SELECT backend, n, sha256(concat_ws('|', n, {', '.join(f'w{i}' for i in range(8))})) AS signature FROM s""")
def g12(spark, d):
    return e.layout_signature(table(spark, d, "orders").selectExpr("o_orderstatus AS backend", "o_orderkey", "o_orderpriority"), "backend", ["o_orderkey", "o_orderpriority"])


@query("g12_canonical_signature", """WITH c AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'one' ELSE 'two' END AS backend, o_orderkey AS k FROM orders),
j AS (SELECT backend, '"' || k || '":{"lines":[{"clusters":[[0,' || k % 7 || '],[' || k % 7 || ',9]],"direction":"ltr","range":[0,9]}]}' AS j, k::VARCHAR AS s FROM c),
b AS (SELECT backend, '"' || backend || '":{' || string_agg(j, ',' ORDER BY s) || '}' AS b FROM j GROUP BY backend)
SELECT (SELECT count(*) FROM c) AS n, sha256('{' || string_agg(b, ',' ORDER BY backend) || ',"zero":{}}') AS signature FROM b""")
def g12_canonical(spark, d):
    k = F.col("o_orderkey")
    cluster = lambda a, b: F.struct(a.alias("text_start"), b.alias("text_end"))
    line = F.struct(F.lit(0).alias("text_start"), F.lit(9).alias("text_end"), F.lit("ltr").alias("direction"), F.array(cluster(F.lit(0), (k % 7).cast("int")), cluster((k % 7).cast("int"), F.lit(9))).alias("clusters"))
    rows = table(spark, d, "orders").select(F.when(k % 2 == 0, "one").otherwise("two").alias("backend"), k.cast("string").alias("case_id"), F.array(line).alias("lines"), F.lit("p").alias("path"))
    return e.canonical_signature(rows, ("two", "one", "zero"))


@query("g13_versions_agree", "SELECT min(p_brand) = max(p_brand) AND bool_and(regexp_full_match(p_brand, 'Brand#[0-9]+')) AS agree, count(*) AS n FROM part")
def g13(spark, d):
    return e.versions_agree(table(spark, d, "part"), "p_brand", r"^Brand#[0-9]+\z")


@query("g14_mask_bounds", f"WITH {REGIONS_SQL} SELECT image_id, 0.0 AS min_x, min(y) AS min_y, max(w) AS max_x, max(y) + 30 AS max_y FROM regions GROUP BY image_id")
def g14(spark, d):
    return groups.mask_bounds(regions(spark, d))


_W3 = f"""{REGIONS_SQL}, t AS (SELECT image_id, seq, text, w, y, image_id % 4 = 0 AND seq % 5 <> 4 AS upright FROM regions),
v AS (SELECT *, length(text) >= 10 AND lag(length(text)) OVER o >= 10 AND upright AND lag(upright) OVER o AND least(w, lag(w) OVER o) >= 0.65 * least(w, lag(w) OVER o) AS c FROM t WINDOW o AS (PARTITION BY image_id ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN coalesce(c, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY seq) AS paragraph FROM v)"""


def _paragraphs(spark, d):
    """All lines; each fifth is no running text to the rule."""
    rows = regions(spark, d).withColumn("target_language", F.lit("en"))
    return groups.paragraphs(rows, F.col("seq") % 5 != 4)


@query("w3_paragraphs", f"WITH {_W3} SELECT image_id, seq::INT AS seq, paragraph::BIGINT AS paragraph FROM g")
def w3(spark, d):
    return _paragraphs(spark, d).select("image_id", "seq", "paragraph")


@query("g15_paragraph_boxes", f"WITH {_W3} SELECT image_id, paragraph::BIGINT AS paragraph, 0.0 AS min_x, min(y) AS min_y, max(w) AS max_x, max(y) + 30 AS max_y, string_agg(text, ' ' ORDER BY seq) AS text FROM g GROUP BY image_id, paragraph")
def g15(spark, d):
    return groups.paragraph_boxes(_paragraphs(spark, d))


def _layers(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("k"))
    box = g.box(100.0 + F.col("k") % 40, 40.0 * F.col("l_linenumber"), 50.0 + F.col("q"), F.lit(30.0), F.lit(0.0))
    gray = [F.col("q").alias(c) for c in ("r", "g", "b")] + [(100.0 + F.col("k") % 30).alias(c) for c in ("bg_r", "bg_g", "bg_b")]
    return rows.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), box.alias("box"), F.lit("f").alias("font_family"), *gray, F.lit(0.0).alias("chroma"), (F.col("k") % 50 * 1.0).alias("texture"), F.lit(False).alias("has_path"), (10.0 + F.col("k") % 9).alias("font_size"), F.lit(100).alias("font_stretch"))


_LAYERS = """y AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, min(l_quantity) AS q, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
pairs AS (SELECT a.image_id, a.seq AS a, b.seq AS b FROM y a JOIN y b ON a.image_id = b.image_id AND a.seq < b.seq AND b.seq - a.seq = 1 AND abs(a.k % 40 - b.k % 40) <= 19.5 AND sqrt(3 * (a.q - b.q) ** 2) <= 25 AND abs(a.k % 50 - b.k % 50) <= 35 AND sqrt(3 * (a.k % 30 - b.k % 30) ** 2) <= 60),
es AS (SELECT image_id, a, b FROM pairs UNION ALL SELECT image_id, b, a FROM pairs), reach(image_id, seq, root) AS (SELECT image_id, seq, seq FROM y UNION SELECT r.image_id, es.b, r.root FROM reach r JOIN es ON es.image_id = r.image_id AND es.a = r.seq),
comp AS (SELECT image_id, seq, min(root) AS component FROM reach GROUP BY image_id, seq)"""


@query("j14_visual_pairs", f"WITH RECURSIVE {_LAYERS} SELECT image_id, a, b FROM pairs")
def j14(spark, d):
    return groups.visual_pairs(_layers(spark, d))


@query("p4_visual_groups", f"WITH RECURSIVE {_LAYERS} SELECT image_id, seq, component FROM comp")
def p4(spark, d):
    layers = _layers(spark, d)
    return groups.visual_groups(layers, groups.visual_pairs(layers))


@query("g16_group_consensus", """WITH y AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, l_linenumber // 4 AS component, min(l_quantity) AS q, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
s AS (SELECT image_id, component, count(*) AS n, min(10.0 + k % 9) AS size, least(120.0, max(50.0 + q) * 1.25) AS w, median(100.0 + k % 40) AS x FROM y GROUP BY ALL)
SELECT image_id, seq, round(CASE WHEN n >= 3 THEN least(greatest(x, w / 2), 120 - w / 2) ELSE 100.0 + k % 40 END, 6) AS center_x, round(CASE WHEN n >= 3 THEN w ELSE 50.0 + q END, 6) AS width, CASE WHEN n >= 2 THEN size ELSE 10.0 + k % 9 END AS font_size FROM y JOIN s USING (image_id, component)""")
def g16(spark, d):
    layers = _layers(spark, d).withColumn("component", F.floor(F.col("seq") / 4))
    out = groups.group_consensus(layers, F.lit(120.0))
    return out.select("image_id", "seq", F.round("box.center_x", 6).alias("center_x"), F.round("box.width", 6).alias("width"), "font_size")


_PIX = "SELECT vec_id AS region_id, i AS x, round((v + 1) * 127) AS r, round((v + 1) * 100) AS g, round((1 - v) * 90) AS b, i % 5 = 0 AS border, i % 3 = 0 AS ring, i % 3 = 1 AS mask FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def _pixels(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("region_id"), F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    return rows.select("region_id", "x", F.round((F.col("v") + 1) * 127).alias("r"), F.round((F.col("v") + 1) * 100).alias("g"), F.round((1 - F.col("v")) * 90).alias("b"), (F.col("x") % 5 == 0).alias("border"), (F.col("x") % 3 == 0).alias("ring"), (F.col("x") % 3 == 1).alias("mask"))


@query("g17_background", f"WITH p AS ({_PIX}), m AS (SELECT region_id, median(r) AS r, median(g) AS g, median(b) AS b, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS t FROM p GROUP BY region_id) SELECT region_id, r, g, b, greatest(r, g, b) - least(r, g, b) AS chroma, round(t, 5) AS texture FROM m")
def g17(spark, d):
    return e.background(_pixels(spark, d)).withColumn("texture", F.round("texture", 5))


@query("g18_foreground", f"""WITH p AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS l FROM ({_PIX})), c AS (SELECT region_id, quantile_cont(l, 0.075) AS lo, quantile_cont(l, 0.925) AS hi FROM p GROUP BY 1),
m AS (SELECT region_id, {', '.join(f"median({c}) FILTER (l <= lo) AS d{c}, median({c}) FILTER (l >= hi) AS w{c}, median({c}) FILTER (border) AS e{c}" for c in 'rgb')} FROM p JOIN c USING (region_id) GROUP BY 1),
x AS (SELECT *, sqrt((dr - er) ** 2 + (dg - eg) ** 2 + (db - eb) ** 2) AS dd, sqrt((wr - er) ** 2 + (wg - eg) ** 2 + (wb - eb) ** 2) AS dw FROM m)
SELECT region_id, CASE WHEN dd >= dw THEN dr ELSE wr END AS r, CASE WHEN dd >= dw THEN dg ELSE wg END AS g, CASE WHEN dd >= dw THEN db ELSE wb END AS b FROM x WHERE greatest(dd, dw) >= 32""")
def g18(spark, d):
    out = e.foreground(_pixels(spark, d)).select("region_id", *[F.col("color")[i].alias(c) for i, c in enumerate("rgb")])
    plain = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b")) & F.col("r").isin(0.0, 255.0)
    return out.where(~plain)


@query("g19_image_errors", f"""WITH p AS ({_PIX}), q AS (SELECT region_id AS image_id, x, r, g, b, x % 4 = 0 AS masked, CASE WHEN x % 4 = 0 THEN 6 WHEN region_id % 3 = 0 AND x = 1 THEN 3 ELSE 0 END AS k FROM p)
SELECT image_id, round(avg(k * k), 6) AS mse, round(avg(k) FILTER (masked), 6) AS masked_mae, count(*) FILTER (NOT masked AND k > 0) AS outside_changed_pixels, max(CASE WHEN masked THEN 0 ELSE k END)::DOUBLE AS outside_max_delta, TRUE AS alpha_preserved, round(10 * log10(65025.0::DOUBLE / avg(k * k)), 6) AS psnr_db FROM q GROUP BY image_id""")
def g19(spark, d):
    a = _pixels(spark, d).select(F.col("region_id").alias("image_id"), "x", "r", "g", "b", F.lit(255).alias("a"), (F.col("x") % 4 == 0).alias("masked"))
    k = F.when(F.col("x") % 4 == 0, 6).when((F.col("image_id") % 3 == 0) & (F.col("x") == 1), 3).otherwise(0)
    b = a.select("image_id", "x", *[(F.col(c) + k).alias(c) for c in "rgb"], "a")
    return e.image_errors(a, b, ["image_id", "x"]).withColumns({c: F.round(c, 6) for c in ("mse", "masked_mae", "psnr_db")})


@query("g20_smooth_background", f"""WITH p AS ({_PIX}), m AS (SELECT region_id, median(r) AS mr, median(g) AS mg, median(b) AS mb, count(*) AS n_ring FROM p WHERE ring GROUP BY 1), t AS (SELECT *, sqrt((r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2) AS d FROM p JOIN m USING (region_id)),
a AS (SELECT region_id, any_value(n_ring) AS n_ring, quantile_cont(d, 0.9) FILTER (ring) AS p90, quantile_cont(d, 0.85) FILTER (mask) AS p85 FROM t GROUP BY 1)
SELECT region_id, n_ring, round(p90, 6) AS ring_p90, round(p85, 6) AS repair_p85, n_ring >= 10 AND p90 <= 30 AND p85 > 15 AS replace FROM a""")
def g20(spark, d):
    return e.smooth_background(_pixels(spark, d), spread=30, far=15, least=10).withColumns({c: F.round(c, 6) for c in ("ring_p90", "repair_p85")})
