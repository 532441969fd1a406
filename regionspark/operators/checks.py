"""Row and group checks: A22, A23, B1-B10. Each returns its input with a verdict column, so no row is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from regionspark import dims
from regionspark.functions import geometry as g
from regionspark.functions.text import strip
from regionspark.plans import boxes
from regionspark.session import written

SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
#: Labels and patterns of credentials.
SECRET_RULES = (
    ("private-key", r"(?i)-----BEGIN (?:RSA |EC |ENCRYPTED )?PRIVATE KEY-----\r?\n[A-Z0-9+/=\r\n]{64,}-----END (?:RSA |EC |ENCRYPTED )?PRIVATE KEY-----"),
    ("aws-access-key", r"AKIA[A-Z0-9]{16}"),
    ("database-credential", r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^:/\s@]+:[^@\s/]+@"),
    ("bearer-token", r"(?i)bearer\s+[a-z0-9._~+/=-]{20,}"),
    ("hardcoded-secret-assignment", r"(?i)(?:translator[_-]?key|api[_-]?key|secret[_-]?key|client[_-]?secret|access[_-]?token|password)\s*[\"']?\s*[:=]\s*[\"'][^\"'\r\n]{16,}[\"']"),
)
SENSITIVE_NAMES, SENSITIVE_SUFFIXES = (".env", "credentials.json", "service-account.json"), (".key", ".pem", ".p12", ".pfx")


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that fail, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in checks]))


def first_reason(*checks: tuple[Column, str]) -> Column:
    out = None
    for bad, name in checks:
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def confidence_status(df: DataFrame, confidence: str, text: str, threshold: float = 0.5) -> DataFrame:
    """Confidence held to [0, 1], status ok or low_confidence, empty texts dropped."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(confidence)))
    return df.where(F.col(text) != "").withColumn(confidence, clamped).withColumn("status", F.when(F.col(confidence) < threshold, "low_confidence").otherwise("ok"))


def accept_refinement(regions: DataFrame) -> DataFrame:
    """A23 on regions (image_id, seq, text, confidence, polygon, candidate, candidate_confidence, width, height): accepted
    if the candidate contains the text with one or two more characters, loses at most 0.005 confidence and its grown
    polygon covers no other region of the image more than before (by over one pixel).

    Candidates are grown once and written with their boxes; grown boxes meet their neighbours in cells that are cut where regions
    are dense. The blocked ones are joined back to the rows that have a grown polygon; the others need no join."""
    at = F.instr("candidate", F.col("text")) - 1
    extra = F.length("candidate") - F.length("text")
    ok = (F.length("candidate") > 0) & (at >= 0) & extra.between(1, 2) & (F.col("candidate_confidence") + 0.005 >= F.col("confidence"))
    grown = g.extend_quad(F.when(ok, F.col("polygon")), at, extra - at, F.greatest(F.lit(1), F.length("text")), F.col("width"), F.col("height"))
    rows = regions.select(F.struct(*[F.col(f"`{c}`") for c in regions.columns]).alias("row"), grown.alias("grown"))
    rows = written(rows.select("row", "grown", F.struct("row.seq", g.bbox(F.col("row.polygon")).alias("old")).alias("own"), F.when(F.col("grown").isNotNull(), g.bbox(F.col("grown"))).alias("new")))
    sides = rows.select("row.image_id", "own", "new", F.col("own.old").alias("old"))
    others = F.col("left.seq") != F.col("right.seq")
    hit = boxes.overlapping(sides.where("new is not null"), sides, ["image_id"], ("own", "own"), ("new", "old"), where=others, plain=True)
    more = g.overlap_area(F.col("left_box"), F.col("right_box")) > g.overlap_area(F.col("left.old"), F.col("right_box")) + 1
    hit = written(hit.select(F.col("image_id").alias("_i"), F.col("left.seq").alias("_s"), more.alias("_blocked")))  # as in score_pairs
    blocked = hit.where("_blocked").distinct()
    tried = rows.where("grown is not null").join(blocked, (F.col("row.image_id") == F.col("_i")) & (F.col("row.seq") == F.col("_s")), "left")
    tried = tried.select("row", "grown", F.col("_blocked").isNull().alias("accepted"))
    out = tried.unionByName(rows.where("grown is null").select("row", "grown", F.lit(False).alias("accepted")))
    after = {"text": "row.candidate", "confidence": "row.candidate_confidence", "polygon": "grown"}
    return out.select(*[F.when(F.col("accepted"), F.col(after[c])).otherwise(F.col(f"row.`{c}`")).alias(c) if c in after else F.col(f"row.`{c}`") for c in regions.columns], "accepted")


def check_image_limits(images: DataFrame, limits: DataFrame) -> DataFrame:
    """B1: `violation`, the first broken limit. limits is one row, so it is broadcast."""
    most = F.broadcast(limits.limit(1).select(*[F.col(c).alias(f"_{c}") for c in ("min_width", "min_height", "max_width", "max_height", "max_bytes", "max_pixels")]))
    pixels = F.col("width").cast("long") * F.col("height")
    verdict = first_reason(
        (F.col("file_size") > F.col("_max_bytes"), "file_too_large"), ((F.col("width") < F.col("_min_width")) | (F.col("height") < F.col("_min_height")), "dimensions_too_small"),
        ((F.col("width") > F.col("_max_width")) | (F.col("height") > F.col("_max_height")), "dimensions_too_large"), (pixels > F.col("_max_pixels"), "pixel_count_too_large"),
    )
    return images.join(most).select(*images.columns, verdict.alias("violation"))


def check_limit_values(df: DataFrame) -> DataFrame:
    """B2: limits are positive and no minimum exceeds its maximum."""
    bad = [(F.col(c) <= 0, f"{c}_not_positive") for c in ("min_width", "min_height", "max_width", "max_height", "max_bytes")]
    return df.withColumn("reasons", reasons(*bad, (F.col("min_width") > F.col("max_width"), "width_range"), (F.col("min_height") > F.col("max_height"), "height_range")))


def check_release_spec(df: DataFrame) -> DataFrame:
    """Reasons why a release specification is refused."""
    named = [(~F.col(c).rlike(SAFE_NAME), c) for c in ("model_id", "version", "filename")]
    target = F.struct("platform", "architecture").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in dims.TARGETS])
    key = F.col("object_key")
    return df.withColumn("reasons", reasons(
        *named, ((F.length("object_version") == 0) | (F.length("object_version") > 256) | F.col("object_version").rlike(r"[\x00-\x1F]"), "object_version"), (~target, "target"),
        ((key == "") | key.startswith("/") | F.array_contains(F.split(key, "/"), "..") | key.rlike(r"[\x00-\x1F]"), "object_key"), (F.col("size_bytes") <= 0, "size"), (~F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), "sha256"),
    ))


def check_release_manifest(df: DataFrame, now: Column) -> DataFrame:
    """B3, client side: reasons why an offered release is refused; instead of an object key it has a download_url (http or
    https, a host, no user or password) and its expiry (download_url_expires_at), which must lie after `now`."""
    named = [(~F.col(c).rlike(SAFE_NAME), c) for c in ("model_id", "version", "filename")]
    target = F.struct("platform", "architecture").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in dims.TARGETS])
    host = F.regexp_extract("download_url", r"^(?i:https?)://([^/?#]*)", 1)
    return df.withColumn("reasons", reasons(
        *named, ((F.length("object_version") == 0) | (F.length("object_version") > 256) | F.col("object_version").rlike(r"[\x00-\x1F]"), "object_version"), (~target, "target"), (F.col("size_bytes") <= 0, "size"),
        (~F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), "sha256"), (F.col("download_url_expires_at") <= now, "expired"), ((host == "") | host.rlike("^[^@]+@"), "download_url"),
    ))


def check_plan(df: DataFrame) -> DataFrame:
    """B4."""
    name = strip(F.col("name"))
    return df.withColumn("reasons", reasons((~F.length(name).between(1, 100), "name"), (F.col("amount_minor") < 0, "amount"), (~F.col("currency").rlike(r"^[A-Z]{3}\z"), "currency"), (~F.col("duration_days").between(1, 3650), "duration")))


def check_translation_requests(items: DataFrame) -> DataFrame:
    """B5 on (request_id, source_language, target_language, item_id, text): one row per request with reasons."""
    text = F.col("text")
    bad_item = ~F.coalesce(F.col("item_id").rlike(r"^[A-Za-z0-9._-]{1,64}\z") & F.length(text).between(1, 5000) & (strip(text) != ""), F.lit(False))
    each = items.groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("ids"), F.sum(F.length(text)).alias("chars"), F.bool_or(bad_item).alias("bad"), F.first("source_language").alias("source"), F.first("target_language").alias("target"))
    known = lambda c: F.col(c).isin(*dims.LANGUAGES)
    return each.select("request_id", "n", "chars", reasons((~F.col("n").between(1, 100), "item_count"), (F.col("ids") != F.col("n"), "item_ids"), (F.col("bad"), "item"), (F.col("chars") > 20_000, "characters"), (F.col("source").isNotNull() & ~known("source"), "source_language"), (~known("target"), "target_language")).alias("reasons"))


def check_batch_invariants(items: DataFrame) -> DataFrame:
    """B6 on (batch_id, item_id, status, current_stage, result_ref, error)."""
    n = F.count("*").over(W.partitionBy("batch_id", "item_id"))
    status = F.col("status")
    return items.withColumn("reasons", reasons(
        ((status == "completed") & F.col("result_ref").isNull(), "result_missing"), ((status == "failed") & F.col("error").isNull(), "error_missing"),
        (F.col("current_stage").isNotNull() & (status != "running"), "stage_not_running"), (n > 1, "duplicate_item"),
    ))


def parse_provider_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (request_id, pos, item_id) against responses (request_id, body: JSON array of {id, text}). Any defect of
    count, order or shape fails the whole request: (request_id, n, ok)."""
    got = responses.select("request_id", F.posexplode(F.from_json("body", "array<struct<id:string,text:string>>")).alias("pos", "r"))
    both = requests.join(got, ["request_id", "pos"], "full_outer")
    good = F.col("item_id").eqNullSafe(F.col("r.id")) & F.col("r.text").isNotNull()
    return both.groupBy("request_id").agg(F.count("item_id").alias("n"), F.bool_and(good).alias("ok"))


def exactly_one(a: Column, b: Column) -> Column:
    """B8."""
    return a.isNull() != b.isNull()


def looks_textual(text: Column) -> Column:
    """B9 gate: no NUL and at least 85 % of the first 64 KiB printable ASCII, tabs or line breaks; empty counts as text.
    UTF-8 that is mostly not Latin is binary to it, on purpose."""
    sample = F.decode(F.substring(F.encode(text, "UTF-8"), 1, 65536), "ISO-8859-1")
    printable = F.length(F.regexp_replace(sample, r"[^\t\n\r\x20-\x7E]", ""))
    return g.let(F.struct(F.length(sample).alias("n"), printable.alias("p"), sample.contains("\x00").alias("z")), lambda s: (s["n"] == 0) | (~s["z"] & (s["p"] >= 0.85 * s["n"])))


def secret_findings(df: DataFrame, path: str, text: str, rules=SECRET_RULES, gate: bool = True) -> DataFrame:
    """(path, label) of texts that match a rule, or sensitive-file by name; never the matched text. rules are parameters."""
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    sensitive = name.isin(*SENSITIVE_NAMES)
    for suffix in SENSITIVE_SUFFIXES:
        sensitive = sensitive | name.endswith(suffix)
    textual = looks_textual(F.col(text)) if gate else F.lit(True)
    labels = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), label) for label, p in rules]))
    found = F.when(sensitive, F.array(F.lit("sensitive-file"))).when(textual, labels).otherwise(F.array().cast("array<string>"))
    return df.select(F.col(path).alias("path"), F.explode(found).alias("label"))


def forbidden_literals(df: DataFrame, path: str, text: str, needles: list[str]) -> DataFrame:
    """(path, needle) of the literals found; a parameter list, so it is part of the plan."""
    return df.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*[F.when(F.col(text).contains(n), n) for n in needles]))).alias("needle"))
