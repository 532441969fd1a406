"""Registries: config versions, model releases, activation codes, audit."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from regionspark.streaming.jobs import batch

#: Fixed value: the symbols of activation codes.
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def latest_published(releases: DataFrame, platform: str, architecture: str) -> DataFrame:
    """Of each model the newest published release of a target; object keys stay private."""
    rows = releases.where((F.col("status") == "published") & (F.col("platform") == platform) & (F.col("architecture") == architecture))
    rank = F.row_number().over(W.partitionBy("model_id").orderBy(F.desc("release_id")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "object_key")


def config_lifecycle(log: DataFrame) -> DataFrame:
    """W2 on a log (scope, seq, action, version): create makes a draft, publish turns a draft into the current version,
    rollback to a version that is no draft makes a new current one. Per log row: outcome (ok, not_found, conflict), the
    version it made current, and whether that is published or superseded at the end of its scope's log.

    A version is created once; its publish is valid if it is the first after the creation, so validity needs no state
    beyond the version's own rows; each scope's valid publications then follow in order.
    """
    w = W.partitionBy("scope", "version").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    made = F.max((F.col("action") == "create").cast("int")).over(w)
    rows = log.withColumn("_made", F.coalesce(made, F.lit(0)))
    out = F.max(((F.col("action") == "publish") & (F.col("_made") == 1)).cast("int")).over(w)
    rows = rows.withColumn("_pub", F.coalesce(out, F.lit(0)))
    rows = rows.withColumn("outcome", F.when(F.col("action") == "create", F.when(F.col("_made") == 0, "ok").otherwise("conflict"))
        .when(F.col("_made") == 0, "not_found").when(F.col("action") == "publish", F.when(F.col("_pub") == 0, "ok").otherwise("conflict"))
        .otherwise(F.when(F.col("_pub") == 1, "ok").otherwise("conflict")))
    live = F.when((F.col("outcome") == "ok") & (F.col("action") != "create"), F.col("seq"))
    last = rows.withColumn("_live", live).groupBy(F.col("scope").alias("_s")).agg(F.max("_live").alias("_last"))  # one row a scope
    status = F.when(live.isNull(), None).when(live == F.col("_last"), "published").otherwise("superseded")
    source = F.when((F.col("action") == "rollback") & (F.col("outcome") == "ok"), F.col("version"))
    return rows.join(last, F.col("scope").eqNullSafe(F.col("_s")), "left").select(*log.columns, "outcome", status.alias("status"), source.alias("source_version"))


def _versions(state: dict, row: dict) -> dict:
    """One step of config_versions; the state is how many versions there are and which of them are drafts."""
    n, drafts, target = state.get("n", 0), state.setdefault("drafts", set()), row["version"]
    made = source = None
    if row["action"] == "create":
        outcome, made = "ok", n + 1
        drafts.add(made)
    elif target is None or not 1 <= target <= n:
        outcome = "not_found"
    elif (target in drafts) != (row["action"] == "publish"):
        outcome = "conflict"
    elif row["action"] == "publish":
        outcome, made = "ok", target
        drafts.remove(target)
    else:
        outcome, made, source = "ok", n + 1, target
    state["n"] = max(n, made or 0)
    return {"seq": row["seq"], "outcome": outcome, "made": made, "source_version": source}


def config_versions(log: DataFrame) -> DataFrame:
    """W2 with numbers from the log: (scope, seq, action, version) to (scope, seq, action, version, outcome, made,
    source_version, status). create makes the scope's next version, a draft; publish makes a draft current; rollback to a version
    that is no draft makes a new current version, with a number of its own, whose source it is. made: the version that the
    row made or published; status: published for the row of the scope's current version, superseded for earlier ones.

    Whether a rollback finds its target depends on the numbers given before, so a scope's log is folded in order; the fold holds
    the drafts only. The current version of a scope is one row, combined before the shuffle."""
    rows = log.select("scope", "seq", "action", F.col("version").cast("long").alias("version"), F.timestamp_micros(F.lit(0)).alias("ts"), F.col("seq").alias("id"))
    kind = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    done = batch(rows, ["scope"], _versions, f"scope {kind['scope']}, seq {kind['seq']}, outcome string, made long, source_version long")
    done = log.select("scope", "seq", "action", "version").join(done.withColumnsRenamed({"scope": "_s", "seq": "_q"}), F.col("scope").eqNullSafe(F.col("_s")) & (F.col("seq") == F.col("_q")))
    live = F.when((F.col("outcome") == "ok") & (F.col("action") != "create"), F.col("seq"))
    last = done.groupBy(F.col("scope").alias("_l")).agg(F.max(live).alias("_last"))
    status = F.when(live.isNotNull(), F.when(live == F.col("_last"), "published").otherwise("superseded"))
    return done.join(last, F.col("scope").eqNullSafe(F.col("_l")), "left").select("scope", "seq", "action", "version", "outcome", "made", "source_version", status.alias("status"))


def release_lifecycle(log: DataFrame) -> DataFrame:
    """P13 on (release_id, seq, status): a release goes from draft to published to withdrawn. A step is legal if it makes
    the next state from the present one, so the legal steps are the first draft, the first publication after it and the
    first withdrawal after that; all others change nothing. (release_id, status: null without a draft, n_illegal)."""
    w = W.partitionBy("release_id")
    first = lambda status, after=None: F.min(F.when((F.col("status") == status) & (F.lit(True) if after is None else F.col("seq") > F.col(after)), F.col("seq"))).over(w)
    rows = log.withColumn("_draft", first("draft")).withColumn("_published", first("published", "_draft")).withColumn("_withdrawn", first("withdrawn", "_published"))
    each = rows.groupBy("release_id").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("_draft", "_published", "_withdrawn")])
    made = [F.col(c).isNotNull() for c in ("_draft", "_published", "_withdrawn")]
    status = F.when(made[2], "withdrawn").when(made[1], "published").when(made[0], "draft")
    return each.select("release_id", status.alias("status"), (F.col("n") - made[0].cast("long") - made[1].cast("long") - made[2].cast("long")).alias("n_illegal"))


def compare_installed(manifest: DataFrame, installed: DataFrame, fields=("version", "object_version", "sha256", "size_bytes")) -> DataFrame:
    """up_to_date where all fields agree (nulls too), else install; target_mismatch where the manifest's target is another."""
    have = installed.select(F.col("model_id").alias("_m"), *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.col("_m").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return manifest.join(have, F.col("model_id") == F.col("_m"), "left").withColumn("action", F.when(~F.col("target_ok"), "target_mismatch").when(same, "up_to_date").otherwise("install")).select(*manifest.columns, "action")


def verify_content(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Declared (name, size_bytes, sha256) against files (name, content binary)."""
    actual = files.select("name", F.octet_length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"))
    verdict = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size_bytes"), "size_mismatch").when(F.col("_sha") != F.col("sha256"), "hash_mismatch").otherwise("ok")
    return declared.join(actual, "name", "left").select(*declared.columns, verdict.alias("verdict"))


def authorise(requests: DataFrame, codes: DataFrame, now: Column) -> DataFrame:
    """Whether the token is that of an enabled, unexpired code."""
    have = codes.select(F.col("token_digest").alias("_t"), F.col("disabled").alias("_d"), F.col("expires_at").alias("_e"))
    return requests.join(have, F.col("token_digest") == F.col("_t"), "left").select(*requests.columns, F.coalesce(~F.col("_d") & (F.col("_e") > now), F.lit(False)).alias("authorised"))


def first_binder(attempts: DataFrame) -> DataFrame:
    """W4 on (code, device, ts, attempt_id, duration_days): the first attempt fixes device and expiry; combined before the shuffle."""
    first = F.min(F.struct("ts", "attempt_id", "device", "duration_days"))
    return attempts.groupBy("code").agg(first.alias("m")).select("code", F.col("m.device").alias("device"), F.col("m.ts").alias("activated_at"), (F.col("m.ts") + F.make_dt_interval(F.col("m.duration_days"))).alias("expires_at"))


def last_token(activations: DataFrame, disables: DataFrame) -> DataFrame:
    """Of each code the token of its last activation, null once it is disabled after that or before."""
    last = activations.groupBy("code").agg(F.max_by("token", F.struct("ts", "attempt_id")).alias("token"))
    off = disables.select("code").distinct().withColumn("_off", F.lit(True))
    return last.join(off, "code", "left").select("code", F.when(F.col("_off").isNull(), F.col("token")).alias("token"))


def activation_outcomes(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """P10: attempts (attempt_id, code, device, ts) against codes (code, duration_days, disabled_at): invalid_code,
    code_disabled (as of the attempt), device_mismatch, code_expired (expires_at <= ts) or ok. The device is bound by
    the first attempt that finds the code and finds it enabled."""
    known = codes.select(F.col("code").alias("_c"), "duration_days", "disabled_at")
    rows = attempts.join(known, F.col("code") == F.col("_c"), "left")
    rows = rows.withColumn("_off", F.coalesce(F.col("disabled_at") <= F.col("ts"), F.lit(False)))
    bound = first_binder(rows.where("_c is not null and not _off").select("code", "device", "ts", "attempt_id", "duration_days"))
    bound = bound.select(F.col("code").alias("_b"), F.col("device").alias("_device"), F.col("expires_at").alias("_expires"))
    rows = rows.join(bound, F.col("code") == F.col("_b"), "left")
    outcome = F.when(F.col("_c").isNull(), "invalid_code").when(F.col("_off"), "code_disabled").when(F.col("device") != F.col("_device"), "device_mismatch").when(F.col("_expires") <= F.col("ts"), "code_expired").otherwise("ok")
    return rows.select(*attempts.columns, outcome.alias("outcome"))


def binder_outcomes(log: DataFrame) -> DataFrame:
    """X4 on a log (code, id, ts, event activate or disable, device, days), in (ts, id) order: (code, id, outcome).

    The first activation binds its device unless the code was disabled before it, and a disable refuses all that follows; so a
    code's state is two least rows, combined before the shuffle, and a code with very many rows is split by the skew join."""
    rows = log.select("code", "id", "ts", "event", "device", "days").withColumn("_at", F.struct("ts", "id"))
    first = F.min_by(F.struct("device", (F.col("ts") + F.make_dt_interval(days="days")).alias("expires")), F.when(F.col("event") != "disable", F.col("_at")))
    state = rows.groupBy(F.col("code").alias("_c")).agg(first.alias("_first"), F.min(F.when(F.col("event") == "disable", F.col("_at"))).alias("_off"))
    rows = rows.join(state, F.col("code").eqNullSafe(F.col("_c")))
    outcome = (
        F.when(F.col("event") == "disable", "disabled").when(F.col("_off") < F.col("_at"), "code_disabled")
        .when(~F.col("_first.device").eqNullSafe(F.col("device")), "device_mismatch").when(F.col("_first.expires") <= F.col("ts"), "code_expired").otherwise("ok")
    )
    return rows.select("code", "id", outcome.alias("outcome"))


def code_status(disabled: Column, device: Column, expires_at: Column, now: Column) -> Column:
    """P11."""
    return F.when(disabled, "disabled").when(expires_at <= now, "expired").when(device.isNotNull(), "active").otherwise("unbound")


def issue_codes(plans: DataFrame, seed: str) -> DataFrame:
    """P8 on (plan_id, n, duration_days, enabled): n codes (1 to 100) of each enabled plan, 32 symbols from a keyed hash,
    the duration frozen. (plan_id, code, duration_days, unique)."""
    rows = plans.where(F.col("enabled") & F.col("n").between(1, 100)).select("plan_id", "duration_days", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    digest = F.sha2(F.concat_ws("|", F.lit(seed), "plan_id", "i"), 256)
    symbol = lambda k: F.substring(F.lit(ALPHABET), (F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int") % 32 + 1), F.lit(1))
    groups = [F.concat(*[symbol(4 * b + k) for k in range(4)]) for b in range(8)]
    rows = rows.select("plan_id", F.concat_ws("-", F.lit("IT"), *groups).alias("code"), "duration_days")
    return rows.join(rows.groupBy("code").agg((F.count("*") == 1).alias("unique")), "code")


def hmac_sha256(key: str, purpose: str, value: Column) -> Column:
    """HMAC-SHA256 of purpose:value; the key's pads are made once, here."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(F.concat(F.lit(purpose + ":"), value), "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def audit_writes(requests: DataFrame) -> DataFrame:
    """Successful writes of known actors to admin paths, fields cut to their lengths."""
    keep = F.col("method").isin("POST", "PUT", "PATCH", "DELETE") & (F.col("status_code") < 400) & (F.col("path").startswith("/v1/admin/") | F.col("path").startswith("/admin")) & F.col("actor").isNotNull()
    cut = lambda c, n: F.substring(c, 1, n)
    return requests.where(keep).select("event_id", cut("actor", 100).alias("actor"), cut("method", 20).alias("action"), cut("path", 500).alias("resource"), cut("correlation_id", 64).alias("correlation_id"), "status_code")


def recent_audit(events: DataFrame, limit: int = 200) -> DataFrame:
    """Newest first; Spark takes the first rows of each task before it sorts."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    return events.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)


def effective_config(remote: DataFrame, cached: DataFrame, builtin: DataFrame) -> DataFrame:
    """U4: the first source that has a row, with a warning unless it is remote. Each input has a row at most."""
    ranked = [df.limit(1).withColumn("source", F.lit(s)).withColumn("_rank", F.lit(i)) for i, (s, df) in enumerate((("remote", remote), ("cache", cached), ("builtin", builtin)))]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return rows.orderBy("_rank").limit(1).withColumn("warning", F.col("source") != "remote").drop("_rank")
