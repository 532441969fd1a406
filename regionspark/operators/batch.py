"""Batches: progress, stages, names and exports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from regionspark import dims
from regionspark.plans import automata


def counts_by_status(units: DataFrame, key: str = "image_id") -> DataFrame:
    """G1: units of each status per image."""
    status = ("translated", "skipped_language", "skipped_protected", "failed")
    return units.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in status])


def batch_progress(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Finished counts by outcome and their share of all items."""
    done = F.col("status").isin(*dims.TERMINAL)
    return items.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in dims.TERMINAL], F.count_if(done).alias("finished"), (F.count_if(done) / F.count("*")).alias("progress"))


def latest_state(log: DataFrame) -> DataFrame:
    """The last status of each item by seq; combined before the shuffle."""
    return log.groupBy("batch_id", "item_id").agg(F.max_by(F.struct("status", "seq"), "seq").alias("m")).select("batch_id", "item_id", F.col("m.status").alias("status"), F.col("m.seq").alias("seq"))


def stage_monitor(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events with `violation`: the n-th advance must name the n-th stage, complete needs all five, and nothing may
    follow a terminal event. An automaton over each key's rows; a key with very many rows is split over tasks."""
    symbol = automata.stage_symbol(F.col("event"), F.col("stage"), dims.STAGES)
    rows = automata.states_before(events, keys, order, symbol, automata.stage_machine(dims.STAGES), out="_state")
    return rows.withColumn("violation", automata.stage_broken(F.col("_state"), symbol, dims.STAGES)).drop("_state")


def stage_violations(events: DataFrame) -> DataFrame:
    """W7 on (job_id, seq, event, stage): (job_id, valid, n_violations); combined before the shuffle."""
    rows = stage_monitor(events.select("job_id", "seq", "event", "stage"), ["job_id"], ["seq"])
    return rows.groupBy("job_id").agg((~F.bool_or("violation")).alias("valid"), F.count_if("violation").alias("n_violations"))


def unique_names(items: DataFrame, existing: DataFrame, suffix: str) -> DataFrame:
    """W5 on items (ord, stem) and existing (name): stem-translated, then -2, -3 and so on, passing over names that exist.

    The k-th item of a stem takes the k-th free number. A taken number with f free ones below it comes before the items
    from f + 1 on, so sorting both together and counting the taken ones before an item gives how far it is shifted; no
    number is enumerated and no item meets a taken name. Both counts are made in two levels, stretches of STRETCH places
    and then inside a stretch, so a stem that a third of all items have is spread over tasks. ord is a whole number that
    orders the items."""
    base = F.concat(F.col("stem"), F.lit("-translated"))
    rows = _running(items, ["stem"], F.col("ord"), F.lit(1), "_k")
    name = F.col("name")
    mark = r"-translated(?:-([2-9]|[1-9]\d+))?$"
    taken = existing.where(name.endswith(suffix)).select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("n")).distinct().where(F.col("n").rlike(mark))
    taken = taken.select(F.regexp_replace("n", mark, "").alias("stem"), F.regexp_extract("n", mark, 1).alias("d"))
    taken = taken.select("stem", F.when(F.col("d") == "", 1).otherwise(F.col("d").cast("long")).alias("slot"))
    taken = _running(taken, ["stem"], F.col("slot"), F.lit(1), "_j").select("stem", (F.col("slot") - F.col("_j") + 1).alias("_at"), F.lit(1).alias("_t"))
    both = rows.select("stem", F.struct(*items.columns).alias("_row"), F.col("_k").alias("_at"), F.lit(0).alias("_t")).unionByName(taken, allowMissingColumns=True)
    both = _running(both, ["stem"], F.col("_at"), F.col("_t"), "_before", F.desc("_t")).where("_t = 0").withColumn("_slot", F.col("_at") + F.col("_before"))
    return both.select("_row.*", "_slot").select(*items.columns, F.concat(base, F.when(F.col("_slot") > 1, F.concat(F.lit("-"), "_slot")).otherwise(""), F.lit(suffix)).alias("target"))


#: Places of an order that are counted in one task.
STRETCH = 100_000


def _running(df: DataFrame, keys: list[str], place: Column, value: Column, out: str, *ties: Column) -> DataFrame:
    """df with `out`: the sum of value over a key's rows up to this one by place (and ties)."""
    rows = df.withColumn("_stretch", F.floor(place / STRETCH))
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_part"))
    ahead = F.coalesce(F.sum("_part").over(W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_stretch", ahead.alias("_ahead"))
    inside = F.sum(value).over(W.partitionBy(*keys, "_stretch").orderBy(place, *ties).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(out, inside).join(sums, [*keys, "_stretch"]).withColumn(out, F.col(out) + F.col("_ahead")).drop("_stretch", "_ahead")


def check_selection(selection: DataFrame, items: DataFrame) -> DataFrame:
    """Selection (batch_id, item_id, ord) with problem: unknown, duplicate, not_completed or null."""
    have = items.select("batch_id", "item_id", "status", "result_ref", F.lit(True).alias("_known"))
    n = F.count("*").over(W.partitionBy("batch_id", "item_id"))
    bad = F.when(F.col("_known").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").when((F.col("status") != "completed") | F.col("result_ref").isNull(), "not_completed")
    return selection.withColumn("_n", n).join(have, ["batch_id", "item_id"], "left").withColumn("problem", bad).select(*selection.columns, "problem")


def plan_exports(selection: DataFrame, items: DataFrame, existing: DataFrame, suffix: str) -> DataFrame:
    """P7 on items with stem: problem, or the target name; rows with a problem take no name."""
    checked = check_selection(selection, items).join(items.select("batch_id", "item_id", "stem"), ["batch_id", "item_id"], "left")
    named = unique_names(checked.where("problem is null").select("ord", "stem"), existing, suffix).select("ord", "target")
    return checked.join(named, "ord", "left").select("batch_id", "item_id", "ord", "problem", "target")


#: Rows of a batch that go one by one at once where it fails.
SINGLE = 16


def isolate_failures(df: DataFrame, fn: Callable[[pd.DataFrame], list], schema: str) -> DataFrame:
    """Df with result and error. fn gets a batch of rows (a pandas frame) and gives one value of `schema`'s type for
    each; where it fails or gives another number of values, a small batch's rows go through it one by one, a larger batch is
    halved, and so on down to single rows, so a failing row does not touch the others. One frame comes back: write it before it is split by `error is null`, so that fn runs once
    and no row is lost between the two parts."""
    from pyspark.sql import types as T

    out = T.StructType([*df.schema.fields, T.StructField("result", T._parse_datatype_string(schema)), T.StructField("error", T.StringType())])

    def one(row: pd.DataFrame) -> tuple[object, str | None]:
        try:
            return list(fn(row))[0], None
        except Exception as e:  # the point of the operator: any failure becomes a row
            return None, str(e) or type(e).__name__

    def whole(pdf: pd.DataFrame) -> list | None:
        try:
            done = [(x, None) for x in fn(pdf)]
        except Exception:  # some row fails
            return None
        return done if len(done) == len(pdf) else None

    def halved(pdf: pd.DataFrame) -> list[tuple[object, str | None]]:
        """Of a batch that fails; a half is not tried as a whole where the other one did not fail."""
        done, open_ = [], [(0, len(pdf), True)]
        while open_:
            begin, end, fails = open_.pop()
            if end - begin == 1:
                done.append(one(pdf.iloc[begin:end]))
                continue
            own = None if fails else whole(pdf.iloc[begin:end])
            if own is not None:
                done += own
                continue
            middle = (begin + end) // 2
            own = whole(pdf.iloc[begin:middle]) if middle - begin > 1 else [one(pdf.iloc[begin:middle])]
            if own is not None:
                done += own
                open_.append((middle, end, own[0][1] is None))
            else:
                open_ += [(middle, end, False), (begin, middle, True)]
        return done

    def run(batches):
        for pdf in batches:
            done = whole(pdf)
            if done is None:
                done = halved(pdf) if len(pdf) > SINGLE else [one(pdf.iloc[k : k + 1]) for k in range(len(pdf))]
            yield pdf.assign(result=pd.Series([x for x, _ in done], index=pdf.index, dtype=object), error=[e for _, e in done])

    return df.mapInPandas(run, out)


def pending(old: DataFrame, new: DataFrame, exported: DataFrame) -> DataFrame:
    """Old and new results that are not exported yet."""
    return old.union(new).distinct().join(exported, old.columns, "left_anti")


def memory_growth(rounds: DataFrame, step_mb: float = 4.0, ratio: float = 1.25) -> DataFrame:
    """G21, W6 on (run, ord, rss_mb): peak ratio of the last to the first round at most `ratio`, and no two consecutive
    growths over step_mb."""
    w = W.partitionBy("run").orderBy("ord")
    rows = rounds.withColumn("_d1", F.col("rss_mb") - F.lag("rss_mb").over(w)).withColumn("_d0", F.lag("rss_mb").over(w) - F.lag("rss_mb", 2).over(w))
    twice = F.coalesce((F.col("_d1") > step_mb) & (F.col("_d0") > step_mb), F.lit(False))
    first, last = F.min_by("rss_mb", "ord"), F.max_by("rss_mb", "ord")
    return rows.groupBy("run").agg(F.max("rss_mb").alias("peak_mb"), (last <= first * ratio).alias("ratio_ok"), F.bool_or(twice).alias("grew_twice"))
