"""Streaming jobs X1-X4 on keyed state: list, map and value state in the state store, event-time timers, update mode.

Every job reads and changes only the entries that a row concerns; nothing is packed into one value. Rows of a micro-batch are
handled in (ts, id) order per key. Rows must carry a watermark on `ts`; an event-time timer clears a key that the watermark
has left behind by its idle time, after which no row can come that would have needed the state. transformWithState needs the
RocksDB state store, which session.configure sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from regionspark import dims


def _ms(ts: datetime) -> int:
    return int((ts if ts.tzinfo else ts.astimezone(timezone.utc)).timestamp() * 1000)


class Expiring(StatefulProcessor):
    """A processor whose key is forgotten `idle_s` after the latest time that touched it."""

    idle_s: float

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")
        self.states = [self.due, *self.opened(handle)]

    def opened(self, handle: StatefulProcessorHandle) -> list:
        """Open the job's own states."""
        raise NotImplementedError

    def touch(self, last_ms: int) -> None:
        """Move the key's one timer to idle_s after last_ms, unless it is later already."""
        at, old = last_ms + int(self.idle_s * 1000), self.due.get() if self.due.exists() else None
        if old is None or at > old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        ordered = sorted(rows, key=lambda r: (r["ts"], r["id"]))
        yield from self.handled(key, ordered)
        self.touch(_ms(ordered[-1]["ts"]))

    def handled(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        raise NotImplementedError

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        for state in self.states:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Limiter(Expiring):
    """X1 by (scope, identity): the allowed times of the scope's window in a list state, oldest first; rejected requests leave
    no trace. policies: scope to (requests, window in seconds). The key goes one window after its last row."""

    schema = "scope string, identity string, id long, allowed boolean"

    def __init__(self, policies: Mapping[str, tuple[int, float]]):
        for limit, window in policies.values():
            if limit <= 0 or window <= 0:
                raise ValueError("a policy needs a positive number of requests and window")
        self.policies = dict(policies)
        self.idle_s = max(w for _, w in policies.values())

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.allowed = handle.getListState("allowed", "at double")
        return [self.allowed]

    def handled(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        limit, window = self.policies[key[0]]  # a scope without a policy is an error of the caller
        kept, changed, fresh = [t for (t,) in self.allowed.get()] if self.allowed.exists() else [], False, []
        for row in rows:
            t = row["ts"].timestamp()
            live = [x for x in kept if x > t - window]
            changed, kept = changed or len(live) < len(kept), live
            if ok := len(kept) < limit:
                kept.append(t)
                fresh.append((t,))
            yield Row(scope=key[0], identity=key[1], id=row["id"], allowed=ok)
        if changed:
            self.allowed.put([(t,) for t in kept])
        elif fresh:
            self.allowed.appendList(fresh)


class Progress(Expiring):
    """X2 by batch: a map state of items to (seq, status) of which a row reads and writes one entry, and the counts. Emits one
    row a batch and micro-batch, in update mode. An older seq of an item changes nothing."""

    schema = "batch_id long, total long, completed long, failed long, cancelled long, finished long, progress double"

    def __init__(self, idle_s: float):
        self.idle_s = idle_s

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.items = handle.getMapState("items", "item long", "seq long, status string")
        self.counts = handle.getValueState("counts", "total long, " + ", ".join(f"{s} long" for s in dims.TERMINAL))
        return [self.items, self.counts]

    def handled(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        total, *done = self.counts.get() if self.counts.exists() else (0,) * (1 + len(dims.TERMINAL))
        done = dict(zip(dims.TERMINAL, done))
        newest = {}
        for row in rows:  # of an item's rows only the newest counts
            if row["item"] not in newest or row["id"] > newest[row["item"]]["id"]:
                newest[row["item"]] = row
        for item, row in newest.items():
            old = self.items.getValue((item,))
            if old is not None and old[0] >= row["id"]:
                continue
            total += old is None
            for status, change in ((old[1] if old else None, -1), (row["status"], 1)):
                if status in done:
                    done[status] += change
            self.items.updateValue((item,), (row["id"], row["status"]))
        self.counts.update((total, *done.values()))
        yield Row(batch_id=key[0], total=total, **done, finished=sum(done.values()), progress=sum(done.values()) / total)


class Stages(Expiring):
    """X3 by job: the number of advances and whether a terminal event has come, in a value state."""

    schema = "job_id long, id long, violation boolean"

    def __init__(self, idle_s: float):
        self.idle_s = idle_s

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.at = handle.getValueState("at", "n int, over boolean")
        return [self.at]

    def handled(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        n, over = self.at.get() if self.at.exists() else (0, False)
        for row in rows:
            advance, last = row["event"] == "advance", len(dims.STAGES)
            bad = over or advance and dims.STAGES[n : n + 1] != (row["stage"],) or row["event"] == "complete" and n != last
            n, over = min(n + advance, last + 1), over or row["event"] in ("complete", "cancel", "fail")
            yield Row(job_id=key[0], id=row["id"], violation=bool(bad))
        self.at.update((n, over))


class Binder(Expiring):
    """X4 by code: the device that activated it first, its expiry, and whether it is disabled. A code stays known `idle_s`
    after its last row, which has to be longer than any code lasts."""

    schema = "code long, id long, outcome string"

    def __init__(self, idle_s: float):
        self.idle_s = idle_s

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.bound = handle.getValueState("bound", "device string, expires double")
        self.disabled = handle.getValueState("disabled", "off boolean")
        return [self.bound, self.disabled]

    def handled(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        bound, off = self.bound.get() if self.bound.exists() else None, self.disabled.exists()
        for row in rows:
            t = row["ts"].timestamp()
            if row["event"] == "disable":
                if not off:
                    self.disabled.update((True,))
                off, outcome = True, "disabled"
            elif off:
                outcome = "code_disabled"
            else:
                if bound is None:
                    bound = (row["device"], t + 86400 * int(row["days"]))
                    self.bound.update(bound)
                outcome = "device_mismatch" if bound[0] != row["device"] else "code_expired" if bound[1] <= t else "ok"
            yield Row(code=key[0], id=row["id"], outcome=outcome)


def keyed(rows: DataFrame, keys: list[str], job: Expiring, late: str = "0 seconds") -> DataFrame:
    """The stream's rows under the job, in update mode; rows later than the watermark (`late` behind the latest ts) go."""
    return rows.withWatermark("ts", late).groupBy(*keys).transformWithState(statefulProcessor=job, outputStructType=job.schema, outputMode="update", timeMode="EventTime")


def policies(spark: SparkSession) -> dict[str, tuple[int, float]]:
    """The fixed limits by scope."""
    return {r.scope: (r.max_requests, float(r.window_s)) for r in dims.rate_policies(spark).collect()}


def write_updates(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that writes each micro-batch to the folder epoch=N below path. A micro-batch that is run again after a
    failure replaces its own folder and no other, so every update is there once."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last update of each key below path; combined before the shuffle."""
    rows = spark.read.schema(f"{schema}, epoch long").parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("m")).select(*keys, "m.*")
