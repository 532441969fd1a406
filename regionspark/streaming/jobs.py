"""Streaming jobs X1-X4 with their batch twins, and the edit log replay P14.

Each job is a per-key fold over rows in (ts, id) order. The batch twin folds sorted rows as they come; the stream keeps the
fold's small state per key with applyInPandasWithState and folds each micro-batch's rows in order.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regionspark import dims

State = dict
#: Largest state that a key keeps is bounded by the fold: the limiter holds at most `limit` times, the others a few values.


def scoped_limiter(policies: dict[str, tuple[int, float]]) -> Callable[[State, dict], dict]:
    """Sliding log with the limit and window of the row's scope; a request is allowed iff fewer than `limit` allowed ones
    lie in (t - window, t]."""

    def fold(state: State, row: dict) -> dict:
        limit, window = policies[row["scope"]]
        t = row["ts"].timestamp()
        kept = [x for x in state.get("allowed", []) if x > t - window]
        ok = len(kept) < limit
        state["allowed"] = kept + [t] if ok else kept
        return {"id": row["id"], "allowed": ok}

    return fold


def limiter(limit: int, window_s: float) -> Callable[[State, dict], dict]:
    """X1 with one limit for all scopes."""
    fold = scoped_limiter({"": (limit, window_s)})
    return lambda state, row: fold(state, row | {"scope": ""})


def progress(state: State, row: dict) -> dict:
    """Counts after each update; an older seq of an item changes nothing."""
    items, counts = state.setdefault("items", {}), state.setdefault("counts", {})
    old = items.get(str(row["item"]))
    if old is None or row["id"] > old[0]:
        items[str(row["item"])] = [row["id"], row["status"]]
        counts[row["status"]] = counts.get(row["status"], 0) + 1
        if old:
            counts[old[1]] -= 1
    return {"id": row["id"], "total": len(items), **{c: counts.get(c, 0) for c in ("completed", "failed", "cancelled")}}


def stages(state: State, row: dict) -> dict:
    """Whether an event breaks the order of stages; nothing may follow a terminal event."""
    n, over = state.get("n", 0), state.get("over", False)
    bad = over or (row["event"] == "advance" and not (n < len(dims.STAGES) and row["stage"] == dims.STAGES[n])) or (row["event"] == "complete" and n != len(dims.STAGES))
    state["n"] = n + (row["event"] == "advance")
    state["over"] = over or row["event"] in ("complete", "cancel", "fail")
    return {"id": row["id"], "violation": bool(bad)}


def binder(state: State, row: dict) -> dict:
    """Activation of one code; disable events come in the same log."""
    if row["event"] == "disable":
        state["disabled"] = True
        return {"id": row["id"], "outcome": "disabled"}
    if state.get("disabled"):
        return {"id": row["id"], "outcome": "code_disabled"}
    t = row["ts"].timestamp()
    if "device" not in state:
        state |= {"device": row["device"], "expires": t + 86400 * int(row["days"])}
    if state["device"] != row["device"]:
        return {"id": row["id"], "outcome": "device_mismatch"}
    return {"id": row["id"], "outcome": "code_expired" if state["expires"] <= t else "ok"}


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


_WIDTH = 10  # digits of a key's whole part


def between(a: str | None, b: str | None) -> str:
    """A key that sorts after a (none: the beginning) and before b (none: the end). A key is a whole number of _WIDTH digits in
    base 36 and, where two neighbours leave no other room, a fraction; so keys stay short at both ends however many come."""
    whole = [int(x[:_WIDTH], 36) if x else None for x in (a, b)]
    if not a or not b or whole[1] - whole[0] > 1:
        n = (whole[0] + whole[1]) // 2 if a and b else whole[0] + 1 if a else whole[1] - 1 if b else 36**_WIDTH // 2
        out = ""
        for _ in range(_WIDTH):
            n, digit = divmod(n, 36)
            out = _DIGITS[digit] + out
        return out
    out, k = "", 0
    while True:
        low = _DIGITS.index(a[k]) if k < len(a) else 0
        high = _DIGITS.index(b[k]) if b and k < len(b) else 36
        if high - low > 1:
            return out + _DIGITS[(low + high) // 2]
        out, k = out + _DIGITS[low], k + 1
        if high > low:
            b = None  # from here on anything is before it


def replay(limit: int = 100, every: int = 100) -> Callable[[State, dict], dict]:
    """Layers under add, replace, delete, manual, undo and redo. An edit names the layer, its text before and after,
    for add and manual the place to insert at (none: the end), for manual the background patch that comes with it. One
    whose before is not current is stale_edit, a second layer or patch of one id duplicate_layer or duplicate_patch; a new
    edit clears redo; at most `limit` edits can be undone; one that cannot be taken back as it was is stale_undo.

    A layer has an order key that stays its own while others come and go. A row gives what it changed, [layer, order key, text], with
    a null key where the layer went; every `every`-th row of a key gives all layers too, so the output grows with the log
    and not with its square. Layers sorted by order key are the layers in order."""

    def fold(state: State, row: dict) -> dict:
        layers, keys, patches, undo, redo = (state.setdefault(x, y) for x, y in (("layers", {}), ("keys", []), ("patches", []), ("undo", []), ("redo", [])))
        change = None

        def put(layer: str, text: str, at: int) -> None:
            nonlocal change
            at = min(max(at, 0), len(keys))
            key = between(keys[at - 1] if at else None, keys[at] if at < len(keys) else None)
            keys.insert(at, key)
            layers[layer] = [key, text]
            change = [layer, key, text]

        def drop(layer: str) -> None:
            nonlocal change
            del keys[bisect_left(keys, layers.pop(layer)[0])]
            change = [layer, None, None]

        def write(layer: str, text: str) -> None:
            nonlocal change
            layers[layer][1] = text
            change = [layer, *layers[layer]]

        def forward(kind, layer, before, after, at, patch) -> str:
            if kind in ("add", "manual"):
                if kind == "manual" and patch in patches:
                    return "duplicate_patch"
                if layer in layers:
                    return "duplicate_layer"
                put(layer, after, at)
                if kind == "manual":
                    patches.append(patch)
            elif layer not in layers or layers[layer][1] != before:
                return "stale_edit"
            elif kind == "replace":
                write(layer, after)
            else:
                drop(layer)
            return "ok"

        def back(kind, layer, before, after, at, patch) -> str:
            if kind == "delete":
                if layer in layers:
                    return "duplicate_layer"
                put(layer, before, at)
                return "ok"
            if layer not in layers or layers[layer][1] != after or (kind == "manual" and patches[-1:] != [patch]):
                return "stale_undo"
            if kind == "replace":
                write(layer, before)
            else:
                drop(layer)
                del patches[len(patches) - (kind == "manual") :]
            return "ok"

        kind = row["event"]
        if kind in ("undo", "redo"):
            source, target, step = (undo, redo, back) if kind == "undo" else (redo, undo, forward)
            result = step(*source[-1]) if source else f"nothing_to_{kind}"
            if result == "ok":
                target.append(source.pop())
        else:
            at = row.get("at")
            new = kind in ("add", "manual")
            spot = (len(keys) if at is None else min(max(int(at), 0), len(keys))) if new else bisect_left(keys, layers[row["layer"]][0]) if row["layer"] in layers else None
            edit = [kind, row["layer"], row["before"], row["after"], spot, row.get("patch")]
            result = forward(*edit)
            if result == "ok":
                undo.append(edit)
                del undo[:-limit], redo[:]
        state["rows"] = state.get("rows", 0) + 1
        whole = json.dumps(sorted([k, x, t] for x, (k, t) in layers.items())) if state["rows"] % every == 0 else None
        return {"id": row["id"], "result": result, "change": json.dumps(change) if change else None, "layers": whole, "n_undo": len(undo), "n_redo": len(redo)}

    return fold


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return pdf.sort_values(["ts", "id"], kind="stable").astype(object).where(pdf.notna(), None).to_dict("records") if len(pdf) else []


def batch(df: DataFrame, keys: list[str], fold: Callable[[State, dict], dict], schema: str) -> DataFrame:
    """The batch twin: df has keys, ts, id and what the fold reads; schema: keys and the fold's columns. Rows come sorted by
    key and time, and only the fold's state is carried on, so a key's log is never held as a whole."""
    wanted = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, {}
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, {}
                out.append(dict(zip(keys, own)) | fold(state, row))
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    return df.repartition(*keys).sortWithinPartitions(*keys, "ts", "id").mapInArrow(run, schema)


def stream(df: DataFrame, keys: list[str], fold: Callable[[State, dict], dict], schema: str, watermark: str | None = None) -> DataFrame:
    """The streaming job: state is the fold's, as JSON, per key; rows later than the watermark are dropped before it."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {}
        out = [dict(zip(keys, key)) | fold(own, r) for r in _rows(pd.concat(list(pdfs)))]
        state.update((json.dumps(own),))
        yield pd.DataFrame(out)

    rows = df.withWatermark("ts", watermark) if watermark else df
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
