"""Stateful operators over streams in event order: version changes per client, spending against a cap.

Rows of a key wait in its state until the watermark has passed them, are then settled in order of time and row key, and
fold into the key's value: so rows may arrive in any order within `late`, and results equal the batch operator's over
the same rows, whatever the batches and restarts. A row that arrives twice (same row key) while the first waits is
dropped; one that arrives after the watermark has passed it is late and dropped, repeats of settled rows among them.
What a key's state holds is its value and the rows of the last `late`; the key should therefore include a slot where
one client may send a third of all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def in_order(rows: DataFrame, keys: list[str], ts: str, row_key: str, step: Step, out: str, *, late: str = "1 hour") -> DataFrame:
    """What step(value, row) gives for the rows of each key in order of (ts, row key). It returns the key's new value (JSON:
    {} at first) and rows of `out`, a DDL string that begins with the keys."""
    fields = T.StructType.fromDDL(out)
    columns = [c for c in rows.columns if c not in (*keys, ts)]
    # JSON keeps what is waiting; times as microseconds.
    packed = rows.withWatermark(ts, late).select(*keys, F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), F.col(row_key).cast("string").alias("__row"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("__value"))

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, waiting = ({}, {}) if not state.exists else (json.loads(x) for x in state.get)
        passed = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            for at, row, text in zip(batch["__at"], batch["__row"], batch["__value"], strict=True):
                if at >= passed:  # else late
                    waiting.setdefault(f"{int(at):020d} {row}", [int(at), text])
        found = []
        for name in sorted(waiting):
            at, text = waiting[name]
            if at >= passed:
                break
            value, more = step(value, {**json.loads(text), ts: pd.Timestamp(at, unit="us")})
            found += [{**dict(zip(keys, key, strict=True)), **r} for r in more]
            del waiting[name]
        state.update((json.dumps(value), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(min(w[0] for w in waiting.values()) // 1000 + 1)
        if found:
            yield pd.DataFrame(found)[fields.names]

    return packed.groupBy(*keys).applyInPandasWithState(work, fields, "value string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def version_changes(rows: DataFrame, client: str = "client", slot: str = "slot", version: str = "version", ts: str = "ts", row_key: str = "unit_key", *, late: str = "1 hour") -> DataFrame:
    """Rows whose version differs from the one before within (client, slot): as stability.version_changes in order of ts
    and row key."""

    def step(value: dict, row: dict) -> tuple[dict, list[dict]]:
        before, now = value.get("version"), row[version]
        changed = before is not None and now is not None and before != now
        return {"version": now}, [{row_key: str(row[row_key]), ts: row[ts], "previous": before, version: now}] if changed else []

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"{client} {types[client]}, {slot} {types[slot]}, {row_key} string, {ts} timestamp, previous string, {version} string"
    return in_order(rows, [client, slot], ts, row_key, step, out, late=late)


def capped(rows: DataFrame, cap: float, run: str = "run_id", cost: str = "cost", ts: str = "ts", row_key: str = "unit_key", *, late: str = "1 hour") -> DataFrame:
    """Every call with what its run has spent up to it, and whether that is over the cap (by more than 1e-9), as a check
    after each call in order; first_over marks the call that a run stops at."""

    def step(value: dict, row: dict) -> tuple[dict, list[dict]]:
        spent = value.get("spent", 0.0) + float(row[cost] or 0.0)
        over = spent > cap + 1e-9
        return {"spent": spent, "over": over}, [{row_key: str(row[row_key]), ts: row[ts], "spent": spent, "over": over, "first_over": over and not value.get("over", False)}]

    kind = rows.schema[run].dataType.simpleString()
    return in_order(rows, [run], ts, row_key, step, f"{run} {kind}, {row_key} string, {ts} timestamp, spent double, over boolean, first_over boolean", late=late)
