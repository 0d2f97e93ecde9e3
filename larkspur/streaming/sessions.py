"""Streams of tool-call events: the batch operators' questions, kept as state.

Input rows: session_id, event_id, ts, tool, level. Late rows are accepted up to the watermark, an added choice. Where `ttl`
is given (milliseconds of event time, with a watermark on ts), a key that is silent for so long loses its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.flows import TOXIC
from larkspur.session import ship


def summaries(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events, tools and risky events of each session and window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "session_id")
        .agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("tool").alias("tools"), F.count(F.when(F.col("level").isin("HIGH", "CRITICAL"), 1)).alias("risky"))
        .select("session_id", F.col("window.start").alias("start"), "events", "tools", "risky")
    )


def _kept(state: GroupState, ttl: int | None) -> None:
    """Let the key's state go once the watermark has passed `ttl` beyond what it is now."""
    if ttl is not None:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + ttl)


def _timeout(ttl: int | None) -> str:
    return GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout


def toxic_pairs(events: DataFrame, rules=TOXIC, ttl: int | None = None) -> DataFrame:
    """Alerts (session_id, event_id, flow) where an event follows directly on a source tool. State: the session's last
    event. Rows of one batch are put in order of time; a row older than the state's is a late one and pairs with nothing."""
    ship(events.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            at = (r.ts.timestamp(), int(r.event_id))
            if last is not None and at <= (last[0], last[1]):
                continue
            if last is not None:
                out += [(key[0], int(r.event_id), name) for sources, sinks, name in rules if last[2] in sources and r.tool in sinks][:1]
            last = (*at, r.tool)
        state.update(last)
        _kept(state, ttl)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "flow"])

    return events.groupBy("session_id").applyInPandasWithState(update, "session_id string, event_id long, flow string", "at double, event_id long, tool string", "append", _timeout(ttl))


def rate_limit(requests: DataFrame, limit: int, window: float, ttl: int | None = None) -> DataFrame:
    """(client, event_id, allowed): at most `limit` accepted requests in any `window` seconds; rejected ones do not count,
    which only state can express. State: the times of accepted requests within the window, at most `limit`."""
    ship(requests.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
            now = r.ts.timestamp()
            kept = [t for t in kept if t > now - window]
            allowed = len(kept) < limit
            kept += [now] if allowed else []
            out.append((key[0], int(r.event_id), allowed))
        state.update((kept,))
        _kept(state, ttl)
        yield pd.DataFrame(out, columns=["client", "event_id", "allowed"])

    return requests.groupBy("client").applyInPandasWithState(update, "client string, event_id long, allowed boolean", "times array<double>", "append", _timeout(ttl))


def signature_changes(sightings: DataFrame, ttl: int | None = None) -> DataFrame:
    """(tool_id, event_id, status, times_seen) as the batch form gives it, from the last signature and its count."""
    ship(sightings.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
            status = "new" if last is None else "known" if r.signature == last else "modified"
            seen += status != "modified"
            last = r.signature
            out.append((key[0], int(r.event_id), status, seen))
        state.update((last, seen))
        _kept(state, ttl)
        yield pd.DataFrame(out, columns=["tool_id", "event_id", "status", "times_seen"])

    return sightings.groupBy("tool_id").applyInPandasWithState(update, "tool_id string, event_id long, status string, times_seen long", "signature string, seen long", "append", _timeout(ttl))


def cache(lookups: DataFrame, seconds: float, ttl: int | None = None) -> DataFrame:
    """(key, event_id, hit): a lookup hits while the entry that the last miss filled is younger than `seconds`."""
    ship(lookups.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        filled = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
            now = r.ts.timestamp()
            hit = filled is not None and now - filled < seconds
            filled = filled if hit else now
            out.append((key[0], int(r.event_id), hit))
        state.update((filled,))
        _kept(state, ttl)
        yield pd.DataFrame(out, columns=["key", "event_id", "hit"])

    return lookups.groupBy("key").applyInPandasWithState(update, "key string, event_id long, hit boolean", "filled double", "append", _timeout(ttl))


def lifecycles(events: DataFrame, ttl: int) -> DataFrame:
    """(session_id, events, risky, most, ended): a session once it is over, by an event whose tool is `session_end` or by a
    silence of `ttl` milliseconds of event time. State: counts and the worst level."""
    ship(events.sparkSession)
    ranks = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["session_id", "events", "risky", "most", "ended"]
        n, risky, most = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, risky, ranks[most], "silence")], columns=columns)
            return
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
            if r.tool == "session_end":
                out.append((key[0], n, risky, ranks[most], "end"))
                n, risky, most = 0, 0, 0
                continue
            at = ranks.index(r.level) if r.level in ranks else 0
            n, risky, most = n + 1, risky + (at >= 3), max(most, at)
        if n:
            state.update((n, risky, most))
            _kept(state, ttl)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("session_id").applyInPandasWithState(update, "session_id string, events long, risky long, most string, ended string", "n long, risky long, most long", "append", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, **options: str):
    """A running query that appends a stream's rows (alerts, events, ended sessions) to a Parquet table, each batch once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.options(**options).trigger(availableNow=True).start(path)


def alerts(stream: DataFrame, send, checkpoint: str):
    """A running query that hands each batch of alerts to `send(rows, batch_id)`. A batch may come again after a failure, with
    the same number."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
