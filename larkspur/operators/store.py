"""Scan history: upserts, retention, eviction and the summaries over it, on tables of repositories, runs and threats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys; of new rows that share keys, the last in column order."""
    fresh = latest(new, keys, [F.desc(c) for c in new.columns if c not in keys])
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def retain(runs: DataFrame, children: dict[str, DataFrame], keep: Column, key: str = "run_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Runs for which `keep` holds, and their children; a rewrite by anti-join, not a delete."""
    gone = runs.filter(~keep).select(key)
    return runs.filter(keep), {name: t.join(gone, key, "left_anti") for name, t in children.items()}


def evict(cache: DataFrame, most: int, recency: str, key: str) -> DataFrame:
    """The `most` entries used last. A limit by order keeps the sort partial; its ids then pick the rows."""
    return cache.join(cache.orderBy(F.desc(recency), key).limit(most).select(key), key, "left_semi")


def cached(files: DataFrame, cache: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(files with a stored result, files still to scan)."""
    return files.join(cache, key), files.join(cache.select(key), key, "left_anti")


def export(runs: DataFrame, threats: DataFrame, prints: DataFrame, key: str = "run_id") -> DataFrame:
    """One JSON text a run: its columns, threats and fingerprints by path."""
    t = threats.groupBy(key).agg(F.collect_list(F.struct(*[c for c in threats.columns if c != key])).alias("threats"))
    p = prints.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(*[c for c in prints.columns if c not in (key, "path")])))).alias("fingerprints"))
    out = runs.join(t, key, "left").join(p, key, "left")
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("report"))


def activity_log(events: DataFrame, session: str, tool: str, at: str, first: list[str], type_: str = "tool_call") -> DataFrame:
    """One JSON text an event, its type first, then the columns as they stand. Of events of the same session, tool and time the
    first in the order of the columns `first` stays."""
    once = latest(events, [session, tool, at], [F.col(c) for c in first])
    shown = [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c == at else F.col(c) for c in events.columns if c not in first]
    return once.select(*first, F.to_json(F.struct(F.lit(type_).alias("type"), *shown)).alias("event"))


def top_in_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def until_threshold(rows: DataFrame, group: str, order: list, hits: Column, most: int) -> DataFrame:
    """Rows of each group, in order, up to and with the one whose hits reach `most`."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(hits).over(w), F.lit(0))).filter(F.col("before") < most)


def within(rows: DataFrame, group: str, seconds: str, window: int) -> DataFrame:
    """How many rows of the group fall into the `window` seconds up to each row, itself included."""
    w = Window.partitionBy(group).orderBy(seconds).rangeBetween(-window, 0)
    return rows.withColumn("n_in_window", F.count(F.lit(1)).over(w))


def pack_tokens(items: DataFrame, group: str, order: list[str], size: str, most: int) -> DataFrame:
    """(group, item order, size, batch): items in order, a new batch where the next would not fit; an item larger than `most`
    is a batch of its own. Each batch depends on the one before, so a group's rows pass through one task in order; they stream,
    and the task holds one count."""
    rows = items.select(group, *order, size).repartition(group).sortWithinPartitions(group, *order)

    def walk(parts):
        last, used, batch = object(), 0, 0
        for pdf in parts:
            out = []
            for g, n in zip(pdf[group], pdf[size].fillna(0), strict=True):
                g = None if pd.isna(g) else g
                if g != last:
                    last, used, batch = g, 0, 0
                elif used and used + n > most:
                    used, batch = 0, batch + 1
                used += int(n)
                out.append(batch)
            yield pdf.assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(walk, f"{schema}, batch int")


def adaptive_thresholds(history: DataFrame, critical: str = "critical_count", high: str = "high_count") -> DataFrame:
    """Thresholds for leaving early, from the means of past scans; the defaults where there are none."""
    c, h = F.coalesce(F.avg(critical), F.lit(0.0)), F.coalesce(F.avg(high), F.lit(0.0))
    return history.agg(F.greatest(F.lit(3), F.floor(c * 1.5)).cast("long").alias("critical"), F.greatest(F.lit(10), F.floor(h * 1.5)).cast("long").alias("high"), ((F.count(critical) > 0) & (c < 0.5)).alias("first_critical"))


def batch_stats(batches: DataFrame, tokens: str = "tokens", score: str = "rank") -> DataFrame:
    """Files, tokens and files of three bands of rank over all batches."""
    s = F.col(score)
    band = {"high": s >= 0.7, "medium": (s >= 0.4) & (s < 0.7), "low": s < 0.4}
    return batches.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"), *[F.count(F.when(x, 1)).alias(k) for k, x in band.items()])


def client_summary(configs: DataFrame, client: str = "client", path: str = "path", servers: str = "n_servers") -> DataFrame:
    """Configurations and servers of each client, with a total (client null)."""
    return configs.rollup(client).agg(F.count(F.lit(1)).alias("configs"), F.sum(servers).alias("servers"), F.countDistinct(path).alias("paths"))


def merged_signatures(held: DataFrame, imported: DataFrame, key: str = "tool_id", replace: bool = False) -> DataFrame:
    """Two signature tables as one: imported rows win, or stand alone where they replace."""
    if replace:
        return imported
    return held.join(imported.select(key).distinct(), key, "left_anti").unionByName(imported, allowMissingColumns=True)


def signature_report(tools: DataFrame, server: str = "server", seen: str = "times_seen", changed: str = "changed") -> DataFrame:
    """(server, tools, changed, seen) with a total (server null)."""
    return tools.rollup(server).agg(F.count(F.lit(1)).alias("tools"), F.count(F.when(F.col(changed), 1)).alias("changed"), F.sum(seen).alias("seen"))


def answer_rollup(findings: DataFrame, results: DataFrame, key: str = "scan", kind: str = "type", risk: str = "risk_score") -> DataFrame:
    """(key, risk, findings, critical, high, by_type): what models said of a scan. risk is the mean over its results."""
    n = findings.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in ("CRITICAL", "HIGH")])
    by = n.groupBy(key).agg(F.sum("n").alias("findings"), F.sum("critical").alias("critical"), F.sum("high").alias("high"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("by_type"))
    return results.groupBy(key).agg(F.avg(risk).alias("risk")).join(by, key, "left").fillna(0, ["findings", "critical", "high"])


def timeline(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Events numbered within their session by time, ties by the further columns."""
    return events.withColumn("step", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def fresh(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """`warm`: whether the key was looked up within the `seconds` before (its entry is then still cached). Each lookup that
    finds none fills the cache anew, so an entry's age counts from the fill, which only an ordered walk can tell: see
    `streaming.sessions.cache`; this is the simpler question of the last lookup."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("warm", F.coalesce(F.unix_micros(at) - F.unix_micros(before) <= seconds * 1000000, F.lit(False)))


def ranked_findings(findings: DataFrame, group: str, severity: Column, tie: list[str], most: int | None = None) -> DataFrame:
    """Findings of each group from the gravest and surest down, numbered; `most` keeps the first of each (a report)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(severity.desc(), F.desc("confidence"), *tie))
    out = findings.withColumn("place", place)
    return out if most is None else out.filter(F.col("place") <= most)


def fixed_batches(files: DataFrame, group: str, order: list, size: int) -> DataFrame:
    """`batch`: files of a group in order, `size` to a batch."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return files.withColumn("batch", F.floor((place - 1) / size))


def directories(files: DataFrame, path: str, score: str) -> DataFrame:
    """(directory, files, most): directories by the best score in them, a directory each as one unit of work."""
    at = F.regexp_replace(path, r"/?[^/]*$", "").alias("directory")
    return files.select(at, score).groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.max(score).alias("most"))
