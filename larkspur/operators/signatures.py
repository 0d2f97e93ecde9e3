"""Tool signatures: change over time, likeness of tools, and a root over fingerprints."""

from __future__ import annotations

import bisect
import hashlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.python import indel_ratio
from larkspur.session import cut, ship

#: Rows a cell of `similar` holds, about. What rounding to six digits may add to a ratio.
CELL, SLACK = 1024, 1e-6


def statuses(sightings: DataFrame, tool="tool_id", print_="signature", order=("ts",), blacklist: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Each sighting as new (medium), known (low) or modified (high; critical after more than ten sightings of the last
    signature in a row that was not modified); listed signatures override: blacklisted (critical), whitelisted (safe)."""
    w = Window.partitionBy(tool).orderBy(*order)
    out = sightings.withColumn("_before", F.lag(print_).over(w))
    out = out.withColumn("_same", (F.col("_before").isNotNull() & F.col(print_).eqNullSafe(F.col("_before"))).cast("int"))
    out = out.withColumn("times_seen", 1 + F.coalesce(F.sum("_same").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    status = F.when(F.col("_before").isNull(), "new").when(F.col("_same") == 1, "known").otherwise("modified")
    risk = F.when(F.col("_before").isNull(), "medium").when(F.col("_same") == 1, "low").when(F.col("times_seen") > 10, "critical").otherwise("high")
    for name, listed, to in (("whitelisted", whitelist, "safe"), ("blacklisted", blacklist, "critical")):
        if listed is not None:
            flag = f"_{name}"
            out = out.join(listed.select(F.col(print_)).distinct().withColumn(flag, F.lit(True)), print_, "left")
            status = F.when(F.col(flag), name).otherwise(status)
            risk = F.when(F.col(flag), to).otherwise(risk)
    out = out.withColumn("status", status).withColumn("risk", risk)
    return out.drop("_before", "_same", "_whitelisted", "_blacklisted")


def similar(tools: DataFrame, name: str, fields: list[tuple[str, float]], least: float = 0.8, most: int = 5) -> DataFrame:
    """(name, other, similarity): the `most` likest others at `least` or more, by the weighted ratio of the fields; exact.

    Rows lie in cells of about CELL rows whose fields are of like length. Two cells meet unless their lengths alone keep the
    weighted ratio under `least`. In a meeting, counts of characters bound the ratio of each pair, and pairs are computed from
    the highest bound down, until no bound reaches `least` and the worst of the `most` found. A row without a field has no others."""
    ship(tools.sparkSession)
    names, weights = [f for f, _ in fields], [float(w) for _, w in fields]
    texts = [F.col(f).alias(f"f{k}") for k, f in enumerate(names)]
    rows = tools.select(F.col(name).alias("name"), *texts).dropna()
    classes = [F.ceil(F.log2(F.length(f"f{k}") + 1) * 2).cast("int") for k in range(len(fields))]
    rows = cut(rows.withColumn("class", F.array(*classes)).withColumn("i", F.monotonically_increasing_id()))
    parts = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    rows = rows.join(F.broadcast(parts), "class").withColumn("cell", F.struct("class", F.pmod(F.xxhash64("i"), "parts").alias("part"))).drop("class", "parts", "i")
    ends = [g(F.length(f"f{k}")).alias(f"{n}{k}") for k in range(len(fields)) for n, g in (("lo", F.min), ("hi", F.max))]
    cells = cut(rows.groupBy("cell").agg(*ends))
    there = cells.select(*[F.col(c).alias(f"{c}_2") for c in cells.columns])

    def nearest(k: int):
        """The highest ratio that lengths from lo to hi and from lo_2 to hi_2 allow."""
        short, long = F.least(f"hi{k}", f"hi{k}_2"), F.greatest(f"lo{k}", f"lo{k}_2")
        return F.when(short >= long, 1.0).otherwise(2.0 * short / (short + long))

    highest = sum((w * nearest(k) for k, w in enumerate(weights)), F.lit(0.0))
    meetings = cells.join(there, highest >= least - SLACK).select("cell", "cell_2")
    left = rows.join(meetings, "cell")
    right = rows.select(*[F.col(c).alias(f"{c}_2") for c in rows.columns]).join(meetings, "cell_2")
    kind = rows.schema["name"].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = likest(a, b.rename(columns=lambda c: c.removesuffix("_2")), weights, least, most)
        return pd.DataFrame(found, columns=["name", "other", "similarity"])

    keys = ["cell", "cell_2"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"name {kind}, other {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("name").alias(name), "other", "similarity", "rank")


def likest(a: pd.DataFrame, b: pd.DataFrame, weights: list[float], least: float, most: int) -> list[tuple]:
    """(name, other, similarity) of each name of `a`: its `most` likest others in `b` at `least` or more."""
    texts = [(a[f"f{k}"].tolist(), b[f"f{k}"].tolist()) for k in range(len(weights))]
    counted = [(_counts(x), _counts(y)) for x, y in texts]
    sizes = [(x.sum(axis=1), y.sum(axis=1)) for x, y in counted]
    others, best = b["name"].tolist(), {}
    for i, one in enumerate(a["name"].tolist()):
        bound = np.zeros(len(others))
        for w, (x, y), (m, n) in zip(weights, counted, sizes, strict=True):
            both = m[i] + n
            bound += w * np.where(both > 0, 2 * np.minimum(x[i], y).sum(axis=1) / np.maximum(both, 1), 1.0)
        top = best.setdefault(one, [])
        near = np.flatnonzero(bound >= least - SLACK)
        for j in near[np.argsort(-bound[near], kind="stable")].tolist():
            if len(top) == most and bound[j] < -top[-1][0] - SLACK:
                break
            if others[j] == one:
                continue
            ratio = rounded(sum((w * indel_ratio(x[i], y[j]) for w, (x, y) in zip(weights, texts, strict=True)), 0.0))
            if ratio >= least:
                bisect.insort(top, (-ratio, others[j]))
                del top[most:]
    return [(one, other, -ratio) for one, top in best.items() for ratio, other in top]


def _counts(texts: list[str]) -> np.ndarray:
    """How often each text has characters of each of 64 classes; classes never lower the overlap of two texts."""
    out = np.zeros((len(texts), 64), dtype=np.int32)
    for row, text in zip(out, texts, strict=True):
        np.add.at(row, [ord(c) & 63 for c in text], 1)
    return out


def rounded(x: float) -> float:
    """As Spark's round(x, 6)."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def merkle_root(files: DataFrame, path: str = "path", print_: str = "sha512", block_bits: int = 10) -> DataFrame:
    """The root over (path, print) as one row. Leaves in path order are numbered by ranges, and each task folds blocks of
    2^block_bits leaves to one node; folding blocks repeats until one is left, so no task and no driver holds all leaves."""
    ship(files.sparkSession)
    spark = files.sparkSession
    leaf = files.select(path, F.unhex(F.sha2(F.concat_ws(":", F.col(path), F.col(print_)), 512)).alias("h"))
    ordered = cut(leaf.repartitionByRange(path).sortWithinPartitions(path).select("h", F.monotonically_increasing_id().alias("mid")))
    part = F.shiftright("mid", 33)
    counts = sorted((r.p, r.n) for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one a partition
    if not counts:
        return spark.createDataFrame([("",)], "root string")
    bases, at = [], 0
    for p, n in counts:
        bases.append((p, at))
        at += n
    base = F.broadcast(spark.createDataFrame(bases, "p long, base long"))
    level = ordered.withColumn("p", part).join(base, "p").select((F.col("base") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), "h")
    n = at

    def folder(total: int):
        def folded(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            block, nodes, width = int(pdf.i.iloc[0]) >> block_bits, list(pdf.h), total
            for _ in range(block_bits):
                if width == 1:
                    break
                nodes = [hashlib.sha512(nodes[j] + nodes[min(j + 1, len(nodes) - 1)]).digest() for j in range(0, len(nodes), 2)]
                width = -(-width // 2)
            return pd.DataFrame({"i": [block], "h": [nodes[0]]})

        return folded

    while n > 1:
        level = cut(level.withColumn("b", F.shiftright("i", block_bits)).groupBy("b").applyInPandas(folder(n), "i long, h binary"))
        n = -(-n >> block_bits) if n > 1 << block_bits else 1
    return level.select(F.lower(F.hex("h")).alias("root"))
