"""Scores and verdicts: exact rules as columns over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import level
from larkspur.operators.rules import RANK


def base_score(critical: Column, high: Column, medium: Column, low: Column, other: Column) -> Column:
    """By the worst severity present, more for each further one, each band capped below the next."""
    n_high = F.when(high >= 10, 0.8).when(high >= 5, 0.7).otherwise(0.6)
    return (
        F.when(critical > 0, F.least(F.lit(1.0), 0.85 + 0.05 * (critical - 1)))
        .when(high > 0, F.least(F.lit(0.85), n_high + 0.02 * (high - 1)))
        .when(medium > 0, F.least(F.lit(0.59), 0.4 + 0.03 * (medium - 1)))
        .when(low > 0, F.least(F.lit(0.39), 0.2 + 0.02 * (low - 1)))
        .when(other > 0, 0.1)
        .otherwise(0.0)
    )


def final_score(base: Column, flow: Column, behavior: Column, ml: Column) -> Column:
    """Weighted; a critical or high base keeps its floor."""
    s = 0.7 * base + 0.1 * flow + 0.1 * behavior + 0.1 * ml
    s = F.when(base >= 0.85, F.greatest(s, F.lit(0.8))).when(base >= 0.6, F.greatest(s, F.lit(0.6))).otherwise(s)
    return F.least(F.lit(1.0), s)


def ml_score(critical: Column, high: Column, tainted: Column) -> Column:
    return F.least(F.lit(1.0), F.when(critical > 0, 0.5).otherwise(0.0) + F.when(high > 1, 0.2).otherwise(0.0) + F.when(tainted > 0, 0.2).otherwise(0.0))


def counts() -> list[Column]:
    return [F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s.lower()}") for s in RANK]


def score(findings: DataFrame, key: str, flows: DataFrame | None = None, behaviors: DataFrame | None = None) -> DataFrame:
    """(key, counts, base, flow, behavior, score, level) of findings (severity), flows (is_tainted) and behaviors (risk_score),
    each aggregated by itself before they meet. flow is the share of tainted flows, behavior the mean risk."""
    out = findings.groupBy(key).agg(*counts())
    tainted = F.count(F.when(F.col("is_tainted"), 1))
    for rows, cols in ((flows, [tainted.alias("n_tainted"), (tainted / F.count(F.lit(1))).alias("flow")]), (behaviors, [F.avg("risk_score").alias("behavior")])):
        if rows is not None:
            out = out.join(rows.groupBy(key).agg(*cols), key, "full")
    have = {c: F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0) for c in ("n_critical", "n_high", "n_medium", "n_low", "n_info", "n_tainted", "flow", "behavior")}
    base = base_score(*[have[f"n_{s}"] for s in ("critical", "high", "medium", "low", "info")])
    ml = ml_score(have["n_critical"], have["n_high"], have["n_tainted"])
    out = out.withColumns({c: x for c, x in have.items() if c != "n_tainted"}).withColumn("base", base)
    return out.withColumn("score", final_score(base, have["flow"], have["behavior"], ml)).withColumn("level", level(F.col("score")))


def local_score(critical: Column, high: Column, tainted: Column) -> Column:
    """The score where no ensemble is at hand: a critical finding, more than two high ones, a tainted flow."""
    return F.least(F.lit(1.0), F.when(critical > 0, 0.5).otherwise(0.0) + F.when(high > 2, 0.3).otherwise(0.0) + F.when(tainted > 0, 0.2).otherwise(0.0))


def confidence(files: Column, lines: Column, mean: Column) -> Column:
    return F.least(F.lit(1.0), files / 10 * F.least(lines, F.lit(10000)) / 10000) * F.coalesce(mean, F.lit(1.0))


def multi_vector(findings: DataFrame, key: str, vector: str = "category", place: str = "file", least: int = 3) -> DataFrame:
    """Keys that show at least three different vectors."""
    out = findings.groupBy(key).agg(F.countDistinct(vector).alias("vectors"), F.countDistinct(place).alias("files"))
    return out.filter(F.col("vectors") >= least).withColumn("behavior", F.lit("multi_vector_attack")).withColumn("risk_score", F.lit(0.8))


def risk_matrix(findings: DataFrame, categories: dict[str, list[str]], vector: str = "category") -> DataFrame:
    """(risk, findings, worst) by risk category; a finding may fall under several."""
    rank = F.lit(0)
    for s, r in RANK.items():
        rank = F.when(F.col("severity") == s, r).otherwise(rank)
    hit = F.filter(F.array(*[F.when(F.col(vector).isin(v), k) for k, v in categories.items()]), lambda x: x.isNotNull())
    out = findings.select(F.explode(hit).alias("risk"), rank.alias("rank")).groupBy("risk").agg(F.count(F.lit(1)).alias("findings"), F.max("rank").alias("worst"))
    return out


def classifier_metrics(rows: DataFrame, actual: str, predicted: str, by: str | None = None) -> DataFrame:
    """tp, fp, tn, fn and what follows from them; 0 where a denominator is."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    tally = [F.count(F.when(c, 1)).alias(n) for n, c in (("tp", a & p), ("fp", ~a & p), ("tn", ~a & ~p), ("fn", a & ~p))]
    out = (rows.groupBy(by) if by else rows.groupBy()).agg(*tally)

    def ratio(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x, y), F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return out.select(*out.columns, ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def confirmed(*detections: DataFrame, key: list[str]) -> DataFrame:
    """Keys that at least two sources detect: confidence is the mean, raised by a fifth for each further source.
    Each input has the key, `origin` and `confidence`."""
    rows = detections[0]
    for more in detections[1:]:
        rows = rows.unionByName(more)
    out = rows.groupBy(*key).agg(F.countDistinct("origin").alias("origins"), F.avg("confidence").alias("mean"))
    out = out.filter("origins >= 2")
    return out.select(*key, "origins", F.least(F.lit(1.0), F.col("mean") * (1 + 0.2 * (F.col("origins") - 1))).alias("confidence"))


def runtime_risk(static: Column, llm: Column, anomaly: Column, ml: Column) -> Column:
    """The largest of what the parts say, on the scale of 0 to 10."""
    return F.greatest(static, F.when(llm == "CRITICAL", 9).when(llm == "HIGH", 7).otherwise(0), F.when(anomaly, 7).otherwise(0), F.when(ml > 0.8, 8).otherwise(0))


def runtime_level(risk: Column) -> Column:
    return F.when(risk >= 8, "critical").when(risk >= 6, "high").when(risk >= 4, "medium").otherwise("low")


def tool_score(operations: Column, concerns: Column) -> Column:
    """100 less 30, 20, 15 or 5 for each operation and 25, 15 or 5 for each concern by severity, not below 0."""
    ops, con = {"CRITICAL": 30, "HIGH": 20, "MEDIUM": 15, "LOW": 5}, {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 5}

    def lost(values: Column, cost: dict[str, int]) -> Column:
        def one(x):
            out = F.lit(0)
            for k, v in cost.items():
                out = F.when(x == k, v).otherwise(out)
            return out

        return F.aggregate(values, F.lit(0), lambda a, x: a + one(x))

    return F.greatest(F.lit(0), 100 - lost(operations, ops) - lost(concerns, con))


def prompt_report(findings: DataFrame, key: str) -> DataFrame:
    """10, 5, 2 or 1 a finding by severity, capped at 100; the level is of the uncapped sum: over 50, 25, 10."""
    points = F.sum(F.when(F.col("severity") == "CRITICAL", 10).when(F.col("severity") == "HIGH", 5).when(F.col("severity") == "MEDIUM", 2).otherwise(1))
    out = findings.groupBy(key).agg(points.alias("points"))
    lvl = F.when(F.col("points") > 50, "CRITICAL").when(F.col("points") > 25, "HIGH").when(F.col("points") > 10, "MEDIUM").otherwise("LOW")
    return out.select(key, F.least(F.lit(100), F.col("points")).alias("score"), lvl.alias("level"))
