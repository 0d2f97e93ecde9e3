"""The functions that SQL can call, registered on a session under names that begin with `lk_`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from larkspur.functions import python as P
from larkspur.operators import rules
from larkspur.session import ship

#: name: (parameters, body) of plain SQL functions; they stay inside the optimizer.
PLAIN = {
    "lk_level": ("score DOUBLE", "CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END"),
    "lk_redacted": ("hit STRING", "CASE WHEN length(hit) > 4 THEN concat(left(hit, 2), repeat('*', length(hit) - 4), right(hit, 2)) ELSE hit END"),
    "lk_cache_key": ("content STRING, suffix STRING", "substring(sha2(concat_ws(':', content, suffix, cast(length(content) AS STRING)), 256), 1, 16)"),
    "lk_tokens": ("content STRING", "floor(length(content) / 4)"),
}


def register(spark: SparkSession) -> list[str]:
    """Register the scalar functions and the table function `lk_scan(text)`; returns their names."""
    ship(spark)
    for name, (parameters, body) in PLAIN.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    spark.udf.register("lk_indel_ratio", P.indel_ratio, "double")
    own = [tuple(r) for r in rules.library("registry")]

    class Scan:
        def eval(self, text: str):
            import re

            for _, category, name, pattern, severity, confidence, cwe in own:
                body = re.sub(r"^\(\?([a-z]+)\)", "", pattern)
                flags = (re.match(r"^\(\?([a-z]+)\)", pattern) or [None, ""])[1]
                for m in re.finditer(body, text or "", sum(getattr(re, f.upper()) for f in set(flags))):
                    yield category, name, severity, confidence, cwe, m.start(), m[0][:100]

    spark.udtf.register("lk_scan", udtf(Scan, returnType="category string, name string, severity string, confidence double, cwe string, offset int, hit string"))
    return [*PLAIN, "lk_indel_ratio", "lk_scan"]
