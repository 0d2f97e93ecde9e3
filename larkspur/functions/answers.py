"""Answers of models: JSON found and mended in free text, then brought into one shape."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "summary string, risk_score double, findings array<struct<severity:string,attack_vector:string,description:string,line_numbers:array<string>,confidence:string,exploitation_scenario:string,remediation:string>>"
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def blocks(text: str) -> list[str]:
    """Balanced {...} blocks outside strings, as they begin; an unclosed one is closed."""
    out, open_, begin, quoted, skip = [], [], 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"' and open_:
            quoted = not quoted
        elif not quoted and c in "{[" and (open_ or c == "{"):
            begin = begin if open_ else i
            open_.append("}" if c == "{" else "]")
        elif not quoted and open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                out.append(text[begin : i + 1])
    if open_:
        out.append(text[begin:] + ('"' if quoted else "") + "".join(reversed(open_)))
    return out


def mended(text: str) -> str:
    """Typographic quotes, commas before a closing bracket and commas missing between lines put right."""
    out = text.translate({0x201C: '"', 0x201D: '"', 0x2019: "'"})
    out = re.sub(r'"\s*\n\s*"', '",\n"', out)
    out = re.sub(r"\}\s*\n\s*\{", "},\n{", out)
    return re.sub(r",\s*([}\]])", r"\1", out)


def found(text: str | None) -> str | None:
    """The JSON object of an answer as compact text: between the markers, in a fence, or the longest that parses."""
    text = text or ""
    marked = re.search(r"JSON_START(.*?)(?:JSON_END|\Z)", text, re.DOTALL) or re.search(r"```(?:json)?(.*?)(?:```|\Z)", text, re.DOTALL)
    for part in ([marked.group(1)] if marked else []) + [text]:
        for block in sorted(blocks(part.translate({0x201C: '"', 0x201D: '"'})), key=len, reverse=True):
            for attempt in (block, mended(block)):
                try:
                    return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
                except (ValueError, RecursionError):
                    continue
    return None


def json_in(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([found(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def normalized(answer: Column) -> Column:
    """struct<summary, risk_score, findings> of an answer's JSON object, every field with its default; null if there is none."""
    a = F.from_json(answer, ANSWER.replace("risk_score double", "risk_score string"))

    def number(x: Column, default: float) -> Column:
        got = x.try_cast("double")
        return F.when(got.isNull() | (got == 0), default).otherwise(got)

    def finding(f: Column) -> Column:
        severity = F.upper(F.coalesce(f["severity"], F.lit("MEDIUM")))
        texts = [F.coalesce(f[c], F.lit("")).alias(c) for c in ("description", "exploitation_scenario", "remediation")]
        vector = F.when(F.coalesce(f["attack_vector"], F.lit("")) == "", "unknown").otherwise(f["attack_vector"])
        lines = F.coalesce(F.transform(f["line_numbers"], lambda n: n.try_cast("int")), F.array().cast("array<int>"))
        return F.struct(F.when(severity.isin(*SEVERITIES), severity).otherwise("MEDIUM").alias("severity"), vector.alias("attack_vector"), lines.alias("line_numbers"), number(f["confidence"], 0.5).alias("confidence"), *texts)

    findings = F.transform(F.filter(F.coalesce(a["findings"], F.array().cast("array<struct<severity:string,attack_vector:string,description:string,line_numbers:array<string>,confidence:string,exploitation_scenario:string,remediation:string>>")), lambda f: f.isNotNull()), finding)
    whole = F.struct(F.coalesce(a["summary"], F.lit("")).alias("summary"), number(a["risk_score"], 0.0).alias("risk_score"), findings.alias("findings"))
    return F.when(answer.isNotNull() & a.isNotNull(), whole)
