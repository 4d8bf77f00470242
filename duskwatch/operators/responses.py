"""Analysis responses: free text holding JSON, brought to clean analysis rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from duskwatch.functions import risk, rules
from duskwatch.functions.columns import norm, strip

PARSED = T.StructType([T.StructField(f, T.StringType()) for f in ("state", *rules.RESPONSE_FIELDS)])


def _text(value: object) -> str:
    if isinstance(value, list):
        return " ".join(t for t in (str(v).strip() for v in value) if t)
    if isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False)
    return "" if value is None else str(value).strip()


def _numbered(value: object) -> str:
    if isinstance(value, dict):
        lines = [f"{k}: {str(v).strip()}" for k, v in value.items() if str(v).strip()]
    elif isinstance(value, list):
        lines = [t for t in (str(v).strip() for v in value) if t]
    else:
        return _text(value)
    return "\n".join(f"{n}. {line}" for n, line in enumerate(lines, start=1))


def _last_complete_object(text: str) -> tuple[str, dict]:
    """The last JSON object holding every required field, searched from the end."""
    decoder, any_object = json.JSONDecoder(), False
    at = text.rfind("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict):
            any_object = True
            if all(f in found for f in rules.RESPONSE_FIELDS):
                return "ok", found
        at = text.rfind("{", 0, at)
    return ("incomplete" if any_object else "unparsed"), {}


@pandas_udf(PARSED)
def parse_response(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch.fillna(""):
            state, found = _last_complete_object(text)
            plain = {f: _text(found.get(f)) for f in rules.RESPONSE_FIELDS}
            plain["recommendation"] = _numbered(found.get("recommendation"))
            rows.append({"state": state, **plain})
        yield pd.DataFrame(rows, columns=["state", *rules.RESPONSE_FIELDS])


def _unless_placeholder(value: Column, replacement: Column) -> Column:
    return F.when(F.lower(value).isin(*rules.PLACEHOLDERS), replacement).otherwise(value)


def normalise_responses(responses: DataFrame) -> DataFrame:
    """Responses (``content, title, description, severity, has_intel`` and keys) to analyses.

    Only locating and decoding the JSON runs in Python; risk folding, placeholder
    replacement and fallbacks are column expressions.
    """
    cleaned = F.replace(F.regexp_replace("content", r"(?i)```json\s*", ""), F.lit("```"), F.lit(""))
    df = responses.withColumn("r", parse_response(strip(cleaned)))
    ok, state = F.col("r.state") == "ok", F.col("r.state")

    detected = F.concat(
        F.lit(rules.SUMMARY_PREFIX), F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit(""))
    )
    explained = F.when(F.col("has_intel"), rules.EXPLANATION_WITH_INTEL).otherwise(rules.EXPLANATION_PLAIN)

    def fallback(field: str) -> Column:
        return F.when(state == "unparsed", rules.UNPARSED_ANALYSIS[field]).otherwise(rules.INCOMPLETE_ANALYSIS[field])

    def pick(good: Column, other: Column) -> Column:
        return F.when(ok, good).otherwise(other)

    kept = [c for c in responses.columns if c != "content"]
    return df.select(
        *kept,
        state.alias("parse_state"),
        pick(_unless_placeholder(F.col("r.summary"), detected), fallback("summary")).alias("summary"),
        pick(risk.normal_risk(F.col("r.risk_level"), norm(F.col("severity"))), F.lit("medium")).alias("risk_level"),
        pick(_unless_placeholder(F.col("r.explanation"), explained), fallback("explanation")).alias("explanation"),
        pick(
            _unless_placeholder(F.col("r.recommendation"), F.lit(rules.RECOMMENDATION_DEFAULT)),
            F.lit(rules.FALLBACK_RECOMMENDATION),
        ).alias("recommendation"),
        pick(
            _unless_placeholder(F.col("r.mitre_technique"), risk.fallback_technique(F.col("title"), F.col("description"))),
            F.lit(rules.FALLBACK_TECHNIQUE),
        ).alias("mitre_technique"),
    )
