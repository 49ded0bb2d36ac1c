"""Readers of model answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WS = r"[\s\x1c-\x1f]"


def score_answer(c: Column) -> tuple[Column, Column]:
    """(score 0-5, verdict) from the last 60 characters; (-1, PARSE_FAILED) if there is none."""
    tail = F.replace(F.replace(F.right(F.coalesce(c, F.lit("")), F.lit(60)), F.lit("*"), F.lit("")), F.lit(" "), F.lit(" "))
    upper = F.upper(tail)
    named = F.regexp_extract(tail, rf"(?U)[Ff]inal{_WS}+[Ss]core{_WS}*:{_WS}*(\d)", 1)
    loose = F.regexp_extract(upper, rf"(?U)SCORE{_WS}*[:\-=]{_WS}*(\d)", 1)
    digit = F.when(named != "", named).when(loose != "", loose)
    refused = F.contains(upper, F.lit("NOT REASONABLE")) | F.contains(upper, F.lit("NOT A REASONABLE"))
    score = F.when(digit.isNotNull(), F.coalesce(F.least(digit.try_cast("int"), F.lit(5)), F.lit(-1))).when(refused, 0).otherwise(-1)
    return score, F.when(score < 0, F.lit("PARSE_FAILED")).otherwise(F.concat(F.lit("Score:"), score.cast("string")))


def exclusion_answer(c: Column) -> tuple[Column, Column]:
    """(pass, verdict) from the last 10 characters: yes excludes, no passes, else null and PARSE_FAILED."""
    tail = F.upper(F.right(F.coalesce(c, F.lit("")), F.lit(10)))
    has = lambda s: F.contains(tail, F.lit(s))
    verdict = F.when(has("YES!"), "YES").when(has("NO!"), "NO").when(has("YES"), "YES_FALLBACK").when(has("NO"), "NO_FALLBACK").otherwise("PARSE_FAILED")
    return F.when(verdict.startswith("YES"), False).when(verdict.startswith("NO"), True), verdict
