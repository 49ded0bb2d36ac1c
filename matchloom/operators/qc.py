"""Quality reports: metric, value, denominator, percent, ids, one row a metric in a fixed order (column ``ord``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.functions import text as tx
from matchloom.functions.schema import require_columns
from matchloom.operators import matching
from matchloom.operators.trials import SPACE_KEYWORDS, space_id

#: Labels that every patient summary has to name.
PATIENT_KEYWORDS = [
    "Age",
    "Sex",
    "Cancer type",
    "Histology",
    "Current extent",
    "Biomarkers",
    "Treatment history",
]
Stage = Callable[[DataFrame], DataFrame]
COLUMNS = "metric string, value double, denominator bigint, percent double, ids array<string>"


def artifact(rows: DataFrame, metric: str, key: str, denominator: DataFrame, *, joined: str | None = None) -> DataFrame:
    """One report row: the distinct ids of ``rows`` as text, sorted, over the one-row ``denominator``; ``joined`` as in trial_report."""
    found = _lists(rows.select(F.lit(0).alias("at"), F.col(key).cast("string").alias("id")), 1, joined)
    return _row(found.crossJoin(F.broadcast(denominator)), metric, F.col("n"), F.col("ids"), F.col("denominator"))


def _lists(found: DataFrame, metrics: int, joined: str | None, stage: Stage = lambda df: df) -> DataFrame:
    """at, n, ids: the distinct non-null ids of each metric from 0 to ``metrics`` - 1, sorted, out of rows (at, id).

    Ids are dealt by ranges, so each task sorts a run of them; only whole runs meet in a metric's one row.
    """
    every = found.sparkSession.range(metrics).select(F.col("id").cast("int").alias("at"), F.lit(None).cast("string").alias("id"))
    runs = stage(found.unionByName(every)).repartitionByRange("at", "id").withColumn("part", F.spark_partition_id())
    runs = runs.groupBy("at", "part").agg(F.array_sort(F.collect_set("id")).alias("x")).withColumn("n", F.size("x"))
    if joined is not None:
        runs = runs.withColumn("x", F.when(F.col("n") > 0, F.array_join("x", joined)))
    whole = runs.groupBy("at").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "x"))).alias("x"))
    parts = F.transform("x", lambda r: r["x"])
    return whole.select("at", "n", (F.flatten(parts) if joined is None else F.concat_ws(joined, parts)).alias("ids"))


def _row(df: DataFrame, metric: str, value: Column, ids: Column, denominator: Column) -> DataFrame:
    percent = F.when(denominator == 0, F.lit(0.0)).otherwise(value / denominator * 100)
    return df.select(F.lit(metric).alias("metric"), value.cast("double").alias("value"), denominator.cast("bigint").alias("denominator"), percent.alias("percent"), ids.alias("ids"))


def _report(stats: DataFrame, rows: list[tuple[str, Column, Column | None, Column | None]], extra: dict[int, DataFrame]) -> DataFrame:
    """``stats`` has one row; each entry is (metric, value or None for the number of ids, ids, denominator)."""
    cells = []
    for at, (metric, value, ids, denominator) in enumerate(rows):
        ids = F.array().cast("array<string>") if ids is None else F.array_sort(ids)
        value = (F.size(ids) if value is None else value).cast("double")
        den = F.lit(None).cast("bigint") if denominator is None else denominator.cast("bigint")
        percent = F.when(den == 0, F.lit(0.0)).otherwise(value / den * 100)
        cells.append(F.struct(F.lit(float(at)).alias("ord"), F.lit(metric).alias("metric"), value.alias("value"), den.alias("denominator"), percent.alias("percent"), ids.alias("ids")))
    out = stats.select(F.inline(F.array(*cells)))
    for at, df in extra.items():
        out = out.unionByName(df.withColumn("ord", F.lit(at - 0.5)))
    return out


def _ids(test: Column, key: str) -> Column:
    return F.collect_set(F.when(test, F.col(key).cast("string")))


def trial_report(spaces: DataFrame, source: DataFrame, unfiltered: DataFrame, truncated: DataFrame, *, token_limit: int = 2500, tokens=None, keywords: list[str] | None = None, joined: str | None = None, stage: Stage = lambda df: df) -> DataFrame:
    """The report on trial summaries. ``tokens``: text to its embedding tokens.

    With ``joined``, ids are one text with that separator, which takes far less memory than an array; ``truncated`` must have
    them so too. ``stage`` gets the two tables that are read twice, a row a trial and a row a failing id.
    """
    require_columns(source, ["trial_id"], "trial_source")
    require_columns(spaces, ["trial_id", "clinical_space_number", "clinical_space_summary", "general_exclusion_criteria"], "trial_spaces")
    if "space_trial_id" not in spaces.columns:
        spaces = spaces.withColumn("space_trial_id", space_id())
    if "space_trial_id" not in unfiltered.columns:
        unfiltered = unfiltered.withColumn("space_trial_id", space_id())
    keywords = keywords or SPACE_KEYWORDS
    text, rules = F.coalesce("clinical_space_summary", F.lit("")), F.coalesce("general_exclusion_criteria", F.lit(""))
    per = spaces.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.max(tx.strip(text) == "").alias("blank"), F.max(tx.strip(rules).isin("", "None", "none")).alias("no_rules"))
    names = source.select(F.col("trial_id").cast("string").alias("trial_id")).distinct()
    both = stage(names.withColumn("asked", F.lit(True)).join(per.withColumn("trial_id", F.col("trial_id").cast("string")), "trial_id", "full"))
    one = both.agg(
        F.count("asked").alias("asked"), F.count("n").alias("trials"), F.coalesce(F.sum("n"), F.lit(0)).alias("spaces"),
        F.coalesce(F.min("n"), F.lit(0)).alias("lo"), F.coalesce(F.median("n"), F.lit(0.0)).alias("mid"), F.coalesce(F.max("n"), F.lit(0)).alias("hi"),
    )
    two = unfiltered.agg(F.count(F.lit(1)).alias("all_spaces"))

    def twice(df: DataFrame, value: Column) -> DataFrame:
        return df.groupBy("trial_id", value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trial_id")

    # Texts are compared by hash; only trials where two hashes are equal have their texts compared.
    alike = spaces.join(twice(spaces, F.xxhash64(text)).distinct(), "trial_id", "left_semi")
    same = twice(spaces, F.coalesce(F.col("clinical_space_number").cast("string"), F.lit("null"))).unionByName(twice(alike, text))
    size, c = (tokens or matching.embedding_tokens)(text), F.col
    metrics = [
        ("trials_missing_in_output", None, c("asked")),
        ("spaces_exceed_embedding_token_limit", None, c("spaces")),
        ("spaces_per_trial_min", c("lo"), None), ("spaces_per_trial_median", c("mid"), None), ("spaces_per_trial_max", c("hi"), None),
        ("trials_with_non_distinct_spaces", None, c("trials")),
        *((f"spaces_dropped_missing_keyword:{k}", None, c("all_spaces")) for k in keywords),
        ("trials_exclusion_criteria_not_extracted", None, c("trials")),
    ]
    at = {m[0]: i for i, m in enumerate(metrics)}
    failing = lambda df, metric, key: df.select(F.lit(at[metric]).alias("at"), F.col(key).cast("string").alias("id"))
    lacks = F.array_compact(F.array(*(F.when(~F.contains(text, F.lit(k)), F.lit(6 + i)) for i, k in enumerate(keywords))))
    found = unfiltered.select(F.explode(lacks).alias("at"), F.col("space_trial_id").alias("id"))
    for rows, metric, key in (
        (both.where(c("n").isNull() | c("blank")), "trials_missing_in_output", "trial_id"), (spaces.where(size > token_limit), "spaces_exceed_embedding_token_limit", "space_trial_id"),
        (same, "trials_with_non_distinct_spaces", "trial_id"), (both.where("no_rules"), "trials_exclusion_criteria_not_extracted", "trial_id"),
    ):
        found = found.unionByName(failing(rows, metric, key))
    lists = _lists(found.where("id is not null"), len(metrics), joined, stage)
    none = F.lit(None)
    cells = [F.struct(F.lit(i).alias("at"), F.lit(m).alias("metric"), (none if v is None else v).cast("double").alias("fixed"), (none if d is None else d).cast("bigint").alias("denominator")) for i, (m, v, d) in enumerate(metrics)]
    numbers = one.crossJoin(two).select(F.inline(F.array(*cells)))
    value = F.coalesce("fixed", "n").cast("double")
    percent = F.when(c("denominator") == 0, F.lit(0.0)).otherwise(value / c("denominator") * 100)
    out = lists.join(F.broadcast(numbers), "at").select(c("at").cast("double").alias("ord"), "metric", value.alias("value"), "denominator", percent.alias("percent"), "ids")
    return out.unionByName(truncated.withColumn("ord", F.lit(0.5)))


def patient_report(summaries: DataFrame, dropped: DataFrame, *, token_limit: int = 2500, tokens=None, keywords: list[str] | None = None) -> DataFrame:
    """The report on patient summaries, in one pass."""
    require_columns(summaries, ["patient_id", "cancer_history_summary", "general_exclusion_criteria_evidence"], "patient_summaries")
    keywords = keywords or PATIENT_KEYWORDS
    text, rules = F.coalesce("cancer_history_summary", F.lit("")), F.coalesce("general_exclusion_criteria_evidence", F.lit(""))
    size = (tokens or matching.embedding_tokens)(text)
    one = summaries.agg(
        F.count_distinct("patient_id").alias("patients"), _ids(size > token_limit, "patient_id").alias("long"), _ids(tx.strip(text) == tx.strip(rules), "patient_id").alias("same"),
        *(_ids(~F.contains(text, F.lit(k)), "patient_id").alias(f"k{i}") for i, k in enumerate(keywords)),
    )
    c = F.col
    rows = [
        ("patients_exceed_embedding_token_limit", None, c("long"), c("patients")),
        ("patients_exclusion_criteria_not_extracted", None, c("same"), c("patients")),
        *((f"patients_missing_keyword:{k}", None, c(f"k{i}"), c("patients")) for i, k in enumerate(keywords)),
    ]
    return _report(one, rows, {0: dropped})
