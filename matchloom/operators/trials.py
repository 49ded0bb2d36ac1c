"""Criteria documents to target profiles ("spaces"): one row per numbered item of a generated answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.config import Config, load_preset
from matchloom.functions import text as tx
from matchloom.functions.schema import require_columns
from matchloom.operators import models

INPUT = ["trial_id", "trial_title", "brief_summary", "eligibility_criteria"]
#: Labels that every space has to name.
SPACE_KEYWORDS = [
    "Age",
    "Sex",
    "Cancer type",
    "Histology",
    "Cancer burden",
    "Prior treatment required",
    "Prior treatment excluded",
    "Biomarkers required",
    "Biomarkers excluded",
]
PRIMER = "List the groups of subjects that the following document asks for, one numbered line each.\n"
QUESTION = "Then give general exclusions after a line that says: {marker}\n"


def trial_text(title: Column, brief: Column, criteria: Column) -> Column:
    return tx.collapse(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in (title, brief, criteria))))


def build_trial_text(trials: DataFrame) -> DataFrame:
    return trials.withColumn("trial_text", trial_text(F.col("trial_title"), F.col("brief_summary"), F.col("eligibility_criteria")))


def trial_messages(text: Column, primer: str = PRIMER, question: str = QUESTION, lead: str = "Document:\n") -> Column:
    return models.messages(F.concat(F.lit(primer + lead), text, F.lit("\n" + question)), "\nReasoning: high.\n")


def default_generator(marker: str) -> models.Generator:
    """The document as one space that names every keyword, and no exclusions."""
    labels = "; ".join(f"{k}: any" for k in SPACE_KEYWORDS)
    body = lambda c: F.regexp_extract(c, r"(?s)Document:\n(.*)\nThen give", 1)
    return models.expression_generator(lambda c: F.concat(F.lit(f"1. {labels}; Text: "), body(c), F.lit(f"\n{marker}\nNone")))


def run_summaries(trials: DataFrame, generate: models.Generator, marker: str, raw: bool = True) -> DataFrame:
    """trial_text, space_output_no_reasoning, space_reasoning, space_raw_output and finish_reason, by one generation a trial."""
    asked = build_trial_text(trials).withColumn("messages", trial_messages(F.col("trial_text"), question=QUESTION.format(marker=marker)))
    out = generate(asked).withColumn("space_output_no_reasoning", F.col("generated.final")).withColumn("space_reasoning", F.col("generated.reasoning"))
    if raw:
        out = out.withColumn("space_raw_output", F.col("generated.raw"))
    return out.withColumn("finish_reason", F.col("generated.finish_reason")).drop("generated", "messages")


def expand_spaces(summaries: DataFrame, marker: str) -> DataFrame:
    """One row per numbered line before the marker's line, numbered anew from 1; a trial without one gives none."""
    df = summaries.withColumn("_s", tx.section_split(F.coalesce("space_output_no_reasoning", F.lit("None")), [marker]))
    df = df.select("*", F.posexplode(tx.numbered_items(F.col("_s.main"))).alias("_at", "clinical_space_summary"))
    df = df.withColumn("space_text", F.col("_s.main")).withColumn("boilerplate_text", F.col("_s.rest"))
    return df.withColumn("clinical_space_number", F.col("_at") + 1).drop("_at", "_s")


def keyword_filter(spaces: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Spaces that contain all keywords, case-sensitively. The numbers stay, so they may have gaps."""
    for k in keywords or SPACE_KEYWORDS:
        spaces = spaces.where(F.contains("clinical_space_summary", F.lit(k)))
    return spaces


def space_id() -> Column:
    return F.concat(F.col("trial_id").cast("string"), F.lit("-"), F.col("clinical_space_number").cast("string"))


def to_spaces(summaries: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(trial_spaces, unfiltered spaces)."""
    unfiltered = expand_spaces(summaries, config.trial["boilerplate_marker"])
    out = keyword_filter(unfiltered).withColumn("general_exclusion_criteria", F.col("boilerplate_text")).withColumn("space_trial_id", space_id())
    columns = ["trial_id", "clinical_space_number", "clinical_space_summary", "general_exclusion_criteria", "space_trial_id"]
    if config.debug_mode:
        columns += [c for c in ("trial_text", "space_output_no_reasoning", "space_reasoning", "space_raw_output") if c in out.columns]
    return out.select(*columns), unfiltered


def summarize_trials(trials: DataFrame, *, config: Config | None = None, generate: models.Generator | None = None, return_metadata: bool = False, return_qc: bool = False):
    """Spaces of ``trials``; with metadata and a QC report if asked. The generation is persisted only where QC reads it again."""
    config = config or load_preset()
    require_columns(trials, INPUT, "trials")
    marker = config.trial["boilerplate_marker"]
    made = run_summaries(trials, generate or default_generator(marker), marker)
    if return_qc:
        made = made.persist()
    spaces, unfiltered = to_spaces(made, config)
    out: list = [spaces]
    if return_metadata:
        out.append({"config_snapshot": config.snapshot(), "model_metadata": {"name": config.trial.get("model_name")}})
    if return_qc:
        from matchloom.operators import qc

        truncated = qc.artifact(made.where("finish_reason = 'length'"), "trials_truncated", "trial_id", made.agg(F.count(F.lit(1)).alias("denominator")))
        out.append(qc.trial_report(spaces, trials, unfiltered.withColumn("space_trial_id", space_id()), truncated))
    return out[0] if len(out) == 1 else tuple(out)
