"""Joins around the models, and the final ranked table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_context(pairs: DataFrame, summaries: DataFrame, spaces: DataFrame) -> DataFrame:
    """Candidates with both texts, by left joins; each side must have its key once."""
    return pairs.join(summaries, "patient_id", "left").join(spaces, "space_trial_id", "left")


def trial_of_space(pairs: DataFrame) -> DataFrame:
    """trial_id as the text before the first "-"; carry it along instead where ids may hold one."""
    return pairs.withColumn("trial_id", F.substring_index("space_trial_id", "-", 1))


def exclusion_pairs(scored: DataFrame, summaries: DataFrame, spaces: DataFrame) -> DataFrame:
    """Distinct (patient_id, trial_id) with the evidence and the trial's criteria texts."""
    pairs = scored.select("patient_id", "trial_id").distinct()
    criteria = spaces.select("trial_id", "general_exclusion_criteria").distinct()
    return pairs.join(summaries.select("patient_id", "general_exclusion_criteria_evidence"), "patient_id", "left").join(criteria, "trial_id", "left")


def pass_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def final_matches(scored: DataFrame, exclusions: DataFrame, summaries: DataFrame, spaces: DataFrame, trials: DataFrame) -> DataFrame:
    """The best space of each (patient, trial), ranked per patient by score; excluded pairs are marked and stay.

    ``scored`` has patient_id, trial_id, space_trial_id and match_quality_score. Best space and rank come first, on narrow
    rows, and texts are joined to what is left. Ties go to the smaller id.
    """
    best = Window.partitionBy("patient_id", "trial_id").orderBy(F.desc("match_quality_score"), "space_trial_id")
    rank = Window.partitionBy("patient_id").orderBy(F.desc("match_quality_score"), "trial_id")
    out = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("match_rank", F.row_number().over(rank))
    out = out.join(exclusions.dropDuplicates(["patient_id", "trial_id"]), ["patient_id", "trial_id"], "left")
    out = out.join(summaries.dropDuplicates(["patient_id"]), "patient_id", "left")
    out = out.join(spaces.drop("trial_id").dropDuplicates(["space_trial_id"]), "space_trial_id", "left")
    out = out.join(trials.dropDuplicates(["trial_id"]), "trial_id", "left")
    # Names and order of the result's columns.
    names = {
        "exclusion_criteria_pass": "passes_exclusion_criteria", "cancer_history_summary": "patient_summary", "general_exclusion_criteria_evidence": "patient_exclusion_evidence",
        "brief_summary": "trial_brief_summary", "eligibility_criteria": "trial_eligibility_criteria", "clinical_space_summary": "matched_clinical_space_summary",
        "general_exclusion_criteria": "extracted_trial_exclusion_criteria",
    }
    out = out.withColumnsRenamed(names)
    order = ["patient_id", "trial_id", "match_rank", "passes_exclusion_criteria", "patient_summary", "patient_exclusion_evidence", "trial_title", "trial_brief_summary", "trial_eligibility_criteria", "clinical_space_number", "matched_clinical_space_summary", "extracted_trial_exclusion_criteria"]
    return out.select(*(c for c in order if c in out.columns))
