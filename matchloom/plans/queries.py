"""Registered queries over the sample tables, which stand in for clinical ones, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchloom.functions import parse, vector
from matchloom.operators import assemble, evaluate, matching, patients, qc, trials
from matchloom.plans.pipeline import MatchingPipeline
from matchloom.sources import staging, tables

MARKER = "Boilerplate exclusions"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# ---- inputs


def _query_vectors(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").where("label = 0").select(F.col("vec_id").cast("string").alias("patient_id"), "embedding")


def _corpus_vectors(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").where("label <> 0").select(F.concat(F.lit("T"), F.col("label"), F.lit("-"), F.col("vec_id")).alias("space_trial_id"), "embedding")


def _notes(s: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int"))
    return read(s, d, "conversations").select(F.col("conv_id").alias("patient_id"), F.col("text").alias("note_text"), day.alias("note_date"), F.col("turn").alias("note_ord"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """An answer per order: its lines as numbered spaces, of which returned ones name no histology, then the marker and exclusions."""
    keys = [k for k in trials.SPACE_KEYWORDS if k != "Histology"]
    line = lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(". " + " ".join(f"{k}:" for k in keys)), F.when(x["r"], "").otherwise(" Histology: any"), F.lit(" part "), x["l_partkey"].cast("string"))
    returned = F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("r")  # sorts as the texts do
    lines = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", returned))).alias("x"))
    orders = read(s, d, "orders").select(F.col("o_orderkey").alias("trial_id"), "o_orderpriority", "o_orderstatus")
    text = F.concat(F.array_join(F.transform("x", line), "\n"), F.lit(f"\n{MARKER}:\n"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")))
    return orders.join(lines, "trial_id").select("trial_id", text.alias("space_output_no_reasoning"))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """Documents as summaries: English ones have a marked second part, some sources have texts without information."""
    text = F.concat(F.when(F.col("source") == "src1", "No information on ").when(F.col("source") == "src2", "There is no CANCER in ").otherwise(""), F.col("text"))
    marked = F.when(F.col("lang") == "en", F.concat(text, F.lit("\nBoilerplate: of\n"), F.col("source"))).otherwise(text)
    return read(s, d, "documents").select(F.col("doc_id").alias("patient_id"), marked.alias("original_patient_summary"))


def _responses(s: SparkSession, d: str) -> DataFrame:
    kinds = [F.lit(t) for t in ("Fine.\n**Final score: 4**", "final Score:9", "overall SCORE - 3", "this is not a reasonable match", "no verdict", "x Final  score : 07 and so on")]
    return read(s, d, "labels").select("doc_id", F.get(F.array(*kinds), F.pmod(F.col("doc_id") + F.col("quality"), F.lit(6)).cast("int")).alias("response"))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    kinds = [F.lit(t) for t in ("So: Yes!", "In the end No!", "yes", "UNKNOWN", "?", "Yes! But no!")]
    return read(s, d, "labels").select("doc_id", F.get(F.array(*kinds), F.pmod(F.col("doc_id") + F.col("toxic"), F.lit(6)).cast("int")).alias("response"))


# ---- queries


def _rounded(c: str) -> Column:
    """``round(c, 6)``; decimals, which are slow, only where a value is near the middle of two."""
    scaled = F.col(c) * 1e6
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) < 0.4999, whole / 1e6 + 0.0).otherwise(F.round(c, 6))


def candidate_topk(s: SparkSession, d: str, k: int | None = 20) -> DataFrame:
    out = matching.candidates(_query_vectors(s, d), _corpus_vectors(s, d), k=k)
    return out.select("patient_id", "space_trial_id", _rounded("similarity_score").alias("similarity_score"), F.col("rank").cast("bigint").alias("rank"))


def candidate_all(s: SparkSession, d: str) -> DataFrame:
    return candidate_topk(s, d, None)


def best_match_bidirectional(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings").select(F.col("label").alias("trial_id"), F.col("vec_id").alias("id"), "embedding")
    flipped = v.withColumn("embedding", F.reverse("embedding"))
    out = evaluate.best_match_both_ways(v, flipped)
    return out.select("trial_id", "n_pkg_spaces", "n_gold_spaces", *(F.round(c, 6).alias(c) for c in ("pkg_to_gold", "gold_to_pkg", "trial_score")))


def embedding_similarity(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "embeddings").select("vec_id", "embedding")
    out = evaluate.embedding_similarity(v, v.select("vec_id", F.reverse("embedding").alias("gold_embedding")), "vec_id")
    return out.select("vec_id", F.round("cosine", 6).alias("cosine"))


def _consistency(s: SparkSession, d: str) -> DataFrame:
    def run(width: int) -> DataFrame:
        cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, width))
        found = matching.candidates(cut(_query_vectors(s, d)), cut(_corpus_vectors(s, d)), k=10)
        return found.withColumnRenamed("space_trial_id", "trial_id")

    return evaluate.match_consistency(run(64), run(32))


def match_consistency(s: SparkSession, d: str) -> DataFrame:
    out = _consistency(s, d)
    rounded = [F.round(c, 6).alias(c) for c in ("full_set_jaccard", "top5_overlap_fraction", "top10_overlap_fraction", "mean_top5_score_a", "mean_top5_score_b")]
    return out.select("patient_id", "n_trials_a", "n_trials_b", "top1_agreement", *rounded)


def match_consistency_summary(s: SparkSession, d: str) -> DataFrame:
    out = evaluate.consistency_summary(_consistency(s, d))
    return out.select(*(F.col(c) if c == "n_patients" else F.round(c, 6).alias(c) for c in out.columns))


def trial_text(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").select(F.col("doc_id").alias("trial_id"), F.col("source").alias("trial_title"), F.col("lang").alias("brief_summary"), F.col("text").alias("eligibility_criteria"))
    return trials.build_trial_text(docs).select("trial_id", "trial_text")


def trial_spaces(s: SparkSession, d: str) -> DataFrame:
    spaces = trials.keyword_filter(trials.expand_spaces(_answers(s, d), MARKER))
    return spaces.select("trial_id", "clinical_space_number", "clinical_space_summary", F.col("boilerplate_text").alias("general_exclusion_criteria"), trials.space_id().alias("space_trial_id"))


def trial_spaces_unfiltered(s: SparkSession, d: str) -> DataFrame:
    return trials.expand_spaces(_answers(s, d), MARKER).select("trial_id", "clinical_space_number", "clinical_space_summary", "boilerplate_text")


def note_dedup(s: SparkSession, d: str) -> DataFrame:
    out = patients.dedup_notes(patients.validate_notes(_notes(s, d)))
    return out.select("patient_id", F.date_format("note_date", "yyyy-MM-dd").alias("note_date"), "note_text")


def note_chunks(s: SparkSession, d: str) -> DataFrame:
    return patients.chunk_notes(patients.validate_notes(_notes(s, d)), 40, 5)


def incremental_notes(s: SparkSession, d: str) -> DataFrame:
    events = read(s, d, "events").select(F.col("user_id").cast("string").alias("patient_id"), F.col("ts").alias("note_date"), "event_id")
    state = events.where("note_date < '2024-01-15'").groupBy("patient_id").agg(F.to_date(F.max("note_date")).alias("_last_note_date"))
    state = state.where("_last_note_date < '2024-01-14'")
    out = patients.newer_notes(events, state, F.lit("2024-01-20").cast("date"))
    return out.select("patient_id", "event_id")


def prior_state(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    rows = docs.select(F.col("source").alias("patient_id"), day.alias("last_note_date"), F.col("text").alias("cancer_history_summary"), F.col("lang").alias("general_exclusion_criteria_evidence"), F.col("doc_id").alias("row_ord"))
    return patients.validate_existing(rows).select("patient_id", "last_note_date", "patient_summary_with_boilerplate")


def serial_fold(s: SparkSession, d: str) -> DataFrame:
    empty = s.createDataFrame([], "patient_id string, patient_summary_with_boilerplate string")
    step = lambda prior, c: F.concat(prior, F.lit("|"), F.length(c["chunk_text"]).cast("string"))
    return patients.fold_groups(note_chunks(s, d), empty, step)


def summary_split(s: SparkSession, d: str) -> DataFrame:
    out = patients.split_summary(_summaries(s, d), "Boilerplate conditions:")
    return out.select("patient_id", "cancer_history_summary", "general_exclusion_criteria_evidence")


def summary_clean(s: SparkSession, d: str) -> DataFrame:
    out = patients.informative(patients.split_summary(_summaries(s, d), "Boilerplate conditions:"))[0]
    return out.select("patient_id", "cancer_history_summary")


def quality_score(s: SparkSession, d: str) -> DataFrame:
    pairs = read(s, d, "labels").join(read(s, d, "documents"), "doc_id").select(F.col("doc_id").alias("patient_id"), F.col("source").alias("space_trial_id"), (F.col("quality") * 2.5 - F.col("toxic") * 4 - 0.5).alias("raw"))
    out = matching.score_match_quality(pairs, raw="raw", filter_low_quality=False)
    return out.withColumn("match_quality_score", F.round("match_quality_score", 5))


def exclusion_label(s: SparkSession, d: str) -> DataFrame:
    pairs = read(s, d, "labels").join(read(s, d, "documents"), "doc_id")
    pairs = pairs.select(F.col("doc_id").alias("patient_id"), F.col("source").alias("trial_id"), F.when(F.col("toxic") == 1, "POSITIVE").otherwise(" Negative\n").alias("l"), F.when(F.col("quality") == 1, 0.81).otherwise(0.66).alias("p"))
    return matching.check_exclusions(pairs, predicted=("l", "p"))


def llm_score_parse(s: SparkSession, d: str) -> DataFrame:
    score, verdict = parse.score_answer(F.col("response"))
    return _responses(s, d).select("doc_id", score.alias("score"), verdict.alias("verdict"))


def llm_exclusion_parse(s: SparkSession, d: str) -> DataFrame:
    passed, verdict = parse.exclusion_answer(F.col("response"))
    return _verdicts(s, d).select("doc_id", passed.alias("passed"), verdict.alias("verdict"))


def final_matches(s: SparkSession, d: str) -> DataFrame:
    found = assemble.trial_of_space(matching.candidates(_query_vectors(s, d), _corpus_vectors(s, d), k=20))
    scored = matching.score_match_quality(found.withColumn("raw", F.round("similarity_score", 6) * 4 - 2), raw="raw", cutoff=0.2)
    scored = assemble.trial_of_space(scored.withColumn("match_quality_score", F.round("match_quality_score", 5)))
    label = F.when(F.right("patient_id", F.lit(1)) == F.right("trial_id", F.lit(1)), "POSITIVE").otherwise("NEGATIVE")
    exclusions = matching.check_exclusions(scored.select("patient_id", "trial_id").distinct().withColumn("l", label).withColumn("p", F.lit(0.9)), predicted=("l", "p"))
    vectors = read(s, d, "embeddings")
    summaries = vectors.where("label = 0").select(F.col("vec_id").cast("string").alias("patient_id"), F.concat(F.lit("subject "), F.col("vec_id")).alias("cancer_history_summary"), F.lit("None").alias("general_exclusion_criteria_evidence"))
    spaces = vectors.where("label <> 0").select(F.concat(F.lit("T"), F.col("label"), F.lit("-"), F.col("vec_id")).alias("space_trial_id"), F.concat(F.lit("T"), F.col("label")).alias("trial_id"), F.col("vec_id").alias("clinical_space_number"), F.concat(F.lit("space "), F.col("vec_id")).alias("clinical_space_summary"), F.lit("rules").alias("general_exclusion_criteria"))
    table = vectors.where("label <> 0").select(F.concat(F.lit("T"), F.col("label")).alias("trial_id"), F.concat(F.lit("Trial "), F.col("label")).alias("trial_title")).distinct()
    out = assemble.final_matches(scored, exclusions, summaries, spaces, table)
    return out.withColumn("match_rank", F.col("match_rank").cast("bigint"))


def _flat(report: DataFrame) -> DataFrame:
    return report.select("metric", F.round("value", 6).alias("value"), "denominator", F.round("percent", 6).alias("percent"), (F.col("ids") if dict(report.dtypes)["ids"] == "string" else F.array_join("ids", ",")).alias("ids"))


def trial_qc(s: SparkSession, d: str) -> DataFrame:
    made = trials.expand_spaces(_answers(s, d), MARKER)
    unfiltered = staging.staged(made.select("trial_id", "clinical_space_number", "clinical_space_summary", "boilerplate_text"))  # read several times
    spaces = trials.keyword_filter(unfiltered).withColumnRenamed("boilerplate_text", "general_exclusion_criteria").withColumn("space_trial_id", trials.space_id())
    source = read(s, d, "orders").select(F.col("o_orderkey").alias("trial_id"))
    truncated = qc.artifact(read(s, d, "orders").where("o_totalprice > 400000"), "trials_truncated", "o_orderkey", source.agg(F.count(F.lit(1)).alias("denominator")), joined=",")
    return _flat(qc.trial_report(spaces, source, unfiltered, truncated, token_limit=18, joined=",", stage=staging.staged))


def patient_qc(s: SparkSession, d: str) -> DataFrame:
    split = staging.checkpointed(patients.split_summary(_summaries(s, d), "Boilerplate conditions:"))  # four reads
    kept, said = patients.informative(split)
    gone = said.join(kept.select("patient_id"), "patient_id", "left_anti")
    dropped = qc.artifact(gone, "patients_dropped_noninformative_summary", "patient_id", said.agg(F.count_distinct("patient_id").alias("denominator")))
    return _flat(qc.patient_report(kept, dropped, token_limit=300))


def token_limit(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", matching.embedding_tokens(F.col("text"), "query:").alias("n_tokens"))


def verdict_counts(s: SparkSession, d: str) -> DataFrame:
    return assemble.pass_counts(exclusion_label(s, d), "exclusion_criteria_pass")


def matching_flow(s: SparkSession, d: str) -> DataFrame:
    """The whole flow with offline models: pages as trials, conversations as notes."""
    pages = read(s, d, "pages").select(F.concat(F.lit("T"), F.col("page_id")).alias("trial_id"), F.col("url").alias("trial_title"), F.lit("").alias("brief_summary"), F.col("html").alias("eligibility_criteria"))
    return MatchingPipeline().run(pages, _notes(s, d))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = staging.scratch(s, "csv")
    tables.write_csv(read(s, d, "documents").select("doc_id", "text", "lang"), path)
    return tables.read_csv(s, path, ["doc_id", "text", "lang"])


def parquet_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = staging.scratch(s, "parquet")
    tables.write_parquet(read(s, d, "pages").select("page_id", "url", "html"), path)
    return tables.read_parquet(s, path)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """A patient for each source, a space for each document."""
    return read(s, d, "documents").select(F.col("source").alias("patient_id"), F.concat(F.lit("T"), F.col("doc_id") % 40, F.lit("-"), F.col("doc_id") % 3).alias("space_trial_id"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("evidence of "), F.col("source"))
    return read(s, d, "documents").where("source <> 'src1'").select(F.col("source").alias("patient_id"), said.alias("general_exclusion_criteria_evidence")).distinct()


def _page_spaces(s: SparkSession, d: str) -> DataFrame:
    trial = F.concat(F.lit("T"), F.col("page_id"))
    return read(s, d, "pages").where("page_id < 30").select(F.concat(trial, F.lit("-1")).alias("space_trial_id"), trial.alias("trial_id"), F.col("url").alias("general_exclusion_criteria"))


def context_pairs(s: SparkSession, d: str) -> DataFrame:
    return assemble.with_context(_pairs(s, d), _sources(s, d), _page_spaces(s, d).drop("trial_id"))


def exclusion_context(s: SparkSession, d: str) -> DataFrame:
    return assemble.exclusion_pairs(assemble.trial_of_space(_pairs(s, d)), _sources(s, d), _page_spaces(s, d))


def vector_literal(s: SparkSession, d: str) -> DataFrame:
    literal = F.concat(F.lit("["), F.col("doc_id"), F.lit(".5 "), F.col("n_chars"), F.lit(",  x]"))
    made = read(s, d, "documents").select("doc_id", vector.parse_vector(literal).alias("v"))
    return made.select("doc_id", F.size("v").alias("n"), *(F.get("v", F.lit(i)).alias(c) for i, c in enumerate("abc")))


def drift(s: SparkSession, d: str) -> DataFrame:
    gate = evaluate.drift_gate(embedding_similarity(s, d))
    return gate.select(F.round("mean_cosine", 5).alias("mean_cosine"), "n", "passed")


def drift_worst(s: SparkSession, d: str) -> DataFrame:
    found = embedding_similarity(s, d)
    return evaluate.worst(found, found.columns[0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        candidate_topk, candidate_all, best_match_bidirectional, embedding_similarity, match_consistency, match_consistency_summary, trial_text, trial_spaces, trial_spaces_unfiltered,
        note_dedup, note_chunks, incremental_notes, prior_state, serial_fold, summary_split, summary_clean, quality_score, exclusion_label, llm_score_parse, llm_exclusion_parse,
        final_matches, trial_qc, patient_qc, token_limit, verdict_counts, csv_round_trip, parquet_round_trip, context_pairs, exclusion_context, vector_literal, drift, drift_worst, matching_flow,
    )
    return {f.__name__: f for f in own}
