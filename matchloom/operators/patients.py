"""Dated notes to one running summary per patient: validation, incremental filter, sentence dedup, chunks, serial fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.config import Config, load_preset
from matchloom.functions import text as tx
from matchloom.functions.schema import require_columns
from matchloom.operators import models
from matchloom.sources.staging import checkpointed

LOOKBACK_DAYS = 10
RESPONSE_MARGIN = 256
NO_PRIOR = "None - this is the first segment"
#: Markers of the second section besides the configured one; what marks a summary as without information.
MARKERS = ["Boilerplate conditions:", "BOILERPLATE CONDITIONS:", "boilerplate conditions:", "Boilerplate:", "BOILERPLATE:", "boilerplate:"]
UNINFORMATIVE = r"(?i)no cancer|no primary|no evidence of malignancy"
UNINFORMATIVE_START = "No information"
HEADER = "=== Note dated {} ==="
_HEADER_DATE = r"=== Note dated (\d{4}-\d{2}-\d{2}) ==="
_STATE = ["patient_id", "last_note_date", "_last_note_date", "patient_summary_with_boilerplate"]


def validate_notes(notes: DataFrame) -> DataFrame:
    """patient_id, note_text, note_date (timestamp), note_ord: rows with text. A bad date fails when it is read.

    ``note_ord`` orders notes of one time; without one in the input it is made at ingest.
    """
    require_columns(notes, ["patient_id", "note_text", "note_date"], "notes")
    order = F.col("note_ord") if "note_ord" in notes.columns else F.monotonically_increasing_id()
    df = notes.where(F.col("note_text").isNotNull())
    return df.select(F.col("patient_id").cast("string").alias("patient_id"), F.col("note_text").cast("string").alias("note_text"), F.col("note_date").cast("timestamp").alias("note_date"), order.alias("note_ord"))


def validate_existing(existing: DataFrame, marker: str = "Boilerplate conditions:", validate: bool = True) -> DataFrame:
    """Prior state in its one layout from any of four; bad dates raise with their ids, and a patient's last row wins."""
    require_columns(existing, ["patient_id", "last_note_date"], "existing summaries")
    have = set(existing.columns)
    joined = lambda a, b: tx.strip(F.concat(tx.strip(F.coalesce(F.col(a), F.lit(""))), F.lit(f"\n\n{marker}\n"), tx.strip(F.coalesce(F.col(b), F.lit("")))))
    if "patient_summary_with_boilerplate" in have:
        text = F.col("patient_summary_with_boilerplate")
    elif {"cancer_history_summary", "general_exclusion_criteria_evidence"} <= have:
        text = joined("cancer_history_summary", "general_exclusion_criteria_evidence")
    elif {"patient_summary", "patient_boilerplate_text"} <= have:
        text = joined("patient_summary", "patient_boilerplate_text")
    elif "patient_summary" in have:
        text = F.col("patient_summary")
    else:
        raise ValueError("existing summaries need patient_summary_with_boilerplate, patient_summary, or a pair of summary and boilerplate columns")
    day = F.to_date(F.try_to_timestamp(F.col("last_note_date").cast("string")))
    order = F.col("row_ord") if "row_ord" in have else F.monotonically_increasing_id()
    df = existing.select(F.col("patient_id").cast("string").alias("patient_id"), day.alias("_last_note_date"), text.alias("patient_summary_with_boilerplate"), order.alias("_ord"))
    if validate:
        bad = df.where("_last_note_date is null").select("patient_id").distinct().orderBy("patient_id").limit(100).collect()
        if bad:
            raise ValueError(f"existing summaries have an invalid or missing last_note_date for: {', '.join(str(r[0]) for r in bad)}")
    last = Window.partitionBy("patient_id").orderBy(F.desc("_ord"))
    df = df.withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumn("last_note_date", F.date_format("_last_note_date", "yyyy-MM-dd"))
    return df.select(*_STATE)


def newer_notes(notes: DataFrame, state: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Notes of patients without state, and those after the cutoff: the last date, less ten days if it is recent."""
    as_of = F.current_date() if as_of is None else as_of
    last = F.col("_last_note_date")
    cutoff = F.when(last < F.date_sub(as_of, LOOKBACK_DAYS), last).otherwise(F.date_sub(last, LOOKBACK_DAYS))
    cuts = state.select("patient_id", cutoff.alias("_cutoff"))
    kept = notes.join(cuts, "patient_id", "left").where(F.col("_cutoff").isNull() | (F.to_date("note_date") > F.col("_cutoff")))
    return kept.select(*notes.columns)


def dedup_notes(notes: DataFrame) -> DataFrame:
    """patient_id, note_date, note_ord, note_text: each sentence stays where the patient's notes first have it; empty notes go."""
    parts = notes.select("patient_id", "note_date", "note_ord", F.posexplode(tx.sentences(F.col("note_text"))).alias("pos", "sentence"))
    at = F.struct("note_date", "note_ord", "pos")
    first = parts.groupBy("patient_id", "sentence").agg(F.min(at).alias("at"))
    back = first.groupBy("patient_id", "at.note_date", "at.note_ord").agg(F.array_sort(F.collect_list(F.struct("at.pos", "sentence"))).alias("s"))
    return back.select("patient_id", "note_date", "note_ord", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("note_text"))


def chunk_notes(notes: DataFrame, size: int = 10000, overlap: int = 500, tokens: Callable[[Column], Column] = tx.word_tokens, joiner: str = " ") -> DataFrame:
    """patient_id, chunk_index, first_date, last_date, chunk_text: a patient's notes under dated headers, cut to windows of tokens.

    A patient with at most ``size`` tokens keeps the text as it is. A window's dates are those of the headers in it, else
    the date that the window before ended with.
    """
    if overlap >= size:
        raise ValueError("the overlap must be less than the chunk size")
    stride, day = size - overlap, F.date_format("note_date", "yyyy-MM-dd")
    head = F.concat(F.lit(HEADER.split("{}")[0]), day, F.lit(HEADER.split("{}")[1]))
    block = F.struct("note_date", "note_ord", day.alias("day"), F.concat(head, F.lit("\n"), F.col("note_text"), F.lit("\n")).alias("text"))
    whole = notes.groupBy("patient_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    whole = whole.select("patient_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.get("b", F.lit(0))["day"].alias("d0"), F.element_at("b", -1)["day"].alias("d1"))
    whole = whole.withColumn("t", tokens(F.col("text")))
    n = F.size("t")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / F.lit(stride)).cast("int"))
    # Windows are cut before they become rows, so that no row carries the whole text.
    window = lambda i: F.array_join(F.slice("t", i * stride + 1, F.lit(size)), joiner)
    texts = F.when(n <= size, F.array("text")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), window))
    cut = whole.select("patient_id", n.alias("n"), "d0", "d1", F.posexplode(texts).alias("chunk_index", "chunk_text"))
    dates = F.regexp_extract_all("chunk_text", F.lit(_HEADER_DATE), F.lit(1))
    cut = cut.withColumn("own", dates)
    before = F.last(F.when(F.size("own") > 0, F.element_at("own", -1)), ignorenulls=True).over(Window.partitionBy("patient_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    one, has = F.col("n") <= size, F.size("own") > 0
    carried = F.coalesce(before, F.col("d0"))
    first = F.when(one, F.col("d0")).when(has, F.get("own", F.lit(0))).otherwise(carried)
    return cut.select("patient_id", "chunk_index", first.alias("first_date"), F.when(one, F.col("d1")).otherwise(carried).alias("last_date"), "chunk_text")


def prepare_notes(notes: DataFrame, size: int = 10000, overlap: int = 500, tokens: Callable[[Column], Column] = tx.word_tokens, joiner: str = " ") -> tuple[DataFrame, DataFrame]:
    """(patient_id with last_note_date of the last note that still has text, "" if none; chunks)."""
    left = dedup_notes(notes)
    last = left.groupBy("patient_id").agg(F.date_format(F.max("note_date"), "yyyy-MM-dd").alias("last_note_date"))
    ids = notes.select("patient_id").distinct().join(last, "patient_id", "left")
    return ids.select("patient_id", F.coalesce("last_note_date", F.lit("")).alias("last_note_date")), chunk_notes(left, size, overlap, tokens, joiner)


def serial_messages(prior: Column, first: Column, last: Column, chunk: Column, system: str = "") -> Column:
    body = F.concat(
        F.lit("Update the summary of one subject.\n---\nPRIOR SUMMARY:\n"), F.when(F.coalesce(prior, F.lit("")) == "", F.lit(NO_PRIOR)).otherwise(prior),
        F.lit("\n\nNEXT SEGMENT ("), first, F.lit(" to "), last, F.lit("):\n"), chunk, F.lit("\n---\nGive the whole summary.\n"),
    )
    return models.messages(body, system)


def generation_tokens(prompt_tokens: Column, context: int, most: int, margin: int = RESPONSE_MARGIN) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(context) - prompt_tokens - margin, F.lit(most)))


def truncate_chunk(c: Column, tokens=tx.word_tokens, joiner: str = " ", context: int = 100000, margin: int = 5000) -> Column:
    return tx.middle_cut(c, tokens, joiner, max(1024, context - margin))


def fold_rounds(chunks: DataFrame, state: DataFrame, generate: models.Generator, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """patient_id, final, reasoning, raw after all chunks, in rounds: round i sends every patient's i-th chunk with its summary so far.

    ``save`` writes a frame and reads it back, which cuts lineage after each round.
    """
    last = chunks.agg(F.max("chunk_index")).first()[0]
    now = state.select("patient_id", F.col("patient_summary_with_boilerplate").alias("final"))
    made = None
    for i in range(0 if last is None else last + 1):
        asked = chunks.where(F.col("chunk_index") == i).join(now, "patient_id", "left")
        asked = asked.select("patient_id", serial_messages(F.col("final"), F.col("first_date"), F.col("last_date"), truncate_chunk(F.col("chunk_text"))).alias("messages"))
        got = generate(asked).select("patient_id", "generated.final", "generated.reasoning", "generated.raw")
        older = got.limit(0) if made is None else made.join(got.select("patient_id"), "patient_id", "left_anti")
        made = save(older.unionByName(save(got)))
        now = state.join(made, "patient_id", "left_anti").select("patient_id", F.col("patient_summary_with_boilerplate").alias("final")).unionByName(made.select("patient_id", "final"))
    return made if made is not None else state.limit(0).select("patient_id", *(F.lit(None).cast("string").alias(c) for c in ("final", "reasoning", "raw")))


def fold_groups(chunks: DataFrame, state: DataFrame, step: Callable[[Column, Column], Column]) -> DataFrame:
    """patient_id, final: the same fold for a model that is an expression of (prior, chunk struct), in one job."""
    each = F.struct("chunk_index", "first_date", "last_date", "chunk_text")
    grouped = chunks.groupBy("patient_id").agg(F.array_sort(F.collect_list(each)).alias("c"))
    prior = state.select("patient_id", "patient_summary_with_boilerplate")
    grouped = grouped.join(prior, "patient_id", "left")
    start = F.coalesce("patient_summary_with_boilerplate", F.lit(""))
    return grouped.select("patient_id", F.aggregate("c", start, step).alias("final"))


def split_summary(df: DataFrame, marker: str) -> DataFrame:
    """cleaned_patient_summary, cancer_history_summary and general_exclusion_criteria_evidence from original_patient_summary."""
    df = df.withColumn("cleaned_patient_summary", tx.strip(F.coalesce("original_patient_summary", F.lit(""))))
    df = df.withColumn("_s", tx.section_split(F.col("cleaned_patient_summary"), [marker, *MARKERS]))
    return df.withColumn("cancer_history_summary", F.col("_s.main")).withColumn("general_exclusion_criteria_evidence", F.col("_s.rest")).drop("_s")


def informative(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows that only the second test drops with those it keeps): summaries that say something."""
    said = df.where(F.col("cancer_history_summary").isNotNull() & ~F.col("cancer_history_summary").rlike(UNINFORMATIVE))
    return said.where(~F.col("cancer_history_summary").startswith(UNINFORMATIVE_START)), said


def postprocess(df: DataFrame, config: Config, drop: bool = True) -> DataFrame:
    out = split_summary(df, config.patient["boilerplate_marker"])
    if drop:
        out = informative(out)[0]
    if not config.debug_mode:
        out = out.drop("original_patient_summary", "cleaned_patient_summary")
    return out.drop("finish_reason")


def default_generator() -> models.Generator:
    """The segment without its headers."""
    segment = lambda c: F.regexp_extract(c, r"(?s)NEXT SEGMENT \([^)]*\):\n(.*)\n---\nGive", 1)
    return models.expression_generator(lambda c: tx.collapse(F.regexp_replace(segment(c), _HEADER_DATE, "")))


def summarize_patients(notes: DataFrame, *, config: Config | None = None, existing_summaries: DataFrame | None = None, generate: models.Generator | None = None, as_of: Column | None = None, save: Callable[[DataFrame], DataFrame] | None = None, return_metadata: bool = False, return_qc: bool = False):
    """One summary per patient; patients without newer notes keep the prior one."""
    config = load_preset() if config is None else config
    if not isinstance(config, Config):
        raise TypeError("config must be a Config")
    if save is None:
        save = checkpointed
    notes = validate_notes(notes)
    spark, settings = notes.sparkSession, config.patient
    if existing_summaries is None:
        state = spark.createDataFrame([], "patient_id string, last_note_date string, _last_note_date date, patient_summary_with_boilerplate string")
    else:
        state = validate_existing(existing_summaries, settings["boilerplate_marker"]).persist()
        notes = newer_notes(notes, state, as_of)
    ids, chunks = prepare_notes(notes, settings["chunk_size"], settings["chunk_overlap"])
    made = fold_rounds(save(chunks), state, generate or default_generator(), save)
    fresh = ids.join(made.where("final is not null"), "patient_id").withColumn("original_patient_summary", F.col("final"))
    fresh = fresh.withColumn("final_round_patient_summary_raw_output", F.col("raw")).withColumn("final_round_patient_summary_reasoning", F.col("reasoning"))
    fresh = fresh.drop("final", "raw", "reasoning")
    if not config.debug_mode:
        fresh = fresh.drop("final_round_patient_summary_raw_output", "final_round_patient_summary_reasoning")
    passed = state.join(made, "patient_id", "left_anti").select("patient_id", "last_note_date", F.col("patient_summary_with_boilerplate").alias("original_patient_summary"))
    rows = postprocess(fresh, config).unionByName(postprocess(passed, config, drop=False), allowMissingColumns=True)
    out: list = [rows]
    if return_metadata:
        out.append({"config_snapshot": config.snapshot(), "model_metadata": {} if made.isEmpty() else {"name": settings.get("model_name")}})
    if return_qc:
        from matchloom.operators import qc

        kept, said = informative(split_summary(fresh, settings["boilerplate_marker"]))
        gone = said.join(kept.select("patient_id"), "patient_id", "left_anti")
        dropped = qc.artifact(gone, "patients_dropped_noninformative_summary", "patient_id", said.agg(F.count_distinct("patient_id").alias("denominator")))
        out.append(qc.patient_report(rows, dropped))
    return out[0] if len(out) == 1 else tuple(out)
