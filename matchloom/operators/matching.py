"""Embedding, exact cosine top-k candidates, match quality and exclusion checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.config import Config, load_preset
from matchloom.functions import parse, text as tx, vector
from matchloom.functions.schema import require_columns, require_unique
from matchloom.operators import models

ENTITIES = {"patient": ("patient_id", "cancer_history_summary"), "trial": ("space_trial_id", "clinical_space_summary")}
#: Rows of a block of queries or candidates; the most bytes of candidate vectors that strategy "expression" broadcasts.
BLOCK = 4096
BROADCAST_BYTES = 16 << 20
#: The most bytes of corpus vectors that each task holds where all pairs are asked for; rows of a batch of pairs.
CORPUS_BYTES = 128 << 20
PAIR_ROWS = 1 << 16
QUALITY_TEMPLATE = "Profile: {space}\nSubject: {patient}"
EXCLUSION_TEMPLATE = "Subject: {evidence}\nExclusions: {criteria}"
LLM_QUALITY_TEMPLATE = "Profile:\n{trial_summary}\nSubject:\n{patient_summary}\nEnd with the line: Final score: 0 to 5"
LLM_EXCLUSION_TEMPLATE = "Subject:\n{patient_boilerplate}\nExclusions:\n{trial_boilerplate}\nIs the subject excluded? End with Yes! or No!"


def embed_for_matching(df: DataFrame, *, entity_type: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Id and embedding only; a null text is embedded as an empty one."""
    if entity_type not in ENTITIES:
        raise ValueError("entity_type must be 'patient' or 'trial'")
    key, text = ENTITIES[entity_type]
    require_columns(df, [key, text], f"{entity_type} summaries")
    return df.select(key, (embed or models.hashed_embedder())(F.coalesce(text, F.lit(""))).alias("embedding"))


def embedding_tokens(text: Column, prompt: str = "", tokens=tx.word_tokens, special: int = 0) -> Column:
    """Tokens of the text after the prompt, stripped, with ``special`` tokens added and nothing cut."""
    return F.size(tokens(tx.strip(F.concat(F.lit(prompt + " "), F.coalesce(text, F.lit("")))))) + special


def id_column(df: DataFrame, what: str) -> str:
    found = [c for c in ("patient_id", "space_trial_id") if c in df.columns]
    if len(found) != 1:
        raise ValueError(f"{what} needs exactly one of patient_id and space_trial_id")
    return found[0]


def candidates(query: DataFrame, corpus: DataFrame, *, k: int | None = 20, strategy: str = "block", validate: bool = True) -> DataFrame:
    """The k rows of ``corpus`` of highest cosine for each row of ``query``: both ids as strings, similarity_score, rank.

    All for k None. Ties go to the smaller corpus id. "block" multiplies blocks of normalised vectors and keeps k rows a block
    and query, so no pair is shuffled beyond those; "expression" stays in the JVM and broadcasts the corpus, which it checks
    to be small. Where all pairs are asked for, "block" gives whole queries to tasks that hold the corpus, rank there and
    emit batch by batch, so no pair is shuffled at all; a corpus above CORPUS_BYTES is ranked by a shuffle of the pairs.
    Same ids on both sides, repeated ids, null vectors and vectors of several lengths raise.
    """
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    q, c = id_column(query, "query"), id_column(corpus, "corpus")
    if q == c:
        raise ValueError("query and corpus must have different id columns")
    left = query.select(F.col(q).cast("string").alias(q), vector.as_doubles(F.col("embedding")).alias("qv"))
    right = corpus.select(F.col(c).cast("string").alias(c), vector.as_doubles(F.col("embedding")).alias("cv"))
    stats = []
    for df, key, v, what in ((left, q, "qv", "query"), (right, c, "cv", "corpus")):
        if validate:
            require_unique(df, key, what)
        bad = F.count_if(F.col(v).isNull() | F.exists(v, lambda x: x.isNull()))
        stats.append(df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), bad.alias("bad")).first())
    if any(s["bad"] for s in stats):
        raise ValueError("embeddings must be arrays without nulls")
    if len({s[x] for s in stats if s["n"] for x in ("lo", "hi")}) > 1:
        raise ValueError("embeddings must have one dimension")
    order = Window.partitionBy(q).orderBy(F.desc("similarity_score"), c)
    if strategy == "expression":
        if stats[1]["n"] * (stats[1]["hi"] or 0) * 8 > BROADCAST_BYTES:
            raise ValueError("the corpus is too large for strategy 'expression'; use 'block'")
        a, b = left.withColumn("qv", vector.unit(F.col("qv"))), right.withColumn("cv", vector.unit(F.col("cv")))
        pairs = a.crossJoin(F.broadcast(b)).select(q, c, vector.dot(F.col("qv"), F.col("cv")).alias("similarity_score"))
    elif k is None and stats[1]["n"] * (stats[1]["hi"] or 0) * 8 <= CORPUS_BYTES:
        return _rows(left, right, q, c, stats[0]["n"], all("array<float>" in dict(df.dtypes)["embedding"] for df in (query, corpus)))
    else:
        pairs = _blocks(left, right, q, c, k, stats[0]["n"], stats[1]["n"])
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select(q, c, "similarity_score", "rank")


def _blocks(left: DataFrame, right: DataFrame, q: str, c: str, k: int | None, n: int, m: int) -> DataFrame:
    rows, columns = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    deal = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = left.select(q, "qv", deal(q, rows).alias("qb"), each(columns).alias("qc")).groupBy("qb", "qc")
    b = right.select(c, "cv", deal(c, columns).alias("cc"), each(rows).alias("cb")).groupBy("cb", "cc")

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        flat = t.column(name).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return flat / np.maximum(np.sqrt((flat * flat).sum(axis=1, keepdims=True)), 1e-12)

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        schema = pa.schema([(q, pa.string()), (c, pa.string()), ("similarity_score", pa.float64())])
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        y = y.sort_by(c)
        qi, ci = x.column(q).to_numpy(zero_copy_only=False), y.column(c).to_numpy(zero_copy_only=False)
        u, v = matrix(x, "qv"), matrix(y, "cv").T
        take, out = len(ci) if k is None else min(k, len(ci)), []
        for at in range(0, len(qi), 256):
            s = u[at : at + 256] @ v
            if take < len(ci):
                least = np.partition(s, len(ci) - take, axis=1)[:, len(ci) - take]
                hit = s >= least[:, None] - 1e-12
            else:
                hit = np.ones(s.shape, bool)
            i, j = np.nonzero(hit)
            out.append(pa.table([pa.array(qi[at + i]), pa.array(ci[j]), pa.array(s[i, j])], schema=schema))
        return pa.concat_tables(out)

    return a.cogroup(b).applyInArrow(cell, f"{q} string, {c} string, similarity_score double")


def _rows(left: DataFrame, right: DataFrame, q: str, c: str, n: int, floats: bool) -> DataFrame:
    """All pairs with their rank. Each task gets its share of the queries and a copy of the corpus, as floats if it came so."""
    parts = max(1, min(n, 2 * left.sparkSession.sparkContext.defaultParallelism))
    ship = lambda v: F.transform(v, lambda x: x.cast("float")) if floats else F.col(v)
    asked = left.select(F.pmod(F.xxhash64(q), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asked"), F.col(q).alias("id"), ship("qv").alias("v"))
    held = right.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asked"), F.col(c).alias("id"), ship("cv").alias("v"))
    schema = pa.schema([(q, pa.string()), (c, pa.string()), ("similarity_score", pa.float64()), ("rank", pa.int32())])

    def units(flat: np.ndarray) -> np.ndarray:
        flat = flat.astype(np.float64)
        return flat / np.maximum(np.sqrt((flat * flat).sum(axis=1, keepdims=True)), 1e-12)

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        flat = t.column("v").combine_chunks().flatten().to_numpy()
        flat, asks = flat.reshape(t.num_rows, len(flat) // t.num_rows), t.column("asked").to_numpy()
        names = t.column("id").combine_chunks()
        own, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
        rest = rest[pc.sort_indices(names.take(pa.array(rest)), null_placement="at_start").to_numpy()]
        if not len(own) or not len(rest):
            return
        qi, ci, u = names.take(pa.array(own)), names.take(pa.array(rest)), units(flat[own])
        # Copies of a vector are multiplied once, so that they tie exactly and go by their ids.
        rows = np.ascontiguousarray(flat[rest])
        kind = np.unique(rows.view(np.dtype((np.void, max(1, rows.itemsize * rows.shape[1])))).ravel(), return_index=True, return_inverse=True)[1:] if rows.shape[1] else (np.zeros(1, int), np.zeros(len(rows), int))
        v, of = units(rows[kind[0]]).T, kind[1].ravel()
        members, counts = np.argsort(of, kind="stable"), np.bincount(of)
        starts, rank = np.cumsum(counts) - counts, np.arange(1, len(of) + 1, dtype=np.int32)
        del batches, t, flat, rows
        step, out, waits = max(1, (2 << 20) // len(counts)), [], 0

        def batch() -> pa.RecordBatch:
            i, j, s, r = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([qi.take(pa.array(i)), ci.take(pa.array(j)), pa.array(s), pa.array(r)], schema=schema)

        for at in range(0, len(u), step):
            for i, s in enumerate(u[at : at + step] @ v, at):
                key = np.where(np.isnan(s), -np.inf, -s)  # Spark takes NaN as the largest
                order = np.argsort(key)
                if (key[order[1:]] == key[order[:-1]]).any():
                    j = np.argsort(key[of], kind="stable")
                elif len(counts) == len(of):
                    j = members[order]
                else:
                    n = counts[order]
                    j = members[np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(len(of))]
                s = s[of[j]]
                for a in range(0, len(j), PAIR_ROWS):
                    part = slice(a, a + PAIR_ROWS)
                    out.append((np.full(len(j[part]), i), j[part], s[part], rank[part]))
                    waits += len(j[part])
                    if waits >= PAIR_ROWS:
                        yield batch()
                        out, waits = [], 0
        if out:
            yield batch()

    return asked.unionByName(held).repartitionById(parts, "part").mapInArrow(run, f"{q} string, {c} string, similarity_score double, rank int")


def score_match_quality(pairs: DataFrame, *, score: Callable[[Column], Column] | None = None, raw: str | None = None, cutoff: float | None = None, filter_low_quality: bool = True, template: str = QUALITY_TEMPLATE, config: Config | None = None) -> DataFrame:
    """patient_id, space_trial_id, match_quality_score, match_quality_pass.

    The raw score comes from ``score`` (of the filled template) or from a column ``raw``; its float32 sigmoid is compared
    with the cutoff.
    """
    config = config or load_preset()
    cutoff = config.section("match_quality").get("score_cutoff", 0.2) if cutoff is None else cutoff
    require_columns(pairs, ["patient_id", "space_trial_id"] + ([] if raw else ["cancer_history_summary", "clinical_space_summary"]), "pairs")
    if raw is None:
        prompt = tx.fill(template, {"space": F.col("clinical_space_summary"), "patient": F.col("cancer_history_summary")})
        value = (score or (lambda c: models.keyword_classifier(["none"])(c)["score"]))(prompt)
    else:
        value = F.col(raw)
    out = pairs.select("patient_id", "space_trial_id", (1 / (1 + F.exp(-value.cast("float").cast("double")))).cast("float").cast("double").alias("match_quality_score"))
    out = out.withColumn("match_quality_pass", F.col("match_quality_score") >= F.lit(cutoff))
    return out.where("match_quality_pass") if filter_low_quality else out


def check_exclusions(matches: DataFrame, *, classify: Callable[[Column], Column] | None = None, predicted: tuple[str, str] | None = None, filter_excluded: bool = False, template: str = EXCLUSION_TEMPLATE) -> DataFrame:
    """patient_id, trial_id, exclusion_score (of the predicted label, as it is), exclusion_criteria_pass (label NEGATIVE)."""
    require_columns(matches, ["patient_id", "trial_id"] + ([] if predicted else ["general_exclusion_criteria", "general_exclusion_criteria_evidence"]), "matches")
    if predicted:
        label, score = F.col(predicted[0]), F.col(predicted[1])
    else:
        prompt = tx.fill(template, {"evidence": F.col("general_exclusion_criteria_evidence"), "criteria": F.col("general_exclusion_criteria")})
        made = (classify or models.keyword_classifier(["excluded"]))(prompt)
        label, score = made["label"], made["score"]
    out = matches.select("patient_id", "trial_id", score.cast("double").alias("exclusion_score"), (F.upper(tx.strip(label)) == "NEGATIVE").alias("exclusion_criteria_pass"))
    return out.where("exclusion_criteria_pass") if filter_excluded else out


def _ask(df: DataFrame, template: str, slots: dict[str, str], generate: models.Generator) -> DataFrame:
    shown = {name: F.coalesce(F.col(c).cast("string"), F.lit("None")) for name, c in slots.items()}
    return generate(df.withColumn("messages", models.messages(tx.fill(template, shown), "Reasoning: high"))).drop("messages")


def llm_match_quality(pairs: DataFrame, *, generate: models.Generator, template: str = LLM_QUALITY_TEMPLATE) -> DataFrame:
    """patient_id, space_trial_id, llm_match_quality_{score,verdict,response,reasoning}; nothing is filtered."""
    require_columns(pairs, ["patient_id", "space_trial_id", "cancer_history_summary", "clinical_space_summary"], "pairs")
    made = _ask(pairs, template, {"trial_summary": "clinical_space_summary", "patient_summary": "cancer_history_summary"}, generate)
    score, verdict = parse.score_answer(F.col("generated.final"))
    name = "llm_match_quality_"
    return made.select("patient_id", "space_trial_id", score.alias(name + "score"), verdict.alias(name + "verdict"), F.col("generated.final").alias(name + "response"), F.col("generated.reasoning").alias(name + "reasoning"))


def llm_exclusions(matches: DataFrame, *, generate: models.Generator, template: str = LLM_EXCLUSION_TEMPLATE) -> DataFrame:
    """patient_id, trial_id, llm_exclusion_criteria_{pass,verdict,response,reasoning}; pass is null where no answer is found."""
    require_columns(matches, ["patient_id", "trial_id", "general_exclusion_criteria", "general_exclusion_criteria_evidence"], "matches")
    made = _ask(matches, template, {"patient_boilerplate": "general_exclusion_criteria_evidence", "trial_boilerplate": "general_exclusion_criteria"}, generate)
    passed, verdict = parse.exclusion_answer(F.col("generated.final"))
    name = "llm_exclusion_criteria_"
    return made.select("patient_id", "trial_id", passed.alias(name + "pass"), verdict.alias(name + "verdict"), F.col("generated.final").alias(name + "response"), F.col("generated.reasoning").alias(name + "reasoning"))
