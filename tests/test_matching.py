import asyncio
import math

import pytest
from pyspark.sql import functions as F

from matchloom.config import load_preset
from matchloom.functions import parse, text as tx
from matchloom.operators import assemble, evaluate, matching, models, patients, qc, trials


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("s", ["  a b ", "\t\n\x1c\xa0 x \x85", "", "no", "　"])
def test_strip(spark, s):
    assert one(spark, s, tx.strip) == s.strip()


def test_lines_and_collapse(spark):
    s = "a\rb\x0bc\x1cd\x85e f\r\ng"
    assert one(spark, s, tx.lines) == s.splitlines()
    assert one(spark, " a \n\n b\xa0c ", tx.collapse) == "a b c"


@pytest.mark.parametrize("s, main, rest", [("a\nMARK: x\nb", "a", "b"), (" a ", "a", "a"), ("", "", "None"), ("MARK", "", "None"), ("a\nMARK\nb\nMARK\nc", "a", "b\nMARK\nc")])
def test_section_split(spark, s, main, rest):
    got = one(spark, s, lambda c: tx.section_split(c, ["MARK"]))
    assert (got["main"], got["rest"]) == (main, rest)


def test_numbered_items(spark):
    assert one(spark, "1. a\n2) b\n12. c\nx\n0. d\n100. e\n9 f\n3.", tx.numbered_items) == ["a", "2) b", "c", "100. e", "9 f"]


@pytest.mark.parametrize("s, score", [("Final score: 4", 4), ("**Final Score: 9**", 5), ("SCORE - 2", 2), ("not a reasonable match", 0), ("?", -1), (None, -1), ("Final score: 3", 3)])
def test_score_answer(spark, s, score):
    assert one(spark, s, lambda c: parse.score_answer(c)[0]) == score


@pytest.mark.parametrize("s, passed, verdict", [("Yes!", False, "YES"), ("so No!", True, "NO"), ("yes", False, "YES_FALLBACK"), ("UNKNOWN", True, "NO_FALLBACK"), ("?", None, "PARSE_FAILED")])
def test_exclusion_answer(spark, s, passed, verdict):
    assert one(spark, s, lambda c: parse.exclusion_answer(c)[0]) is passed
    assert one(spark, s, lambda c: parse.exclusion_answer(c)[1]) == verdict


def test_candidates(spark):
    q = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0]), ("p0", [0.0, 0.0])], "patient_id string, embedding array<double>")
    c = spark.createDataFrame([("a-1", [1.0, 0.0]), ("b-1", [0.5, 0.5]), ("c-1", [0.0, 1.0])], "space_trial_id string, embedding array<double>")
    for strategy in ("block", "expression"):
        got = {(r.patient_id, r.rank): (r.space_trial_id, round(r.similarity_score, 6)) for r in matching.candidates(q, c, k=2, strategy=strategy).collect()}
        assert got[("p1", 1)] == ("a-1", 1.0) and got[("p2", 1)] == ("c-1", 1.0) and got[("p1", 2)] == ("b-1", round(math.sqrt(0.5), 6))
        assert got[("p0", 1)] == ("a-1", 0.0) and len(got) == 6
    assert matching.candidates(q, c, k=None).count() == 9
    assert matching.candidates(q.limit(0), c).count() == 0
    for bad in (lambda: matching.candidates(q, c, k=0), lambda: matching.candidates(q, q), lambda: matching.candidates(q.union(q), c), lambda: matching.candidates(q.withColumn("embedding", F.array(F.lit(1.0))), c)):
        with pytest.raises(ValueError):
            bad()


def test_quality_and_exclusion(spark):
    pairs = spark.createDataFrame([("p", "a-1", 2.0), ("p", "b-1", -2.0)], "patient_id string, space_trial_id string, raw double")
    got = matching.score_match_quality(pairs, raw="raw", filter_low_quality=False).orderBy("space_trial_id").collect()
    assert [round(r.match_quality_score, 6) for r in got] == [0.880797, 0.119203] and [r.match_quality_pass for r in got] == [True, False]
    assert matching.score_match_quality(pairs, raw="raw").count() == 1
    rows = spark.createDataFrame([("p", "a", " negative ", 0.81), ("p", "b", "POSITIVE", 0.66)], "patient_id string, trial_id string, l string, s double")
    assert [r.exclusion_criteria_pass for r in matching.check_exclusions(rows, predicted=("l", "s")).orderBy("trial_id").collect()] == [True, False]


def test_llm_checks(spark):
    pairs = spark.createDataFrame([("p", "a-1", "subject {x}", None)], "patient_id string, space_trial_id string, cancer_history_summary string, clinical_space_summary string")
    echo = models.batch_generator(lambda: lambda prompts: [{"final": p[-1]["content"] + "." * 60 + "\nFinal score: 4", "reasoning": "r", "raw": "", "finish_reason": "stop"} for p in prompts])
    r = matching.llm_match_quality(pairs, generate=echo).first()
    assert r.llm_match_quality_score == 4 and "subject {x}" in r.llm_match_quality_response and "Profile:\nNone" in r.llm_match_quality_response


def test_incremental_and_state(spark):
    state = spark.createDataFrame([("a", "2024-01-01", "s"), ("a", "2024-01-05", "t"), ("b", "2024-02-01", None)], "patient_id string, last_note_date string, patient_summary string").coalesce(1)
    state = patients.validate_existing(state)
    assert {r.patient_id: r.patient_summary_with_boilerplate for r in state.collect()} == {"a": "t", "b": None}
    notes = patients.validate_notes(spark.createDataFrame([("a", "x", "2024-01-05"), ("a", "x", "2024-01-06"), ("b", "x", "2024-01-22"), ("b", "x", "2024-01-23"), ("c", "x", "2020-01-01"), ("c", None, "2020-01-02")], "patient_id string, note_text string, note_date string"))
    got = patients.newer_notes(notes, state, F.lit("2024-02-03").cast("date"))
    assert sorted((r.patient_id, str(r.note_date)[:10]) for r in got.collect()) == [("a", "2024-01-06"), ("b", "2024-01-23"), ("c", "2020-01-01")]
    with pytest.raises(ValueError, match="z"):
        patients.validate_existing(spark.createDataFrame([("z", "bad", "s")], "patient_id string, last_note_date string, patient_summary string"))
    with pytest.raises(ValueError):
        patients.validate_existing(state.select("patient_id", "last_note_date"))


def test_dedup_and_chunks(spark):
    rows = [("a", "One. Two!\nThree.", "2024-01-01"), ("a", "Two! Four", "2024-01-02"), ("a", "One.", "2024-01-03")]
    notes = patients.validate_notes(spark.createDataFrame(rows, "patient_id string, note_text string, note_date string").coalesce(1))
    left = patients.dedup_notes(notes)
    assert [r.note_text for r in left.orderBy("note_date").collect()] == ["One. Two! Three.", "Four"]
    ids, chunks = patients.prepare_notes(notes, 6, 1)
    assert ids.first().last_note_date == "2024-01-02"
    got = chunks.orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == ["=== Note dated 2024-01-01 === One.", "One. Two! Three. === Note dated", "dated 2024-01-02 === Four"]
    assert [(r.first_date, r.last_date) for r in got] == [("2024-01-01", "2024-01-01")] * 3
    with pytest.raises(ValueError):
        patients.chunk_notes(left, 5, 5)


def test_rounds_equal_groups_and_pass_through(spark):
    rows = [("a", "one two three. four five", "2024-01-01"), ("a", "six seven", "2024-01-02"), ("b", "x", "2024-01-01")]
    notes = patients.validate_notes(spark.createDataFrame(rows, "patient_id string, note_text string, note_date string").coalesce(1))
    chunks = patients.prepare_notes(notes, 7, 2)[1]
    empty = spark.createDataFrame([], "patient_id string, patient_summary_with_boilerplate string")
    prior = lambda c: F.regexp_extract(c, r"(?s)PRIOR SUMMARY:\n(.*)\n\nNEXT", 1)
    body = lambda c: F.regexp_extract(c, r"(?s)NEXT SEGMENT \([^)]*\):\n(.*)\n---\nGive", 1)
    add = models.expression_generator(lambda c: F.concat(F.when(prior(c) == patients.NO_PRIOR, "").otherwise(prior(c)), F.lit("|"), F.length(body(c)).cast("string")))
    a = {r.patient_id: r["final"] for r in patients.fold_rounds(chunks, empty, add, lambda d: d.persist()).collect()}
    b = {r.patient_id: r["final"] for r in patients.fold_groups(chunks, empty, lambda p, c: F.concat(p, F.lit("|"), F.length(c["chunk_text"]).cast("string"))).collect()}
    assert a == b and a["a"].count("|") > 1
    old = spark.createDataFrame([("z", "2024-01-01", "No information")], "patient_id string, last_note_date string, patient_summary string")
    got = patients.summarize_patients(spark.createDataFrame(rows, "patient_id string, note_text string, note_date string"), existing_summaries=old, as_of=F.lit("2024-03-01").cast("date"))
    assert {r.patient_id: r.cancer_history_summary for r in got.collect()}["z"] == "No information" and got.count() == 3


def test_summary_cleaning(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "no CANCER found"), (3, "No information x"), (4, "No evidence of malignancy")], "patient_id long, original_patient_summary string")
    assert [r.patient_id for r in patients.informative(patients.split_summary(df, "M"))[0].collect()] == [1]


def test_trials_with_qc(spark):
    rows = [("t-1", "Title", "Brief\nsummary", " x  y "), ("t2", None, None, None)]
    df = spark.createDataFrame(rows, "trial_id string, trial_title string, brief_summary string, eligibility_criteria string")
    spaces, meta, report = trials.summarize_trials(df, return_metadata=True, return_qc=True)
    got = {r.trial_id: r for r in spaces.collect()}
    assert got["t-1"].space_trial_id == "t-1-1" and "Title Brief summary x y" in got["t-1"].clinical_space_summary and meta["config_snapshot"]["trial"]
    q = {r.metric: r for r in report.collect()}
    assert q["trials_missing_in_output"].value == 0 and q["trials_exclusion_criteria_not_extracted"].value == 2 and len(q) == 17
    with pytest.raises(ValueError, match="trial_title"):
        trials.summarize_trials(df.drop("trial_title"))


def test_middle_cut_and_tokens(spark):
    assert one(spark, "0123456789", lambda c: tx.middle_cut(c, tx.char_tokens, "", 6)) == "012 ... 789"
    assert one(spark, "0123456789", lambda c: tx.middle_cut(c, tx.char_tokens, "", 5, long_tail=True)) == "01 ... 789"
    assert one(spark, "x", lambda c: patients.generation_tokens(F.lit(600), 1000, 900)) == 144


def test_consistency(spark):
    a = spark.createDataFrame([("p", "x", 1, 0.9), ("p", "y", 2, 0.8), ("q", "x", 1, 0.5)], "patient_id string, trial_id string, rank int, similarity_score double")
    b = spark.createDataFrame([("p", "y", 1, 0.9), ("p", "z", 2, 0.8)], "patient_id string, trial_id string, rank int, similarity_score double")
    got = {r.patient_id: r for r in evaluate.match_consistency(a, b).collect()}
    assert got["p"].full_set_jaccard == pytest.approx(1 / 3) and got["p"].top5_overlap_fraction == 0.5 and got["p"].top1_agreement == 0
    assert got["q"].top1_agreement is None and got["q"].n_trials_b == 0
    assert evaluate.consistency_by_score(evaluate.match_consistency(a, a)).count() == 2


def test_remote_order_limit_and_retry():
    flying, most, failed = 0, 0, set()

    async def send(url, prompt):
        nonlocal flying, most
        flying += 1
        most = max(most, flying)
        await asyncio.sleep(0.01)
        flying -= 1
        if prompt == 2 and 2 not in failed:
            failed.add(2)
            raise OSError
        return (url, prompt)

    got = asyncio.run(models.request_all(send, ["u", "v"], list(range(5)), {"max_concurrent_requests": 1, "retry_backoff_base": 0.0}))
    assert got == [("u", 0), ("v", 1), ("u", 2), ("v", 3), ("u", 4)] and most <= 2
    assert models.normalize_url("host:1/") == "http://host:1/v1" and models.normalize_url("http://h/x/") == "http://h/x"
    assert models.server_urls({"server_urls": "a, b"}) == ["http://a/v1", "http://b/v1"]
    assert models.resolve_parser("none", "m") is None and models.resolve_parser("auto", "Abc-1", {"abc": "think"}) == "think"


def test_config():
    c = load_preset()
    c.trial["x"] = 1
    assert c.snapshot()["trial"]["x"] == 1 and c.runtime("patient")["max_model_len"] == 100000


def test_stream(spark, tmp_path):
    from matchloom.streaming.fold import stream_summaries

    schema = "patient_id string, note_date date, note_text string"
    spark.createDataFrame([("a", "x"), ("a", "y")], "patient_id string, note_text string").select("patient_id", F.lit("2024-01-01").cast("date").alias("note_date"), "note_text").coalesce(1).write.parquet(str(tmp_path / "in"))
    notes = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream_summaries(notes, lambda s, d, t: s + "+".join(t)).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from folded").collect()] == [("a", "2024-01-01", "x+y")]


def test_best_match_both_ways_in_blocks(spark, monkeypatch):
    """Blocks give what all pairs give; odd vectors count without a best cosine; no pair becomes a row."""
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    rows = [(k % 3, k, [float((k * j) % 11 - 5) for j in range(1, 5)]) for k in range(60)]
    rows += [(0, 100, None), (0, 101, [1.0, None, 2.0, 3.0]), (1, 102, [1.0]), (None, 103, [1.0, 2.0, 3.0, 4.0]), (0, 0, [9.0, 1.0, 0.0, 2.0])]
    other = [(k, f"g{i}", None if v is None else v[::-1]) for k, i, v in rows if i not in (1, 4)] + [(9, "alone", [1.0])]
    schema = "trial_id int, id {}, embedding array<double>"
    out = evaluate.best_match_both_ways(spark.createDataFrame(rows, schema.format("int")), spark.createDataFrame(other, schema.format("string")))
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()

    def best(own, others):
        found = {}
        for k, i, v in own:
            s = [sum(x * y for x, y in zip(v, w)) / math.hypot(*v) / math.hypot(*w) for kk, _, w in others if kk == k and v and w and None not in v and None not in w and len(v) == len(w)]
            found.setdefault(k, {}).setdefault(i, []).extend(s)
        return {k: (len(x), sum(h := [max(s) for s in x.values() if s]) / len(h)) for k, x in found.items() if k in (0, 1, 2)}

    there, back, got = best(rows, other), best(other, rows), {r.trial_id: r for r in out.collect()}
    assert set(got) == {0, 1, 2}
    for k, r in got.items():
        assert (r.n_pkg_spaces, r.n_gold_spaces) == (there[k][0], back[k][0])
        assert r.pkg_to_gold == pytest.approx(there[k][1]) and r.gold_to_pkg == pytest.approx(back[k][1])
        assert r.trial_score == pytest.approx((there[k][1] + back[k][1]) / 2)
    same = spark.createDataFrame(rows[:60], schema.format("int"))
    assert [round(r.trial_score, 9) for r in evaluate.best_match_both_ways(same, same.withColumn("embedding", F.col("embedding"))).collect()] == [1.0] * 3


def test_all_candidates_without_shuffled_pairs(spark, monkeypatch):
    """All pairs leave their task ranked; copies of a vector tie and go by id; a large corpus gives the same by a shuffle."""
    queries = [(f"p{k}", [float(k % 5 - 2), 1.0, float(k % 3), 0.3]) for k in range(23)] + [("zero", [0.0] * 4), ("odd", [float("nan"), 1.0, 1.0, 1.0])]
    corpus = [(f"t{k}", [float(k % 7 - 3), float(k % 4), 0.7, float(k % 2)]) for k in range(150)]
    for kind in ("float", "double"):
        a = spark.createDataFrame(queries, f"patient_id string, embedding array<{kind}>")
        b = spark.createDataFrame(corpus, f"space_trial_id string, embedding array<{kind}>")
        monkeypatch.setattr(matching, "PAIR_ROWS", 64)
        out = matching.candidates(a, b, k=None)
        assert "Window" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r.patient_id, []).append((r["rank"], r.space_trial_id, r.similarity_score))
        assert len(got) == len(queries) and [x[1] for x in sorted(got["zero"])] == [x[1] for x in sorted(got["odd"])] == sorted(c for c, _ in corpus)
        for p, v in queries[:23]:
            score = {c: sum(x * y for x, y in zip(v, w)) / math.hypot(*v) / math.hypot(*w) for c, w in corpus}
            own = sorted(got[p])
            assert [x[0] for x in own] == list(range(1, 151)) and {x[1] for x in own} == set(score)
            assert all(s == pytest.approx(score[c], abs=1e-6) for _, c, s in own)
            assert all(x[2] > y[2] or (x[2] == y[2] and x[1] < y[1]) for x, y in zip(own, own[1:]))
        monkeypatch.setattr(matching, "CORPUS_BYTES", 0)
        other = matching.candidates(a, b, k=None)
        assert "Window" in other._jdf.queryExecution().toString() and other.count() == 25 * 150
        monkeypatch.undo()


def test_rounded_as_round(spark):
    from matchloom.plans import queries as plans

    values = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 1.5e-6, 0.1234565, -0.1234565, 0.12345649999, 1.0, -1.0, float("nan"), 0.3, None]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(plans._rounded("x").alias("a"), F.round("x", 6).alias("b"))
    assert [str(r.a) for r in df.collect()] == [str(r.b) for r in df.collect()]


def test_trial_report_with_joined_ids(spark):
    """Ids as one text equal the arrays, whatever the number of runs; no aggregate gathers a metric's single ids."""
    kept = " ".join(f"{k}:" for k in trials.SPACE_KEYWORDS)
    rows = [(f"T{k % 400}", k // 400 + 1, "" if k == 7 else f"{kept} {k if k % 400 > 9 else 0}" if k % 3 else f"Age {k}", "None" if k % 5 == 0 else "rules") for k in range(1000)]
    rows += [("T3", 1, kept, None), (None, 1, kept, "x")]
    spaces = spark.createDataFrame(rows, "trial_id string, clinical_space_number int, clinical_space_summary string, general_exclusion_criteria string")
    source = spark.createDataFrame([(f"T{k}",) for k in range(420)], "trial_id string")
    cut, n = source.where("trial_id < 'T2'"), source.agg(F.count(F.lit(1)).alias("denominator"))

    def report(**more):
        return qc.trial_report(spaces, source, spaces, qc.artifact(cut, "trials_truncated", "trial_id", n, **more), token_limit=19, **more)

    arrays, texts = {r.metric: r for r in report().collect()}, {r.metric: r for r in report(joined=",").collect()}
    assert {m: (r.value, r.denominator, r.percent, ",".join(r.ids)) for m, r in arrays.items()} == {m: (r.value, r.denominator, r.percent, r.ids) for m, r in texts.items()}
    want = {
        "trials_missing_in_output": {"T7"} | {f"T{k}" for k in range(400, 420)},
        "trials_exclusion_criteria_not_extracted": {t for t, _, _, r in rows if t and r in ("None", None)},
        "trials_truncated": {f"T{k}" for k in range(420) if f"T{k}" < "T2"},
        "spaces_dropped_missing_keyword:Histology": {f"{t}-{i}" for t, i, x, _ in rows if t and "Histology" not in x},
        "spaces_exceed_embedding_token_limit": {f"{t}-{i}" for t, i, x, _ in rows if t and len(x.split()) + 1 > 19},
        "trials_with_non_distinct_spaces": {t for t, i, x, _ in rows if t and (sum(r[0] == t and r[1] == i for r in rows) > 1 or sum(r[0] == t and r[2] == x for r in rows) > 1)},
    }
    for metric, ids in want.items():
        assert arrays[metric].ids == sorted(ids) and arrays[metric].value == len(ids), metric
    assert arrays["trials_with_non_distinct_spaces"].ids and arrays["spaces_per_trial_max"].value == 4 and arrays["spaces_per_trial_max"].denominator is None
