"""SQL of the registered queries, written from their definitions and not from the plans."""

from __future__ import annotations

from matchloom.operators.qc import PATIENT_KEYWORDS
from matchloom.operators.trials import SPACE_KEYWORDS

_V = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _ranked(k: int | None, cut: str = "e") -> str:
    where = f"where rank <= {k}" if k else ""
    return f"""
        select * from (
            select q.vec_id::varchar patient_id, 'T' || c.label || '-' || c.vec_id space_trial_id, list_cosine_similarity({cut.replace('e', 'q.e', 1)}, {cut.replace('e', 'c.e', 1)}) s,
                   row_number() over (partition by q.vec_id order by list_cosine_similarity({cut.replace('e', 'q.e', 1)}, {cut.replace('e', 'c.e', 1)}) desc, 'T' || c.label || '-' || c.vec_id) rank
            from ({_V}) q, ({_V}) c where q.label = 0 and c.label <> 0) {where}"""


def _topk(k: int | None) -> str:
    return f"select patient_id, space_trial_id, round(s, 6) similarity_score, rank from ({_ranked(k)})"


_CONSISTENCY = f"""
    a as (select patient_id, list(space_trial_id order by rank) t, list(s order by rank) s from ({_ranked(10, 'e[1:64]')}) group by 1),
    b as (select patient_id, list(space_trial_id order by rank) t, list(s order by rank) s from ({_ranked(10, 'e[1:32]')}) group by 1),
    j as (select a.patient_id, a.t ta, b.t tb, a.s sa, b.s sb from a join b using (patient_id)),
    m as (select patient_id, len(ta)::int n_trials_a, len(tb)::int n_trials_b, (ta[1] = tb[1])::int top1_agreement,
                 len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) full_set_jaccard,
                 len(list_intersect(ta[1:5], tb[1:5])) / least(5, len(ta), len(tb)) top5_overlap_fraction,
                 len(list_intersect(ta[1:10], tb[1:10])) / least(10, len(ta), len(tb)) top10_overlap_fraction,
                 list_avg(sa[1:5]) mean_top5_score_a, list_avg(sb[1:5]) mean_top5_score_b from j)"""

_KEYS = " ".join(f"{k}:" for k in SPACE_KEYWORDS if k != "Histology")
_SPACES = f"""
    sp as (select o_orderkey trial_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag = 'R') as integer) clinical_space_number,
                  '{_KEYS}' || case when l_returnflag = 'R' then '' else ' Histology: any' end || ' part ' || l_partkey clinical_space_summary,
                  case when o_orderstatus = 'O' then 'None' else o_orderpriority end rules, l_returnflag = 'R' gone
           from lineitem join orders on l_orderkey = o_orderkey)"""

_NOTES = "n as (select conv_id::varchar patient_id, text, strftime(date '2024-01-01' + turn::int, '%Y-%m-%d') d, turn from conversations where text is not null)"
_CHUNKS = rf"""
    {_NOTES},
    w as (select patient_id, string_agg('=== Note dated ' || d || ' ===' || chr(10) || text || chr(10), chr(10) order by d, turn) t, min(d) d0, max(d) d1 from n group by 1),
    k as (select *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') tok from w),
    c as (select *, len(tok) n, unnest(range(case when len(tok) <= 40 then 1 else cast(ceil((len(tok) - 5) / 35.0) as bigint) end)) i from k),
    x as (select patient_id, cast(i as integer) chunk_index, n, d0, d1, case when n <= 40 then t else array_to_string(tok[i * 35 + 1 : i * 35 + 40], ' ') end chunk_text from c),
    y as (select *, regexp_extract_all(chunk_text, '=== Note dated (\d\d\d\d-\d\d-\d\d) ===', 1) own from x),
    z as (select *, coalesce(last_value(own[-1] ignore nulls) over (partition by patient_id order by chunk_index rows between unbounded preceding and current row), d0) carried from y),
    chunks as (select patient_id, chunk_index, case when n <= 40 then d0 when len(own) > 0 then own[1] else carried end first_date, case when n <= 40 then d1 else carried end last_date, chunk_text from z)"""

_SUMMARIES = f"""
    su as (select doc_id patient_id, lang, source, case source when 'src1' then 'No information on ' when 'src2' then 'There is no CANCER in ' else '' end || text t from documents),
    sp as (select patient_id, {_STRIP.format('t')} main, case when lang = 'en' then source when {_STRIP.format('t')} = '' then 'None' else {_STRIP.format('t')} end rest from su)"""

_LABEL = "select doc_id, source, quality, toxic from labels join documents using (doc_id)"


def _metric(name: str, rows: str, key: str, den: str) -> str:
    return f"""select '{name}' metric, count(distinct {key})::double as value, ({den})::bigint denominator,
        case when ({den}) = 0 then 0.0 else count(distinct {key}) / ({den}) * 100.0 end percent, coalesce(string_agg(distinct {key}::varchar, ',' order by {key}::varchar), '') ids from ({rows})"""


def _report(parts: list[str], before: str) -> str:
    return f"with {before} select metric, round(value, 6) as value, denominator, round(percent, 6) percent, ids from (" + " union all ".join(parts) + ")"


def _trial_qc() -> str:
    kept = "select * from sp where not gone"
    per = f"select trial_id, count(*) n from ({kept}) group by 1"
    stat = lambda name, f: f"select '{name}', coalesce({f}(n), 0)::double, null, null, '' from ({per})"
    n, trials_, all_ = "select count(*) from sp where not gone", f"select count(*) from ({per})", "select count(*) from sp"
    sid = "trial_id || '-' || clinical_space_number sid"
    parts = [
        _metric("trials_missing_in_output", f"select o_orderkey k from orders where o_orderkey not in (select trial_id from ({kept}))", "k", "select count(*) from orders"),
        _metric("trials_truncated", "select o_orderkey k from orders where o_totalprice > 400000", "k", "select count(*) from orders"),
        _metric("spaces_exceed_embedding_token_limit", f"select {sid} from ({kept}) where len(string_split(clinical_space_summary, ' ')) > 18", "sid", n),
        stat("spaces_per_trial_min", "min"), stat("spaces_per_trial_median", "median"), stat("spaces_per_trial_max", "max"),
        _metric("trials_with_non_distinct_spaces", f"select trial_id from ({kept}) group by trial_id, clinical_space_summary having count(*) > 1", "trial_id", trials_),
        *(_metric(f"spaces_dropped_missing_keyword:{k}", f"select {sid} from sp where not contains(clinical_space_summary, '{k}')", "sid", all_) for k in SPACE_KEYWORDS),
        _metric("trials_exclusion_criteria_not_extracted", f"select trial_id from ({kept}) where rules = 'None'", "trial_id", trials_),
    ]
    return _report(parts, _SPACES)


def _patient_qc() -> str:
    said = "select * from sp where not regexp_matches(main, 'no cancer|no primary|no evidence of malignancy', 'i')"
    kept = f"select * from ({said}) where not starts_with(main, 'No information')"
    n = f"select count(distinct patient_id) from ({kept})"
    parts = [
        _metric("patients_dropped_noninformative_summary", f"select patient_id from ({said}) where starts_with(main, 'No information')", "patient_id", f"select count(distinct patient_id) from ({said})"),
        _metric("patients_exceed_embedding_token_limit", rf"select patient_id from ({kept}) where len(list_filter(regexp_split_to_array(main, '\s+'), lambda x: x <> '')) > 300", "patient_id", n),
        _metric("patients_exclusion_criteria_not_extracted", f"select patient_id from ({kept}) where main = rest", "patient_id", n),
        *(_metric(f"patients_missing_keyword:{k}", f"select patient_id from ({kept}) where not contains(main, '{k}')", "patient_id", n) for k in PATIENT_KEYWORDS),
    ]
    return _report(parts, _SUMMARIES)


_PAIRS = """pairs as (select source patient_id, 'T' || doc_id % 40 || '-' || doc_id % 3 space_trial_id from documents),
    sources as (select distinct source patient_id, 'evidence of ' || source said from documents where source <> 'src1'),
    spaces as (select 'T' || page_id || '-1' space_trial_id, 'T' || page_id trial_id, url rule from pages where page_id < 30)"""


def oracle_sql() -> dict[str, str]:
    answers = "list_value('Fine.' || chr(10) || '**Final score: 4**', 'final Score:9', 'overall SCORE - 3', 'this is not a reasonable match', 'no verdict', 'x Final  score : 07 and so on')[(doc_id + quality) % 6 + 1]"
    verdicts = "list_value('So: Yes!', 'In the end No!', 'yes', 'UNKNOWN', '?', 'Yes! But no!')[(doc_id + toxic) % 6 + 1]"
    pairs = f"with v as ({_V}), p as (select a.label trial_id, a.vec_id ia, b.vec_id ib, list_cosine_similarity(a.e, list_reverse(b.e)) s from v a join v b on a.label = b.label)"
    final = f"""
        with t as ({_ranked(20)}), q as (select patient_id, space_trial_id, split_part(space_trial_id, '-', 1) trial_id, (1 / (1 + exp(-((round(s, 6) * 4 - 2)::float)::double)))::float::double f from t),
        k as (select *, round(f, 5) score from q where f >= 0.2),
        b as (select *, row_number() over (partition by patient_id, trial_id order by score desc, space_trial_id) n from k),
        r as (select *, row_number() over (partition by patient_id order by score desc, trial_id) match_rank from b where n = 1)
        select patient_id, trial_id, match_rank, right(patient_id, 1) <> right(trial_id, 1) passes_exclusion_criteria, 'subject ' || patient_id patient_summary, 'None' patient_exclusion_evidence,
               'Trial ' || substr(trial_id, 2) trial_title, split_part(space_trial_id, '-', 2)::bigint clinical_space_number, 'space ' || split_part(space_trial_id, '-', 2) matched_clinical_space_summary,
               'rules' extracted_trial_exclusion_criteria from r"""
    return {
        "candidate_topk": _topk(20),
        "candidate_all": _topk(None),
        "best_match_bidirectional": f"""{pairs}, x as (select trial_id, ia, max(s) m from p group by all), y as (select trial_id, ib, max(s) m from p group by all),
            a as (select trial_id, count(*) n_pkg_spaces, avg(m) g from x group by 1), b as (select trial_id, count(*) n_gold_spaces, avg(m) h from y group by 1)
            select trial_id, n_pkg_spaces, n_gold_spaces, round(g, 6) pkg_to_gold, round(h, 6) gold_to_pkg, round((g + h) / 2, 6) trial_score from a join b using (trial_id)""",
        "embedding_similarity": f"select vec_id, round(list_cosine_similarity(e, list_reverse(e)), 6) cosine from ({_V})",
        "match_consistency": f"with {_CONSISTENCY} select patient_id, n_trials_a, n_trials_b, top1_agreement, round(full_set_jaccard, 6) full_set_jaccard, round(top5_overlap_fraction, 6) top5_overlap_fraction, round(top10_overlap_fraction, 6) top10_overlap_fraction, round(mean_top5_score_a, 6) mean_top5_score_a, round(mean_top5_score_b, 6) mean_top5_score_b from m",
        "match_consistency_summary": f"with {_CONSISTENCY} select " + ", ".join(f"round({f}({c}), 6) {c}_{n}" for c in ("full_set_jaccard", "top5_overlap_fraction", "top10_overlap_fraction") for n, f in (("mean", "avg"), ("median", "median"))) + ", round(avg(top1_agreement), 6) top1_agreement_proportion, count(*) n_patients from m",
        "trial_text": r"select doc_id trial_id, trim(regexp_replace(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, ''), '\s+', ' ', 'g')) trial_text from documents",
        "trial_spaces": f"with {_SPACES} select trial_id, clinical_space_number, clinical_space_summary, rules general_exclusion_criteria, trial_id || '-' || clinical_space_number space_trial_id from sp where not gone",
        "trial_spaces_unfiltered": f"with {_SPACES} select trial_id, clinical_space_number, clinical_space_summary, rules boilerplate_text from sp",
        "note_dedup": rf"""with {_NOTES}, l as (select *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP.format('s')}), lambda s: s <> '') x from n),
            u as (select patient_id, d, turn, unnest(x) s, generate_subscripts(x, 1) i from l), f as (select *, row_number() over (partition by patient_id, s order by d, turn, i) k from u)
            select patient_id, d note_date, string_agg(s, ' ' order by i) note_text from f where k = 1 group by patient_id, d, turn""",
        "note_chunks": f"with {_CHUNKS} select * from chunks",
        "incremental_notes": """with e as (select user_id::varchar patient_id, ts::date d, event_id, ts from events),
            s as (select patient_id, max(ts)::date l from e where ts < timestamp '2024-01-15' group by 1 having max(ts)::date < date '2024-01-14')
            select patient_id, event_id from e left join s using (patient_id) where l is null or d > case when l < date '2024-01-10' then l else l - 10 end""",
        "prior_state": f"""select source patient_id, '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') last_note_date,
            {_STRIP.format(_STRIP.format("coalesce(text, '')") + " || chr(10) || chr(10) || 'Boilerplate conditions:' || chr(10) || coalesce(lang, '')")} patient_summary_with_boilerplate
            from documents qualify row_number() over (partition by source order by doc_id desc) = 1""",
        "serial_fold": f"with {_CHUNKS} select patient_id, string_agg('|' || length(chunk_text), '' order by chunk_index) as \"final\" from chunks group by 1",
        "summary_split": f"with {_SUMMARIES} select patient_id, main cancer_history_summary, rest general_exclusion_criteria_evidence from sp",
        "summary_clean": f"with {_SUMMARIES} select patient_id, main cancer_history_summary from sp where not regexp_matches(main, 'no cancer|no primary|no evidence of malignancy', 'i') and not starts_with(main, 'No information')",
        "quality_score": f"select doc_id patient_id, source space_trial_id, round((1 / (1 + exp(-(quality * 2.5 - toxic * 4 - 0.5)::float::double)))::float::double, 5) match_quality_score, 1 / (1 + exp(-(quality * 2.5 - toxic * 4 - 0.5)::double)) >= 0.2 match_quality_pass from ({_LABEL})",
        "exclusion_label": f"select doc_id patient_id, source trial_id, case when quality = 1 then 0.81 else 0.66 end::double exclusion_score, toxic <> 1 exclusion_criteria_pass from ({_LABEL})",
        "verdict_counts": f"select toxic <> 1 exclusion_criteria_pass, count(*) as count from ({_LABEL}) group by 1",
        "llm_score_parse": f"""with r as (select doc_id, replace(right({answers}, 60), '*', '') t from labels),
            s as (select doc_id, case when regexp_extract(t, '[Ff]inal\\s+[Ss]core\\s*:\\s*(\\d)', 1) <> '' then least(5, regexp_extract(t, '[Ff]inal\\s+[Ss]core\\s*:\\s*(\\d)', 1)::int)
                when regexp_extract(upper(t), 'SCORE\\s*[:\\-=]\\s*(\\d)', 1) <> '' then least(5, regexp_extract(upper(t), 'SCORE\\s*[:\\-=]\\s*(\\d)', 1)::int)
                when contains(upper(t), 'NOT REASONABLE') or contains(upper(t), 'NOT A REASONABLE') then 0 else -1 end score from r)
            select doc_id, score::int score, case when score < 0 then 'PARSE_FAILED' else 'Score:' || score end verdict from s""",
        "llm_exclusion_parse": f"""with r as (select doc_id, upper(right({verdicts}, 10)) t from labels),
            s as (select doc_id, case when contains(t, 'YES!') then 'YES' when contains(t, 'NO!') then 'NO' when contains(t, 'YES') then 'YES_FALLBACK' when contains(t, 'NO') then 'NO_FALLBACK' else 'PARSE_FAILED' end verdict from r)
            select doc_id, case when starts_with(verdict, 'YES') then false when starts_with(verdict, 'NO') then true end passed, verdict from s""",
        "csv_round_trip": "select doc_id::varchar doc_id, text, lang from documents",
        "parquet_round_trip": "select page_id, url, html from pages",
        "context_pairs": f"with {_PAIRS} select patient_id, space_trial_id, said general_exclusion_criteria_evidence, rule general_exclusion_criteria from pairs left join sources using (patient_id) left join spaces using (space_trial_id)",
        "exclusion_context": f"with {_PAIRS}, p as (select distinct patient_id, split_part(space_trial_id, '-', 1) trial_id from pairs) select patient_id, trial_id, said general_exclusion_criteria_evidence, rule general_exclusion_criteria from p left join sources using (patient_id) left join spaces using (trial_id)",
        "vector_literal": "select doc_id, 3 n, doc_id + 0.5::double a, n_chars::double b, null::double c from documents",
        "drift": f"select round(avg(c), 5) mean_cosine, count(*) n, avg(c) >= 0.8 passed from (select round(list_cosine_similarity(e, list_reverse(e)), 6) c from ({_V}))",
        "drift_worst": f"select vec_id, round(list_cosine_similarity(e, list_reverse(e)), 6) cosine from ({_V}) order by 2, 1 limit 5",
        "final_matches": final,
        "trial_qc": _trial_qc(),
        "patient_qc": _patient_qc(),
        "token_limit": r"select doc_id, len(list_filter(regexp_split_to_array('query: ' || coalesce(text, ''), '\s+'), lambda x: x <> ''))::int n_tokens from documents",
    }
