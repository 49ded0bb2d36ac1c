"""The pipeline against plain loops over all documents, and on awkward rows."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tokenizers import Tokenizer  # noqa: E402

from matchloom.llm import langid, queries, secrets, toxicity  # noqa: E402
from matchloom.llm.common import read  # noqa: E402

SF = "/root/testdata/sf0.001"


def sets_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = [sets_of(r.text) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    best = defaultdict(list)
    for i, r in enumerate(rows):
        best[root(i)].append(r.doc_id)
    return [r for i, r in enumerate(rows) if r.doc_id == min(best[root(i)])]


def redacted(text, model):
    covered = sorted((s, e) for s, e, _ in secrets.spans(text, model))
    merged = []
    for s, e in covered:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + "[SECRET]" + text[e:]
    return text


def test_pipeline_equals_plain_loops(spark):
    docs = read(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)
    rows = docs.collect()
    known = langid.Classifier(langid.fit(queries.language_training(docs)))
    rows = [r for r in rows if known.predict(r.text)[0] != "und"]
    model = toxicity.fit(frame(rows), queries.toxic_training(read(spark, SF, "labels")))
    rows = [r for r in rows if model.score(r.text)[0] < 0.5]
    rows = brute_kept(rows)
    crf = secrets.fit(frame(rows))
    texts = {r.doc_id: redacted(r.text, crf) for r in rows}
    coder = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    ids = {k: coder.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}

    got = corpus_pipeline.run(spark, SF).collect()
    pieces, room = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for k, mine in pieces.items():
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert sum(r.length for r in mine) == len(ids[k]) and (len(mine) == 1) == (len(ids[k]) <= 1024)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][r.start : r.start + r.length], "<u4").tobytes())
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_take_awkward_rows(spark, tmp_path):
    read(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    read(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label int"
    long = "plain words about rivers and hills " * 9000
    learned = [i for i in range(10**6, 10**6 + 20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    odd = [
        (1, None, None, None, None, None, 1),
        (2, "", "en", "s", 0, True, 2),
        (learned[0], long, "en", "s", 1, True, 3),
        (learned[1], long, "en", None, 1, False, 4),
        (None, "token = abcdefghijkl1234 and more", "en", "s", 1, True, 5),
    ]
    docs = spark.createDataFrame(odd, schema)
    sizes = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes == [3, 3, 2, 2]
    assert {r.doc_id for r in docs.collect()} == {learned[0], None}
    assert "abcdefghijkl1234" not in docs.where("doc_id is null").first().text


def test_dedup_keeps_one_row_of_each_group(spark):
    """Of repeated and missing ids too: texts of their own stay, copies go."""
    own = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, own("a")), (2, own("a")), (3, own("b")), (3, own("b")), (4, own("a")), (4, own("c")), (None, own("c")), (None, own("d")), (None, own("d")), (None, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "?")[:1]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert sorted(t for _, t in got) == ["?", "?", "?", "a", "b", "c", "d"]
    assert (1, "a") in got and (3, "b") in got
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), "").count() == 0
