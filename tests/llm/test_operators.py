import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matchloom.llm import bpe, chat, langid, media, neardup, packing, queries, secrets, topk, toxicity, warc
from matchloom.llm.common import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept int"


def frame(spark, texts):
    """Rows with clashing extra columns; a text may be null."""
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in texts], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def edited(words, k, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), k):
        out[i] = f"x{r.randrange(10**6)}"
    return out


EDGE = [(901, None), (902, ""), (903, " \n\t"), (904, "One two"), (904, "One two"), (905, "ONE TWO"), (906, "é" * 50_000), (None, "a b c d e f")]


def test_near_dedup_equals_brute_force(spark):
    base = prose(1, 160)
    texts = [(i, " ".join(edited(base, i % 9, i))) for i in range(60)] + [(100 + i, " ".join(prose(i + 50, 120))) for i in range(40)] + [(200, " ".join(base).upper())]
    rows = texts + EDGE
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    ids, parent = [i for i in sets if i is not None], {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1000, 5000])
def test_near_dedup_of_a_template_crowd_equals_brute_force(spark, n):
    """Unlinked texts around one passage (Jaccard of 0.65), among them pairs of 0.76."""
    passage = [f"t{k}" for k in range(131)]
    texts = [(i, " ".join(passage + [f"u{i - i % 2 if i < 200 and k < 12 else i}_{k}" for k in range(34)])) for i in range(n)]
    known, held = {}, []
    for _, t in texts:
        w = t.split()
        held.append([known.setdefault(tuple(w[k : k + 5]), len(known)) for k in range(len(w) - 4)])
    seen = np.bincount(np.concatenate(held))
    place = np.cumsum(seen > 1) - 1
    x = np.zeros((n, place[-1] + 1), np.float32)
    for i, h in enumerate(held):
        x[i, [place[c] for c in h if seen[c] > 1]] = 1
    both, size = x @ x.T, np.array([len(h) for h in held])
    a, b = np.nonzero(np.triu(100 * both >= 75 * (size[:, None] + size - both), 1))
    assert list(zip(a, b)) == [(i, i + 1) for i in range(0, 200, 2)]
    label = np.arange(n)
    label[b] = a
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(n)] == label.tolist()


def test_near_dedup_deals_equal_signatures_anew_in_each_tree(spark):
    sig = bytearray(neardup.signature(neardup.shingles(" ".join(prose(1, 60)))).tobytes())
    regions, _ = neardup._regions(spark.createDataFrame([(i, sig) for i in range(600)], "rep long, sig binary"))
    chunks = {}
    for r in regions.collect():
        chunks.setdefault(r.region, set()).add(r.rep)
    assert len(chunks) == neardup.TREES * 4 == len(set(map(frozenset, chunks.values())))


def test_warc_round_trip_and_splits(spark):
    big = "<p>é</p>" * 200
    pages = [(1, "http://a/\n x", big), (2, "http://b", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", big + "2")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.archive(spark, df)
    for split in (64, 1000, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(manifest, split=split).collect()}
        assert len(got) == 6 and (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
        for i, _, html in pages:
            data = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert got[4].record_type == got[5].record_type == "response"
    assert warc.read_archives(warc.archive(spark, df.limit(0))).count() == 0


def test_warc_rejects_decoys():
    record = warc._record("response", 1, "u", b"x", None)
    data = b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + warc._gzip(record) + warc._gzip(record)
    assert [r for _, r in warc.records(io.BytesIO(data), len(data), 0, len(data))] == [record, record]


def test_language(spark):
    vocabulary = {"aa": ["kato", "mire", "soluna", "pak"], "bb": ["der", "schön", "winz", "ulmen"]}
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(vocabulary[lang], k=30)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = frame(spark, [(1, "Kato, MIRE soluna!"), (2, "der winz ulmen"), (3, None), (4, "12 ### !"), (5, "")])
    got = {x.doc_id: x for x in langid.identify(test, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"] and all(0 <= x.score <= 1 for x in got.values())
    assert langid.fit(train.limit(0)) == {} and langid.identify(test, {}).where("lang_pred <> 'und'").count() == 0


def test_language_margin_rejects_gibberish_and_mixtures(spark):
    import corpus_pipeline

    r = random.Random(8)
    shared = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    own = {k: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(60)] for k in ("aa", "bb")}
    made = lambda k, n: " ".join(r.choice(own[k]) if r.random() < 0.3 else r.choice(shared) for _ in range(n))
    rows = [(i, made(k, 120), k, "s", 1) for i in range(600) for k in [("aa", "bb")[i % 2]]]
    held = [(10_000 + i, made(("aa", "bb")[i % 2], 120), None, "s", 1) for i in range(100)]
    odd = [(20_000, "qrstuvwxyz" * 3, None, "s", 1), (20_001, "zz yx", None, "s", 1)] + [(20_002 + i, " ".join("".join(r.choices("qrstuvwxyz", k=6)) for _ in range(120)), None, "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows + held + odd, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(queries.language_training(docs))
    assert 0 < model.margin <= langid.MOST_MARGIN
    got = {x.doc_id for x in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert len(got & {i for i, *_ in held}) >= 97 and not got & {i for i, *_ in odd}
    found = {x.doc_id for x in langid.identify(docs, model).where("not rejected").collect()}
    assert found == got


def secret_docs(spark):
    r = random.Random(5)
    code = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = [(i, " ".join(language(r, 60)) + (f'. Token = "{code(40)}" and more words 2024-01-{i % 28:02d} end' if i % 4 == 0 else "")) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "x" * 100_000 + " 1" * 1000), (None, "a b"), (903, "twice"), (903, "twice")]


def language(r, n):
    parts = ["ka", "ro", "mi", "ten", "so", "lu", "dar", "in", "es", "po"]
    return ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n)]


def test_secrets_base_spans():
    t = 'token = "abcdefghijkl" ſecret=abcdefghijkl token= secret: aaaaaaaaaaaa AKIA' + "A" * 14 + " " + "0123456789abcdef" + " é password=short"
    want = [("assign", 0, 21), ("access", t.index("AKIA"), t.index("AKIA") + 18), ("hex", t.index("0123"), t.index("0123") + 16)]
    assert [(secrets.KINDS[k], s, e) for s, e, k in secrets.base_spans(t)] == want


def test_secrets_chain_finds_what_base_patterns_miss(spark):
    rows = secret_docs(spark)
    docs = frame(spark, rows)
    model = secrets.fit(docs)
    r = random.Random(6)
    # None of these leads and prefixes is planted in training.
    forms = ["Authorization: Bearer %s", "ghp_%s", "xoxb-%s", "client_auth = %s", "my key is %s", "credential to %s"]
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
    found = 0
    for i in range(120):
        value = "".join(r.choices(alphabets[i % 2], k=36))
        before = " ".join(language(r, 30)) + " "
        text = before + forms[i % 6] % value + " " + " ".join(language(r, 30))
        at = text.index(value)
        found += any(s <= at + 1 and e >= at + 36 for s, e, _ in secrets.spans(text, model))
    assert found >= 108
    clean = [" ".join(language(r, 80)) + f" on 2024-05-{i % 28:02d} at 10:30 see https://karo.mi/dar/ten-{i}, call +49 30 1234567 or v1.{i}.2" for i in range(200)]
    assert sum(bool(secrets.chain_spans(t, model)) for t in clean) <= 2
    # A long text is scanned to its end.
    long = " ".join(language(r, 60_000))
    assert [text_of for text_of in [long[s:e] for s, e, _ in secrets.spans(long + " my key is Zk3v9QmT7xLw2RbYp8NsHd4Gf6Jc end", model)]] == [""]
    assert secrets.digest(docs, model).count() == len(rows)
    red = {x.doc_id: x for x in secrets.redact(docs, model).collect()}
    assert "[SECRET]" in red[0].text and red[900].text is None and red[901].text == "" and red[0].kept is None
    scanned = {x.doc_id: [tuple(y) for y in x.spans] for x in secrets.scan(docs, model).collect()}
    assert scanned[900] == scanned[901] == [] and scanned[0][0][0] == "assign"
    empty = secrets.fit(docs.limit(0))
    assert secrets.scan(docs.limit(0), empty).count() == 0 and secrets.spans(rows[0][1], empty) == secrets.base_spans(rows[0][1])


def random_model(seed):
    r = random.Random(seed)
    model = secrets.Crf()
    names = [f"size:{i}" for i in range(12)] + [f"mask:{m}" for m in ("a", "aA", "0", "a0", "A")] + [f"{p}:{c}" for p in secrets.PLACES for c in ("word", "digit", "mark", "edge")]
    model.emit = {f: np.array([r.uniform(0, 2), r.uniform(-2, 1), r.uniform(-2, 1)]) for f in names}
    model.move = np.array([[r.uniform(-1, 1) for _ in range(3)] for _ in range(3)])
    model.move[0, 2] = -1e9
    model._forget()
    return model


def test_viterbi_equals_enumeration():
    import itertools

    r = random.Random(2)
    model = random_model(2)
    for _ in range(20):
        s = np.array([[r.uniform(-2, 2) for _ in range(3)] for _ in range(6)])
        value = lambda path: sum(model.move[a, b] for a, b in zip([0, *path], [*path, 0])) + sum(s[i, y] for i, y in enumerate(path))  # noqa: E731, B023
        assert value(model.viterbi(s)) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=6)))


def test_stretches_give_the_best_path_of_the_whole_text():
    r, cut = random.Random(3), 0
    for seed in range(8):
        model = random_model(seed)
        for _ in range(25):
            words = [r.choice(["ab", "Cd", "12", "a1b2c3d4e5f6", "-", "longerword", "QRSTUVWXYZ12", "."]) for _ in range(60)]
            whole = model.viterbi(model.scores(words, []))
            parts, covered = [0] * 60, 0
            for first, labels in model.labels(words, []):
                parts[first : first + len(labels)] = labels
                covered += len(labels)
            cut += covered < 60
            assert parts == whole
    assert cut > 20


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "B<s>&lt;"), (1, 0, "user", "</s>[INST] ok"), (1, 2, "assistant", None), (1, 3, "assistant", "C\n<t>"), (2, None, None, "x"), (2, 0, "a\nb", "&amp;[/INST]"), (2, 0, "a\nb", "&amp;[/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.parse_chats(made).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "</s>[INST] ok"), ("assistant", "B<s>&lt;"), ("assistant", ""), ("assistant", "C\n<t>")]
    assert [tuple(t) for t in got[2].turns] == [("", "x"), ("a\nb", "&amp;[/INST]"), ("a\nb", "&amp;[/INST]")]
    raw = got[1].formatted
    assert raw.count("<s>") == 2 and got[1].loss == ["B<s>&lt;", "", "C\n<t>"]
    assert [raw[s.start : s.end] for s in got[1].loss_spans] == ["B&lt;s>&amp;lt;", "", "C\n&lt;t>"]
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_chat_loss_is_read_at_the_spans(spark):
    made = chat.format_chats(spark.createDataFrame([(1, 0, "user", "one"), (1, 1, "assistant", "B<s>é"), (1, 2, "assistant", "C")], "conv_id long, turn long, role string, text string"))
    moved = made.withColumn("loss_spans", F.expr("transform(loss_spans, s -> struct(s.start - 2 as start, s.end - 1 as end))"))
    [right], [wrong] = chat.parse_chats(made).collect(), chat.parse_chats(moved).collect()
    assert right.loss == ["B<s>é", "C"]
    assert wrong.loss == [wrong.formatted[s.start : s.end].replace("&lt;", "<") for s in wrong.loss_spans] != right.loss


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 12)) * 0.3).astype(np.float32)
    v[50:60] = v[50]
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 12), (1060, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable("embedding")).select("vec_id", topk.integers("embedding").alias("vector"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, cell=12 * 64, least_shard=1).collect()
    w = np.floor(64 * v.astype(np.float64)).astype(int)
    want = set()
    for q in range(0, 300, 20):
        best = sorted(((-int(w[q] @ w[i]), i) for i in range(300) if i != q))[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_shards_share_thresholds_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 9, (400, 8))
    rows = [(i % 390, a.tolist(), "x", 1) for i, a in enumerate(v)] + [(None, [1] * 8, "x", 1), (7, None, "x", 1), (1000, [], "x", 1), (1001, [5], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, query_id string, score int")
    full = [(i, np.r_[np.array(a, int), np.zeros(8 - len(a), int)]) for i, a, *_ in rows if i is not None and a is not None]
    asked = {}
    for i, a, *_ in rows:
        if i is not None and a is not None and i % 20 == 0:
            asked[i] = min(asked.get(i, a), a)
    want = set()
    for q, a in asked.items():
        a = np.r_[np.array(a, int), np.zeros(8 - len(a), int)]
        best = sorted((-int(a @ x), i) for i, x in full if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for cell, least in ((10**6, 10**6), (8 * 50, 1), (8 * 7, 1)):
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, cell=cell, least_shard=least).collect()} == want


def test_topk_skips_lists_and_probes_few():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(6000, 64)) * 8 * np.linspace(3, 0.2, 64)).astype(np.float32)
    lists, work = topk.Lists(np.arange(6000), v), {"there": 0, "traversed": 0, "probed": 0}
    for q in range(0, 100, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(6000), -s))[:20]
        got, score = topk.search(lists, q, v[q], 20, s[best[-1]], work)
        assert got.tolist() == best.tolist() and score.tolist() == s[best].tolist()
    assert work["traversed"] < 0.7 * work["there"] and work["probed"] < 0.1 * work["there"], work


def test_topk_raises_where_sums_could_overflow(spark):
    df = spark.createDataFrame([(0, [2**40]), (1, [2**40])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("vec_id") == 0).collect()
    large = spark.createDataFrame([(0, [2**30, 1]), (1, [2**30, 3]), (2, [2**30, 2])], "vec_id long, vector array<long>")
    assert [(r.vec_id, r.score) for r in topk.top_k(large, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**60 + 3), (2, 2**60 + 2)]


def test_toxicity(spark):
    bad, r = ["grunk", "plof"], random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, " ".join(prose(i, 30) + ([r.choice(bad)] * 2 if toxic else []))))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, rows + EDGE), spark.createDataFrame(labels + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {x.doc_id: x for x in toxicity.score(frame(spark, [(1, "oh GRUNK here"), (2, "all fine"), (3, None), (4, "")]), model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[1].evidence
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), known)).where("predicted = 1").count() == 0
    # The bound on characters holds, and a few labels are enough for a term to tell.
    assert 0 < len(toxicity.fit(docs, known, chars=4000).labels) < 40
    few = toxicity.fit(docs, known.where("doc_id < 60"))
    assert few.score("a grunk plof")[0] > few.score("w1 w2 w3")[0]


def unit_vectors(r, n, terms, at_most):
    out = []
    for _ in range(n):
        t = np.array(sorted(r.sample(range(terms), r.randint(0, at_most))), np.int64)
        w = np.array([r.random() for _ in t])
        out.append((t, w / (np.sqrt((w * w).sum()) or 1)))
    return out


@pytest.mark.parametrize("dense", [1, 16, 10**6])
def test_nearest_equals_brute_force(monkeypatch, dense):
    """With lists of either kind, and both."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    r = random.Random(6)
    vectors = unit_vectors(r, 900, 60, 6)
    index = toxicity.Index(vectors, 60)
    full = np.zeros((900, 60))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    for q in range(60):
        cosines = full @ full[q]
        cosines[q] = 0
        want = sorted(((-round(float(c), 6), i) for i, c in enumerate(cosines) if c > 1e-6))[:15]
        got = index.nearest(*vectors[q], 15, skip=q)
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want], abs=2e-6) and all(abs(cosines[i] - s) < 2e-6 for s, i in got)


def test_nearest_skips_blocks():
    r = random.Random(7)
    vectors = [(np.array([g, 100 + r.randrange(50)]), np.array([0.99, 0.14])) for g in range(40) for _ in range(50)]
    index, work = toxicity.Index(vectors, 150), {"read": 0, "there": 0}
    for v in vectors[::40]:
        assert len(index.nearest(*v, 15, work=work)) == 15
    assert work["read"] < 0.8 * work["there"]


def test_encoder_reads_the_files_settings():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    made = Tokenizer(models.BPE())
    assert not packing.splits_at_blanks(made)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert packing.splits_at_blanks(made)
    made.normalizer = normalizers.Lowercase()
    assert not packing.splits_at_blanks(made)
    assert not packing.splits_at_blanks(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_encoder_equals_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHECKED", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = packing.Encoder(path)
    assert e.ranks is not None and packing.as_ranks(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) is None
    r, letters = random.Random(1), "ab 'sStT  \n\t0123_-é ñ·»\xa0½² 'llαя中<|endoftext|>\x1c\x85ªµ́"
    for _ in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    texts = EDGE + [(i, " ".join(prose(i, 20 * i))) for i in range(40)] + [(500, "word " * 3000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(frame(spark, texts), path, with_ids=True).collect()
    sequences, docs = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert [r.length for r in sorted(docs[500], key=lambda r: r.piece)][1:] == [1024] * (len(docs[500]) - 1)
    assert len(docs[904]) == 2 and len(sequences) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(frame(spark, []), path).count() == 0


LONG = " ".join(prose(9, 4000))


def test_media(spark):
    got = {r.doc_id: r for r in media.digest(frame(spark, [(1, "héllo"), (2, "héllo"), (3, None), (4, "x" * 64), (5, LONG)])).collect()}
    payload = "héllo".encode().ljust(64, b"\0")
    assert got[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[1].tail_crc32 == zlib.crc32(payload) and got[1].n_bytes == 6
    assert got[1][1:] == got[2][1:] and (got[3].n_bytes, got[3].payload_bytes, got[4].payload_bytes, got[4].media_bytes) == (0, 64, 64, 108)
    assert all(len(r.times) == len(r.codes) for r in got.values()) and len(got[5].times) > 20
    made = {r.doc_id: r for r in media.encode(frame(spark, [(1, "héllo"), (5, LONG), (6, None)])).collect()}
    for i in (1, 5):
        assert hashlib.sha256(made[i].media).hexdigest() == got[i].media_sha256 and made[i].times == got[i].times and made[i].codes == got[i].codes
        packed = np.array(got[i].times, "<i4").tobytes() + np.array(got[i].codes, "<i4").tobytes()
        assert got[i].feature == f"{len(got[i].times)}:{hashlib.sha256(packed).hexdigest()}"
    assert media.from_wav(made[6].media) == b"\0" * 64 and media.digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [5, 2048])
def test_peaks_and_pairs_equal_loops(monkeypatch, chunk):
    monkeypatch.setattr(media, "_CHUNK", chunk)
    r = np.random.default_rng(5)
    signals = [r.integers(0, 256, 9000).astype(np.uint8), np.frombuffer(b"abcdefgh" * 900, np.uint8), np.zeros(640, np.uint8)]
    signals.append((127 + 60 * np.sin(2 * np.pi * 32 * np.arange(4096) / 256) + 50 * np.sin(2 * np.pi * 90 * np.arange(4096) / 256)).astype(np.uint8))
    for signal in signals:
        x = media.spectrogram(media._frames(signal))
        want = []
        for t in range(len(x)):
            for b in range(x.shape[1]):
                around = [(u, c) for u in range(max(0, t - 3), min(len(x), t + 4)) for c in range(max(0, b - 10), min(x.shape[1], b + 11)) if (u, c) != (t, b)]
                if x[t, b] >= media.FLOOR and all(x[t, b] > x[p] if p < (t, b) else x[t, b] >= x[p] for p in around):
                    want.append((t, b + media.LOWEST))
        got = list(zip(*(a.tolist() for a in media.peaks(signal))))
        assert got == want
        pairs = []
        for t, b in want:
            later = [(u, c) for u, c in want if t < u <= t + media.SPAN][: media.FAN]
            pairs += [(t, b << 20 | c << 10 | u - t) for u, c in later]
        assert list(zip(*(a.tolist() for a in media.fingerprint(signal)))) == pairs
    assert {32, 90} <= set(media.peaks(signals[-1])[1].tolist())


def test_warc_file_systems(tmp_path):
    from pyarrow import fs

    for uri, want in ((f"file://{tmp_path}", str(tmp_path)), (f"file:{tmp_path}", str(tmp_path)), (str(tmp_path), str(tmp_path)), ("dbfs:/a/b", "/dbfs/a/b")):
        system, at = warc.filesystem(uri)
        assert isinstance(system, fs.LocalFileSystem) and at == want
    with pytest.raises(ValueError, match="odd:"):
        warc.filesystem("odd://x/y")


def test_warc_awkward_rows(spark):
    big, long = "<p>é</p>" * 200, "q" * 3_000_000
    rows = [(1, "u", big, 5, "x"), (1, "u", big, 5, "x"), (2, "u", big, 5, "x"), (2, "u", big, 5, "x"), (None, "u", big, 5, "x"), (None, None, None, 5, "x"), (4, "v", long, 5, "x"), (5, "v", long, 5, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int, record_type string")
    for most in (0, 10):
        manifest = stage(warc.write_archives(warc.with_revisits(df, most=most), warc.new_path(spark, "warc")), "manifest")
        got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(manifest).collect()), key=str)
        want = [(1, "revisit", 2, 1800), (1, "revisit", 2, 1800), (2, "response", None, 1800), (2, "response", None, 1800), (0, "revisit", 2, 1800), (0, "response", None, 0), (4, "revisit", 5, len(long)), (5, "response", None, len(long))]
        assert got == sorted(want, key=str)


def test_bpe(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    long = ("abc  def\n\n ghi " * 20_000) + "z" * 30_000
    assert bpe.encode(enc, long) == enc.encode_ordinary(long)
    rows = [(1, "héllo <|endoftext|>"), (2, None), (3, "")]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows), path, pattern).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256("héllo <|endoftext|>".encode()).hexdigest() and got[2].n_tokens == got[3].n_tokens == 0
    tokens = bpe.tokenize(frame(spark, rows), path, pattern)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.detokenize(tokens, path, pattern).collect()}[1] == rows[0][1]
