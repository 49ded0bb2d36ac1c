"""Toxicity scores from the nearest labelled examples.

A bounded sample of labelled documents is the example set. Every term of the examples is in the index: TF-IDF weights, with
document frequencies counted over all documents, times how much a term tells about the label, which is small but never 0.
Examples become unit vectors in an inverted index that is cut into blocks of examples; each block keeps its largest weight
of each term. A document is scored by its exact k nearest examples by cosine: only postings of blocks whose bound reaches
the k-th best cosine so far are read. Their votes, weighted by similarity, are calibrated on the examples themselves with
each left out, and the examples are kept as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.llm.common import give_back, map_rows

#: Bounds of the fit: labelled examples, and characters of all of them together.
EXAMPLES = 2_000
EXAMPLE_CHARS = 32_000_000
NEIGHBOURS = 15
BLOCK = 32
#: The weight of a term that says nothing about the label, and the chi-squared value that gives half of the rest.
LEAST_WEIGHT, HALF_CHI = 0.02, 15.0
#: Blocks that are read before the k-th best cosine so far rules others out.
FIRST_BLOCKS = 8
#: Groups of similar examples that stand together.
GROUPS = 24
DENSE = 32
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> dict[str, int]:
    """Terms of a text, its lower-cased words, and their counts."""
    return Counter(_WORD.findall((text or "").lower()))


class Index:
    """Block-max inverted index over unit vectors given as (terms, weights) of ``n_terms`` terms.

    A list of a term in a block is its postings there. Lists of terms that more than one example in DENSE holds are kept as
    one weight for each example of the block, the others as (example, weight).
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK) or 1
        sizes = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]).astype(np.float32) if vectors else np.zeros(0, np.float32)
        example = np.repeat(np.arange(self.n), sizes)
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) * DENSE > self.n)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        full = self.row[term] >= 0
        self.dense[self.row[term[full]], example[full]] = weight[full]
        self.dense = self.dense.reshape(len(often), self.blocks, BLOCK)
        self.dense_top = self.dense.max(axis=2)
        term, weight, example = term[~full], weight[~full], example[~full]
        cell = term * self.blocks + example // BLOCK
        order = np.lexsort((example, cell))
        #: A list for each other term and block that have one: cells ascending, where each begins, its largest weight.
        cells, starts = np.unique(cell[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.example, self.weight = example[order], weight[order].astype(np.float64)
        self.top = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0, np.float32)
        self.of_term = np.searchsorted(cells, np.arange(n_terms + 1) * self.blocks)
        self.block_of = cells % self.blocks

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, work: dict | None = None) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties to the smaller position; exact. ``work`` gets the numbers of postings read and there."""
        rows = self.row[terms]
        other = rows < 0
        lo, hi = self.of_term[terms[other]], self.of_term[terms[other] + 1]
        lists, q = _ranges(lo, hi), np.repeat(weights[other], hi - lo)
        rows, often = rows[~other], weights[~other].astype(np.float32)
        block = self.block_of[lists]
        bound = np.bincount(block, q * self.top[lists], self.blocks) + often @ self.dense_top[rows]
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        if not len(order):
            return []
        live, best = order[:FIRST_BLOCKS], []
        while len(live):
            chosen = np.zeros(self.blocks, bool)
            chosen[live] = True
            take = chosen[block]
            starts, ends = self.starts[lists[take]], self.starts[lists[take] + 1]
            at = _ranges(starts, ends)
            score = np.bincount(self.example[at], np.repeat(q[take], ends - starts) * self.weight[at], self.blocks * BLOCK).astype(np.float64)
            if len(rows):
                part = self.dense[rows] if len(live) == self.blocks else self.dense[rows[:, None], np.flatnonzero(chosen)]
                score.reshape(self.blocks, BLOCK)[chosen] += (often @ part.reshape(len(rows), -1)).reshape(-1, BLOCK)
            if work is not None:
                work["read"] += len(at) + len(rows) * len(live) * BLOCK
            score = np.round(score, 6)
            if skip >= 0:
                score[skip] = 0
            ids = np.flatnonzero(score)
            if len(ids) > k:
                ids = ids[score[ids] >= np.partition(score[ids], -k)[-k]]
            best = sorted([*best, *zip(score[ids].tolist(), ids.tolist())], key=lambda x: (-x[0], x[1]))[:k]
            live, order = order[len(live) :], np.zeros(0, np.int64)
            if len(best) == k:
                live = live[bound[live] >= best[-1][0] - 1e-5]
        if work is not None:
            work["there"] += int((self.starts[lists + 1] - self.starts[lists]).sum()) + len(rows) * self.blocks * BLOCK
        return best


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one after another."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)


class Model:
    """Terms, index and calibration. Examples are (doc_id, {term: count}, label)."""

    def __init__(self, examples: list[tuple[int, dict[str, int], int]], df: dict[str, int], n_docs: int, k: int = NEIGHBOURS):
        names = sorted({w for _, tf, _ in examples for w in tf})
        self.k, self.terms = k, {w: i for i, w in enumerate(names)}
        told = _telling(examples, self.terms)
        self.weights = np.array([math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1 for w in names]) * told if names else np.zeros(0)
        vectors = [self.vector(tf) for _, tf, _ in examples]
        order = _alike(vectors, len(names))
        self.ids, self.labels = [examples[i][0] for i in order], np.array([examples[i][2] for i in order], np.int64)
        vectors = [vectors[i] for i in order]
        self.index = Index(vectors, len(names))
        votes, empty = np.zeros((11, 2)), np.array([0.5, 1.0])
        for i, (v, y) in enumerate(zip(vectors, self.labels)):
            near = self.index.nearest(*v, k, skip=i)
            (votes[int(10 * self.vote(near))] if near else empty)[:] += (y, 1)
        #: The rate of examples without neighbours, smoothed towards the rate of all.
        base = (self.labels.sum() + 0.5) / (len(examples) + 1) if examples else 0.0
        self.empty = float((empty[0] - 0.5 + 2 * base) / (empty[1] + 1)) if examples else 0.0
        #: Per tenth of the vote the smoothed rate, made monotone from the left.
        middle = np.minimum(1.0, (np.arange(11) + 0.5) / 10)
        self.rates = _monotone(((votes[:, 0] + 2 * middle) / (votes[:, 1] + 2)).tolist(), (votes[:, 1] + 2).tolist())

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms, and their unit TF-IDF weights."""
        get = self.terms.get
        known = [(t, n) for w, n in tf.items() if (t := get(w)) is not None]
        terms, n = np.array([t for t, _ in known], np.int64), [n for _, n in known]
        w = (1 + np.log(n)) * self.weights[terms]
        return terms, w / (np.sqrt((w * w).sum()) or 1)

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return float(sum(s * self.labels[i] for s, i in near) / total) if total else 0.0

    def score(self, text: str | None, work: dict | None = None) -> tuple[float, list[tuple[int, float]]]:
        """Calibrated score, and the nearest examples as (doc_id, cosine)."""
        near = self.index.nearest(*self.vector(words(text)), self.k, work=work)
        if not near:
            return self.empty, []
        x = 10 * self.vote(near)
        lo = min(int(x), 9)
        return float(self.rates[lo] + (x - lo) * (self.rates[lo + 1] - self.rates[lo])), [(self.ids[i], s) for s, i in near]


def _alike(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, groups: int = GROUPS, rounds: int = 8) -> list[int]:
    """An order of the vectors in which similar ones stand together, so that few blocks have high bounds for a text.

    Groups come from k-means by cosine over the terms that occur most often; in a group vectors go by their heaviest term.
    """
    often = np.argsort(-np.bincount(np.concatenate([t for t, _ in vectors]), minlength=n_terms), kind="stable")[:4096] if vectors else np.zeros(0, np.int64)
    place = np.full(n_terms, -1)
    place[often] = np.arange(len(often))
    x = np.zeros((len(vectors), len(often)), np.float32)
    for i, (t, w) in enumerate(vectors):
        x[i, place[t[place[t] >= 0]]] = w[place[t] >= 0]
    groups = min(groups, len(vectors))
    centre = x[np.linspace(0, len(vectors) - 1, groups).astype(int)] if groups else x
    own = np.zeros(len(vectors), np.int64)
    for _ in range(rounds if groups else 0):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    heaviest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
    return sorted(range(len(vectors)), key=lambda i: (own[i], heaviest[i], i))


def _telling(examples: list[tuple[int, dict[str, int], int]], terms: dict[str, int]) -> np.ndarray:
    """Per term LEAST_WEIGHT to 1, by the chi-squared value of its document counts under both labels."""
    seen = np.zeros((2, len(terms)))
    for _, tf, y in examples:
        for w in tf:
            seen[y, terms[w]] += 1
    ones, n = sum(y for *_, y in examples), len(examples)
    if not 0 < ones < n:
        return np.full(len(terms), 1.0)
    both = seen.sum(axis=0)
    due = both * ones / n
    # Of small counts half an example less, so that a word seen once tells little.
    off = np.maximum(0, np.abs(seen[1] - due) - 0.5) ** 2
    chi = off / due + off / (both - due)
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * chi**2 / (chi**2 + HALF_CHI**2)


def _monotone(values: list[float], weights: list[float]) -> list[float]:
    """Isotonic regression by pooling neighbours."""
    out: list[list[float]] = []
    for v, w in zip(values, weights):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            v2, w2, n2 = out.pop()
            out[-1] = [(out[-1][0] * out[-1][1] + v2 * w2) / (out[-1][1] + w2), out[-1][1] + w2, out[-1][2] + n2]
    return [v for v, _, n in out for _ in range(n)]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and their texts in ``docs`` (doc_id, text).

    Up to ``examples`` labelled rows of together at most ``chars`` characters are taken by a hash of doc_id, and only their
    term counts come to the driver, so what it holds is bounded. Rows with a null id, label or text are ignored, of repeated
    ids one row is kept (label 0 and the first text before others). Document frequencies come from all rows of ``docs``.
    Without labels every score is 0; with labels of one kind all terms weigh alike.
    """
    rank = F.xxhash64("doc_id", F.lit(7))
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    docs = docs.select("doc_id", "text")
    taken = known.select("doc_id", "toxic", rank.alias("rank")).orderBy("rank", "doc_id").limit(2 * examples)
    got = docs.where("text is not null").join(F.broadcast(taken), "doc_id")
    sizes = got.select("doc_id", "rank", F.length("text").cast("long").alias("size")).groupBy("doc_id", "rank").agg(F.max("size").alias("size"))
    before = F.sum("size").over(Window.orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = sizes.orderBy("rank", "doc_id").limit(examples).withColumn("before", before).where(F.col("before") <= chars).select("doc_id")
    ids = [r["doc_id"] for r in chosen.collect()]

    def counted():
        return lambda doc_id, text, toxic: [(doc_id, words(text), toxic)]

    picked = got.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x"))
    rows = map_rows(picked.select("doc_id", "x.text", "x.toxic"), "doc_id long, terms map<string, int>, toxic int", counted, rows=64).collect()
    sample = sorted((r["doc_id"], dict(r["terms"]), r["toxic"]) for r in rows)
    df, n = document_frequencies(docs, {w for _, tf, _ in sample for w in tf})
    return Model(sample, df, n)


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Of each vocabulary word, the number of rows of ``docs`` that hold it, and the number of rows."""

    def run(batches):
        import pyarrow as pa

        seen, n = Counter(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    seen.update(vocabulary.intersection(_WORD.findall((t or "").lower())))
                    n += 1
        seen[""] = n
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
        seen.clear()
        give_back()

    got = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"]: r["n"] for r in got}
    return df, df.pop("", 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence (array of doc_id, cosine) for each row of ``docs`` (doc_id, text; other columns are not read).

    Texts without any term of an example, empty and null ones included, get the rate of such examples and no evidence. Texts
    are read whole. Equal texts get equal scores, ties between examples go to the one that stands first in the index; a null
    doc_id stays, a repeated row is scored again, no rows give no rows.
    """

    def setup():
        def one(doc_id, text):
            s, near = model.score(text)
            return [(doc_id, s, int(s >= 0.5), [{"doc_id": i, "cosine": c} for i, c in near])]

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int, evidence array<struct<doc_id long, cosine double>>", setup)
