"""MinHash near-duplicate detection with an LSH forest.

Each document becomes the set of its distinct word 5-grams and a MinHash signature of 128 values. The forest keeps 16
sorted signature orders (trees); documents with a long common prefix in an order are candidates. The depth adapts to the
region: a prefix of 3 values is enough where few documents share it, and crowded prefixes are split at 6, 10, 18 and 32
values. Whatever is still crowded at the last depth (practically equal signatures) is dealt into chunks, and each of its
members is also a candidate of the region's smallest document.

Candidates become links only after their whole sets have been compared, in two rounds. The first round compares a star of
likely pairs in each region and joins them into components; the second compares every remaining likely pair whose ends are
in different components. So a group of n copies costs about n comparisons, and no link is left out for being one of many.
Deep prefixes lose a document whose only link leads into a large group of near copies, or into a crowd that is no group of
copies (one template, different documents). So all documents of a crowded region that are still in different components are
compared with each other at last, in cells of two blocks. A block is bounded by its documents and by their shingles, and
members of the region's largest component are not compared among themselves. That costs the square of what is unlinked in a
crowded region, in comparisons but not in rows.
Components come from minimum labels with pointer jumping over staged tables; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import counted_stage, give_back, map_rows, stage

WORDS = 5
VALUES = 128
TREES = 16
DEPTHS = (3, 6, 10, 18, 32)
CROWD = 192
#: Documents, and shingles of all of them, in a block of a crowded region.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Of 128 equal signature values; a pair at 0.75 falls below with probability of about 1e-7.
LIKELY = 72

_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ORDERS = [np.roll(np.arange(VALUES), -t * (VALUES // TREES)) for t in range(TREES)]
_MUL = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word 5-grams; of the whole word sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, acc = len(words) - WORDS + 1, np.zeros(len(words) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        acc = acc * np.uint64(_MUL) + h[k : k + n]
    return np.unique(_mix(acc))


def signature(s: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits each."""
    low = np.full(VALUES, _MASK, np.uint64)
    for at in range(0, len(s), 512):
        low = np.minimum(low, (s[at : at + 512, None] * _A + _B).min(axis=0))
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(sig: np.ndarray, tree: int, depth: int) -> int:
    return _signed(xxhash.xxh64_intdigest(sig[_ORDERS[tree][:depth]].tobytes(), seed=tree * 64 + depth))


def _signatures(docs: DataFrame) -> DataFrame:
    def setup():
        def one(doc_id, text):
            s = shingles(text)
            if not len(s):
                return [(doc_id, 0, None, None)]
            return [(doc_id, len(s), xxhash.xxh128_digest(s.tobytes()), signature(s).tobytes())]

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, same binary, sig binary", setup)


def _regions(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, first, rep): each representative under the regions of the forest that it shares with others; and the crowded ones at the first depth."""

    def roots():
        def one(rep, sig):
            s = np.frombuffer(sig, np.uint16)
            return [(_key(s, t, DEPTHS[0]), t, rep) for t in range(TREES)]

        return one

    def deeper():
        def one(rep, tree, sig):
            s = np.frombuffer(sig, np.uint16)
            return [(_key(s, tree, d), i, tree, rep) for i, d in enumerate(DEPTHS) if i]

        return one

    def sized(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).where("size > 1")
        return rows.join(stage(sizes, "sizes"), "key")

    level = stage(sized(map_rows(reps.select("rep", "sig"), "key long, tree int, rep long", roots)), "roots")
    shallow = level.where(F.col("size") <= CROWD).select(F.col("key").alias("region"), F.lit(None).cast("long").alias("first"), "rep")
    full = level.where(F.col("size") > CROWD).select(F.col("key").alias("region"), "size", "rep")
    crowded = level.where(F.col("size") > CROWD).join(reps.select("rep", "sig"), "rep").select("rep", "tree", "sig")
    keys = stage(map_rows(crowded, "key long, depth int, tree int, rep long", deeper), "crowded")
    if keys.isEmpty():
        return shallow, full
    # A deeper key lies within one shallower key, so sizes over all crowded rows are those within crowded regions.
    found = F.struct(F.when(F.col("size") <= CROWD, F.col("depth")).otherwise(len(DEPTHS)).alias("at"), (-F.col("depth")).alias("deepest"), "key", "size", "first")
    best = sized(keys).groupBy("rep", "tree").agg(F.min(found).alias("x"), F.max("depth").alias("reached")).select("rep", "reached", "x.*")
    # A region that would lie below the last shared key has one member: it takes no part.
    last = len(DEPTHS) - 1
    fits = best.where(f"at <= {last}").select(F.col("key").alias("region"), F.lit(None).cast("long").alias("first"), "rep")
    # Salted with the key, so that each tree deals the same documents anew.
    chunk = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("size") / CROWD))
    over = best.where(f"at > {last} and reached = {last}").select(F.xxhash64("key", chunk).alias("region"), "first", "rep")
    return shallow.unionByName(fits).unionByName(over), full


def _by_region(rows: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(table)`` for the rows of each region, which hold at most a few times CROWD rows."""
    rows = rows.repartition("region").sortWithinPartitions("region", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(table: pa.Table) -> list[pa.RecordBatch]:
            region = table.column("region").to_numpy()
            edges = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    fn(table, lo, hi, a, b)
            x = np.unique(np.array([a, b], np.int64).reshape(2, -1), axis=1)
            return [pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            last = table.column("region")[-1].as_py()
            keep = int(np.searchsorted(table.column("region").to_numpy(), last))
            if keep:
                yield from pairs(table.slice(0, keep).combine_chunks())
            rest = table.slice(keep).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from pairs(rest)
        rest = None
        give_back()

    return rows.mapInArrow(run, schema)


def _likely(table: pa.Table, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the region's rows, and which pairs are likely: enough equal values and sizes that allow 0.75."""
    part = table.slice(lo, hi - lo)
    ids, n = part.column("rep").to_numpy(), part.column("n").to_numpy()
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
    near = np.zeros((len(ids), len(ids)), bool)
    for i in range(len(ids)):
        near[i] = (sig == sig[i]).sum(axis=1) >= LIKELY
    return ids, near & (100 * np.minimum(n[:, None], n) >= 75 * np.maximum(n[:, None], n)) & (ids[:, None] != ids)


def _stars(table: pa.Table, lo: int, hi: int, a: list[int], b: list[int]) -> None:
    ids, near = _likely(table, lo, hi)
    free = near.any(axis=1)
    taken: list[int] = []
    for i in range(len(ids)):
        if not free[i]:
            continue
        free[i] = False
        mine = np.flatnonzero(near[i] & free)
        older = [c for c in taken if near[i, c]][:1] or [int(np.flatnonzero(near[i])[0])] * (not len(mine))
        free[mine] = False
        taken.append(i)
        for j in [*mine, *older]:
            a.append(min(int(ids[i]), int(ids[j])))
            b.append(max(int(ids[i]), int(ids[j])))


def _between(table: pa.Table, lo: int, hi: int, a: list[int], b: list[int]) -> None:
    label = table.column("label").slice(lo, hi - lo).to_numpy()
    if (label == label[0]).all():
        return
    ids, near = _likely(table, lo, hi)
    i, j = np.nonzero(near & (label[:, None] != label) & (ids[:, None] < ids))
    a.extend(ids[i].tolist())
    b.extend(ids[j].tolist())


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs, those with 100 * intersection >= 75 * union of their whole sets."""

    def setup():
        def one(a, b, x, y):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return [(a, b)] if 100 * both >= 75 * (len(x) + len(y) - both) else []

        return one

    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long", setup)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached over the edges (a, b), for each node of an edge. Reads ``edges`` in each step, so give a staged table."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.join(around, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new, changed = counted_stage(lower.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label")), "labels", F.col("old") != F.col("label"))
        labels = new.select("node", "label")
        if not changed:
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more links (a, b): components of the graph whose nodes are the labels so far."""
    links, n = counted_stage(links, "links")
    if not n:
        return labels
    for x in "ab":
        links = links.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    ends = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    merged = components(stage(ends.distinct(), "merged"))
    new = merged.withColumnRenamed("label", "to")
    old = labels.join(new.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    added = merged.join(labels.select("node"), "node", "left_anti")
    return stage(old.unionByName(added), "labels")


def _crowds(full: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of documents in one crowded region: enough of them to join all that have any.

    Members of the region's largest component need no comparison among themselves, so they are dealt into blocks of their
    own; every pair of blocks but these is a cell.
    """
    sizes = reps.groupBy("rep").agg(F.max("n").alias("n"))
    named = full.select("region", "rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(sizes, "rep")
    named = stage(named.select("region", "rep", "n", F.coalesce("label", "rep").alias("label")), "crowds")
    shares = named.groupBy("region", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    whole = shares.groupBy("region").agg(F.max(F.struct("rows", "label", "shingles")).alias("x"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    split = whole.where("x.rows < rows").select(
        "region", F.col("x.label").alias("main"), blocks(F.col("rows") - F.col("x.rows"), F.col("shingles") - F.col("x.shingles")).alias("own"), blocks(F.col("x.rows"), F.col("x.shingles")).alias("others")
    )
    dealt = named.join(stage(split, "split"), "region")
    deal = lambda of: F.pmod(F.xxhash64("rep", "region"), of).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("label") == F.col("main"), F.col("own") + deal(F.col("others"))).otherwise(deal(F.col("own"))))
    # Cells (i, j) with i <= j and i of the blocks outside the main component.
    first = F.when(F.col("block") < F.col("own"), F.sequence("block", F.col("own") + F.col("others") - 1)).otherwise(F.array().cast("array<int>"))
    second = F.when(F.col("block") > 0, F.sequence(F.lit(0), F.least("block", "own") - 1)).otherwise(F.array().cast("array<int>"))
    cells = F.concat(F.transform(first, lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("left"))), F.transform(second, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"))))
    rows = dealt.select("region", "rep", "label", F.explode(cells).alias("cell")).select(F.xxhash64("region", "cell.i", "cell.j").alias("region"), "rep", "label", "cell.left", (F.col("cell.i") == F.col("cell.j")).alias("within"))
    return _by_region(rows.join(sets, "rep"), "a long, b long", _cell).distinct()


def _cell(table: pa.Table, lo: int, hi: int, a: list[int], b: list[int]) -> None:
    part = table.slice(lo, hi - lo)
    ids, label, left = (part.column(c).to_numpy() for c in ("rep", "label", "left"))
    # Of the set itself: a repeated doc_id may have several.
    n = pc.binary_length(part.column("set")).to_numpy().astype(np.int64) // 8
    left = left.astype(bool)
    rows = np.flatnonzero(left)
    others = rows if part.column("within")[0].as_py() else np.flatnonzero(~left)
    if not len(others) or (label == label[0]).all():
        return
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
    found: list[tuple[int, np.ndarray]] = []
    values = np.ascontiguousarray(sig[others].T)
    label = label.copy()
    for at in range(0, len(rows), 64):
        mine = rows[at : at + 64]
        equal = np.zeros((len(mine), len(others)), np.uint8)
        for k in range(VALUES):
            equal += sig[mine, k][:, None] == values[k]
        near = (equal >= LIKELY) & (label[mine][:, None] != label[others]) & (100 * np.minimum(n[mine][:, None], n[others]) >= 75 * np.maximum(n[mine][:, None], n[others]))
        found += [(int(i), others[x]) for i, x in zip(mine, near) if x.any()]
    if not found:
        return
    sets = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
    used = np.unique(np.concatenate([x for _, x in found] + [np.array([i for i, _ in found])]))
    known, codes = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    cuts = np.cumsum([len(sets[i]) for i in used])[:-1]
    coded = dict(zip(used.tolist(), np.split(codes, cuts)))
    held = np.zeros(len(known), bool)
    for i, near in found:
        near = near[label[near] != label[i]]
        if not len(near):
            continue
        held[coded[i]] = True
        both = np.add.reduceat(held[np.concatenate([coded[j] for j in near.tolist()])], np.r_[0, np.cumsum(n[near])[:-1]], dtype=np.int64)
        held[coded[i]] = False
        for j in near[100 * both >= 75 * (n[i] + n[near] - both)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(min(int(ids[i]), int(ids[j])))
                b.append(max(int(ids[i]), int(ids[j])))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not read. Null and wordless texts have 0
    shingles and link with nothing, equal sets always link, a row without doc_id stands alone (component_id null, kept
    true), a repeated doc_id gives its row each time and links by any of its texts. Very long texts are shingled whole; a
    task holds a batch of them. Ties do not matter: a component is named by its smallest doc_id. No rows give no rows.
    """
    marks = stage(_signatures(docs), "signatures")
    known = marks.where("same is not null and doc_id is not null")
    reps = known.groupBy("same").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x")).select("same", F.col("x.doc_id").alias("rep"), "x.n", "x.sig")
    reps = stage(reps, "reps")
    regions, full = _regions(reps)
    regions = regions.join(reps.select("rep", "n", "sig"), "rep").select("region", "first", "rep", "n", "sig")
    regions = stage(regions, "regions")
    crowd = regions.where("first is not null and first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    tried = stage(_by_region(regions.drop("first"), "a long, b long", _stars).union(crowd).distinct(), "pairs")
    ends = tried.select(F.col("a").alias("doc_id")).union(tried.select("b")).union(full.select("rep")).distinct()

    def setup():
        return lambda doc_id, text: [(doc_id, shingles(text).tobytes())]

    ends = stage(ends, "ends")
    # Distinct before the sets are made: the join has dealt the rows by doc_id already, and texts are shorter than sets.
    wanted = docs.select("doc_id", "text").join(ends, "doc_id", "left_semi").select("doc_id", "text").distinct()
    sets = stage(map_rows(wanted, "rep long, set binary", setup), "sets")
    links = stage(_links(tried, sets), "links")
    first = components(links)
    named = regions.drop("first").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    more = _by_region(named.select("region", "rep", "n", "sig", "label"), "a long, b long", _between).distinct().join(tried, ["a", "b"], "left_anti")
    late = stage(_links(stage(more, "more"), sets), "late")
    first = _joined(first, late)
    signed = sets.join(reps.select("rep", "sig"), "rep")
    first = _joined(first, _crowds(full, first, reps, signed))
    same = reps.select("same", "rep")
    out = marks.select("doc_id", "n", "same").join(same, "same", "left")
    out = out.join(first.select(F.col("node").alias("rep"), "label"), "rep", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))
