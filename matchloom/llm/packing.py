"""Packing of token sequences by length patterns.

Documents are tokenised and cut to pieces of at most the capacity. The histogram of piece lengths, of at most ``capacity``
rows, goes to the driver. Patterns of two or three lengths that fill a sequence exactly get repeat counts by non-negative
least squares against the histogram; the counts are rounded down to what the histogram holds, and the rest is packed best
fit, longest first, on counts of equal lengths. The plan is a list of patterns with counts, so its size doesn't follow the
corpus. Pieces find their place by their rank among those of equal length, which two levels of counts give without a
global sort: within a fixed number of hash buckets, and over the buckets. Pieces that fill a sequence need no rank.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.llm.common import give_back, map_rows, stage

CAPACITY = 1024
END = 2
#: Buckets in which pieces of equal length are ranked.
BUCKETS = 512
CACHE, CHECKED = 50_000, 5_000
#: Fixed value: the expression that byte-level pre-tokenization splits by.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class could differ between libraries: odd blanks, numbers that aren't digits, marks, rare scripts.
_ODD = re.compile("[^\n\r\t\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0370-\u03ff\u0400-\u0481\u4e00-\u9fa5]")
#: A blank after a character that is white space in no library's view.
_AFTER_BLANK = re.compile("[\\s\u180e\u200b\u2060\ufeff][ \\n\\r\\t]")
_BEFORE_BLANK = re.compile("(?<=[^\\s\u180e\u200b\u2060\ufeff])(?=[ \\n\\r\\t])")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_blanks(tokenizer) -> bool:
    """Whether the file's own settings make a blank after a visible character the start of a new word in any text.

    So it is for byte-level pre-tokenization with its regular expression, without a normalizer, a prefix space, truncation
    or dropout.
    """
    said = json.loads(tokenizer.to_str())
    pre = said["pre_tokenizer"] or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
    return bool(byte_level and plain and said["model"].get("type") == "BPE" and not said["model"].get("dropout"))


def split_at_blanks(text: str) -> list[str]:
    """The text cut before each blank that follows a visible character."""
    if "\0" in text or _AFTER_BLANK.search(text):
        return _BEFORE_BLANK.split(text)
    # Every blank but one at the start follows a visible character.
    for blank in " \n\r\t":
        text = text.replace(blank, "\0" + blank)
    words = text.split("\0")
    return words if words[0] else words[1:]


def as_ranks(tokenizer):
    """The tokenizer's vocabulary as ranks for tiktoken, or None where that could give other ids.

    The file's settings must split at blanks, its merges must make its tokens in the order of their ids, and every token of
    more than one byte must come from a merge.
    """
    import tiktoken

    said = json.loads(tokenizer.to_str())["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said.get("merges", [])]
    odd = any(said.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = {w: i for w, i in said["vocab"].items() if w not in special} if splits_at_blanks(tokenizer) else {}
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    singles = {w for w in vocabulary if len(w) == 1}
    if odd or len(singles) != 256 or made != sorted(set(made)) or len(made) + 256 != len(vocabulary) or made[0] <= max(vocabulary[w] for w in singles):
        return None
    # Byte-level files show a byte as itself where it is visible in Latin-1, and the others as characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return tiktoken.Encoding("same", pat_str=_BYTE_LEVEL, mergeable_ranks={bytes(byte[c] for c in w): i for w, i in vocabulary.items()}, special_tokens={})


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian 32-bit bytes, equal to those of the tokenizers library.

    Words repeat, so a text is cut before its blanks, where no token reaches over, and the ids of each word are kept in two
    generations of bounded size. A text's new words are encoded as one string, and its ids are dealt back to the words by
    the bytes of each token. Where ``as_ranks`` finds the file's merges to be ranks, the faster tiktoken encodes new words of
    characters whose class no two libraries doubt; a worker compares its first CHECKED of them with tokenizers and leaves
    tiktoken for good if any differ. Texts that hold a special token are encoded whole by tokenizers, as are all texts if the
    file's settings don't split at blanks.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.cuts, self.ranks, self.checked = splits_at_blanks(self.tokenizer), as_ranks(self.tokenizer), 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # A byte-level token has a character for each of its bytes.
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(w) for w in vocabulary]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _new(self, text: str, words: int) -> bytes:
        if self.ranks is None or _ODD.search(text):
            return self._whole(text)
        ids = np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
        if self.checked < CHECKED:
            self.checked += words
            right = self._whole(text)
            if right != ids:
                self.ranks = None
            return right
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return self._whole(text)
        words, young, old = split_at_blanks(text), self.young, self.old
        new = [w for w in dict.fromkeys(words) if w not in young]
        if new:
            young.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in young]
        if new:
            # All but a text's first word begin with a blank, and all but its last end with a visible character.
            ids = self._new("".join(new), len(new))
            ends = np.cumsum(self.bytes_of[np.frombuffer(ids, "<u4")])
            at = 0
            for w, to in zip(new, (4 * np.searchsorted(ends, np.cumsum([len(w.encode()) for w in new])) + 4).tolist()):
                young[w], at = ids[at:to], to
        out = b"".join([young[w] for w in words])
        if len(young) > CACHE:
            self.old, self.young = young, {}
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a worker process, so that what it knows of words outlives a task."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids of each piece of each row of ``docs`` (doc_id, text).

    A document is its ids and then ``end``; a null text is empty. Only longer ones are cut, the first piece being the short
    one, so that all others fill a sequence.
    """

    def setup():
        encode, last = encoder(path), int(end).to_bytes(4, "little")

        def one(doc_id, text):
            ids = encode(text or "") + last
            n, at, k, out = len(ids) // 4, 0, 0, []
            size = n if n <= capacity else n % capacity or capacity
            while at < n:
                part = ids[4 * at : 4 * (at + size)]
                row = (doc_id, k, at, size, zlib.crc32(part))
                out.append((*row, np.frombuffer(part, "<u4").tolist()) if with_ids else row)
                at, k, size = at + size, k + 1, capacity
            return out

        return one

    more = ", ids array<long>" if with_ids else ""
    return map_rows(docs.select("doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long" + more, setup)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths out of ``lengths``, zeros last, that add up to ``capacity``."""
    have = np.zeros(capacity + 1, bool)
    have[lengths[lengths < capacity]] = True
    out = []
    for a in np.flatnonzero(have):
        b = np.flatnonzero(have[: a + 1])
        c = capacity - a - b
        keep = (c >= 0) & (c <= b)
        b, c = b[keep], c[keep]
        keep = (c == 0) | have[c]
        if keep.any():
            out.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def nnls(pattern: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises the weighted squared distance of the patterns' lengths from the histogram.

    Accelerated projected gradient; the matrix has three ones a column, so products are gathers and sums. Long pieces weigh
    more, since short ones find a place anyway.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / (size - 1))
    weight[0] = 0
    target = weight * histogram

    def times(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(pattern[:, k], x, size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return r[pattern[:, 0]] + r[pattern[:, 1]] + r[pattern[:, 2]]

    v = np.ones(len(pattern))
    for _ in range(12):
        v = back(times(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * np.linalg.norm(back(times(v))) + 1e-12)
    x = y = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold each length exactly as often as the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    pattern = patterns(np.flatnonzero(left), capacity)
    if len(pattern):
        x = nnls(pattern, left.astype(float))
        for p in np.argsort(-x, kind="stable"):
            times = int(x[p] + 1e-6)
            if not times:
                break
            parts = [int(v) for v in pattern[p] if v]
            times = min(times, *(int(left[v]) // parts.count(v) for v in parts))
            if times:
                out.append((tuple(parts), times))
                for v in parts:
                    left[v] -= times
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences of equal content are handled together."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        todo = int(left[size])
        while todo:
            r = next((r for r in range(size, capacity + 1) if room[r]), None)
            if r is None:
                new = -(-todo // (capacity // size))
                room[capacity - size][(size,)] = room[capacity - size].get((size,), 0) + new
                todo -= new
                continue
            content, n = next(iter(room[r].items()))
            take = min(n, todo)
            if take == n:
                del room[r][content]
            else:
                room[r][content] = n - take
            into, grown = room[r - size], (*content, size)
            into[grown] = into.get(grown, 0) + take
            todo -= take
    return [(content, n) for r in room for content, n in r.items()]


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32 and more, none of them named at, bucket, own or before) with sequence_id and offset.

    A piece that fills a sequence gets one of its own, with a negative number, without a shuffle. The others are dealt by
    their place in the staged table into BUCKETS buckets; the table of counts by bucket and length has at most BUCKETS x
    (capacity - 1) rows of 24 bytes, 12 MB at 1024 tokens, however large the corpus is, and no length is ranked in one task.
    """
    cut = stage(cut.withColumn("at", F.monotonically_increasing_id()), "pieces")
    own = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("at")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(BUCKETS)).cast("int"))
    counts = stage(rest.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, base, offsets, taken, sequence = [], [], [], dict.fromkeys(histogram, 0), 0
    for content, n in plan(histogram, capacity):
        at = 0
        for size in content:
            keys.append((size << 44) + taken[size])
            base.append(sequence - taken[size])
            offsets.append(at)
            taken[size] += n
            at += size
        sequence += n
    order = np.argsort(np.array(keys, np.int64)) if keys else []
    keys, base, offsets = (np.array(x, np.int64)[order] if len(x) else np.zeros(0, np.int64) for x in (keys, base, offsets))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(counts.select("bucket", "length", before.alias("before")), "before")
    rank = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("at"))
    ranked = rest.withColumn("own", rank).join(counts, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before")
    return _look_up(ranked, keys, base, offsets).unionByName(own).drop("at")


def _look_up(ranked: DataFrame, keys: np.ndarray, base: np.ndarray, offsets: np.ndarray) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql import types as T

    rest = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*rest, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            rank, length = t.column("rank").to_numpy(), t.column("length").to_numpy()
            k = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(base[k] + rank)).append_column("offset", pa.array(offsets[k]))
            yield from t.to_batches()
        give_back()

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. No rows give no rows; null and empty texts are their end
    token; a repeated row is packed each time; a null doc_id is packed like any other. Long texts are encoded whole, one at
    a time, and cut by tokens.
    """
    return place(pieces(docs, path, capacity, end, with_ids), capacity)
