"""Language identification by compression.

For every language a zstandard raw-content dictionary is filled from a bounded sample of labelled texts. A text is
compressed with each dictionary, and the language whose dictionary gives the smallest output wins. One compression of few
bytes gives sizes that differ by a byte or two, so every text is compressed in as many rotations by words as fill PROBE
bytes, one at least, and the mean size counts; that resolves fractions of a byte. A text is rejected when the second
language needs no more than ``margin`` x its size beyond the first, less for short texts (half at HALF bytes), or when it
holds no letter at all. ``fit`` learns the margin from its sample: each half is identified with dictionaries of the other
one, and the margin is the one that would reject REJECTED of the texts identified rightly.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm.common import map_rows

#: Bounds of the fit: texts asked for per language, characters of each text (in SLICES places of the whole of it), bytes of
#: each dictionary.
SAMPLE_TEXTS = 250
SAMPLE_CHARS, SLICES = 2_000, 4
DICTIONARY_BYTES = 300_000
LEVEL = 6
PROBE, HALF = 2_048, 400
UNKNOWN = "und"
#: Share of rightly identified training texts that the margin may reject, and the largest margin.
REJECTED = 0.002
MOST_MARGIN = 0.02
_BETWEEN = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-cased words with single spaces: capitals, digits and marks say little about the language."""
    return _BETWEEN.sub(" ", text.lower())


class Dictionaries(dict):
    """Dictionaries by language, and the margin learned with them."""

    margin = 0.0


def fit(train: DataFrame, texts: int = SAMPLE_TEXTS) -> Dictionaries:
    """Dictionaries by language, and their margin, from (doc_id, text, lang) rows.

    About ``texts`` texts of each language are taken by a hash of doc_id, after a count of all rows by language. Of a text
    SAMPLE_CHARS characters go in, in slices that are spread evenly over the whole of it, so the driver sees a bounded sample
    in which no opening that many texts share stands for the rest. Null texts, texts without a letter and null languages are
    ignored; repeated rows count as often as they come; no rows give no language.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Dictionaries()
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * texts / n))])
    rank = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    picked = train.where(rank < F.element_at(shares, F.col("lang")) * (1 << 20))
    picked = picked.select("lang", rank.alias("rank"), F.col("doc_id"), _slices("text").alias("text"))
    rows = picked.orderBy("rank", "doc_id", "text").limit(2 * texts * len(counts)).collect()
    rows = [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (-r["rank"], str(r["doc_id"]), r["text"]))]
    out = Dictionaries(_filled(rows))
    out.margin = _margin(rows)
    return out


def _slices(column: str) -> Column:
    """Of longer texts SLICES slices, the first at the start and the last at the end."""
    text, size = F.col(column), SAMPLE_CHARS // SLICES
    room = F.length(text) - size
    parts = [F.substring(text, (F.floor(room * i / (SLICES - 1)) + 1).cast("int"), F.lit(size)) for i in range(SLICES)]
    return F.when(F.length(text) > SAMPLE_CHARS, F.concat_ws(" ", *parts)).otherwise(text)


def _filled(rows: list[tuple[str, str]]) -> dict[str, bytes]:
    out: dict[str, bytearray] = {}
    for lang, text in rows:
        piece = plain(text).encode("utf-8", "surrogatepass") + b" "
        out[lang] = (out.get(lang, bytearray()) + piece)[-DICTIONARY_BYTES:]
    return {k: bytes(v) for k, v in out.items()}


def _margin(rows: list[tuple[str, str]]) -> float:
    """The margin that rejects at most REJECTED of the texts identified rightly by dictionaries of the other half."""
    order: dict[str, int] = {}
    halves: tuple[list, list] = ([], [])
    for lang, text in rows:
        order[lang] = order.get(lang, -1) + 1
        halves[order[lang] % 2].append((lang, text))
    gaps = []
    for known, tried in (halves, halves[::-1]):
        c = Classifier(_filled(known))
        for lang, text in tried:
            best, gap, _ = c.gap(text) if len(c.names) > 1 else (None, 0.0, [])
            if best is not None and c.names[best] == lang:
                gaps.append(gap)
    gaps.sort()
    most = int(REJECTED * len(gaps))
    return min(MOST_MARGIN, gaps[most - 1] if most else gaps[0] / 2) if gaps else 0.0


class Classifier:
    """Compressors of all languages. ``guess`` gives (best language, score, rejected), ``predict`` the same with a rejected text's language as unknown."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float | None = None):
        self.names, self.coders = sorted(dictionaries), []
        self.margin = getattr(dictionaries, "margin", 0.0) if margin is None else margin
        for k in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> tuple[list[float], int]:
        """Mean compressed sizes by language, and the bytes of the text that was compressed."""
        text = plain(text)
        data = [text.encode("utf-8", "surrogatepass")]
        n = len(data[0])
        turns = -(-PROBE // max(1, n))
        if turns > 1:
            words = text.split()
            turns = min(turns, len(words))
            data += [" ".join(words[i:] + words[:i]).encode("utf-8", "surrogatepass") for i in (len(words) * k // turns for k in range(1, turns))]
        return [sum([len(c.compress(x)) for x in data]) / len(data) for c in self.coders], n

    def gap(self, text: str) -> tuple[int, float, list[float]]:
        """The best language's place (of equal ones the first by name), the margin to the second one as ``margin`` counts it, and how much more the others need."""
        sizes, n = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        rest = [s - sizes[best] for i, s in enumerate(sizes) if i != best]
        return best, min(rest, default=0.0) / sizes[best] * (n + HALF) / n, rest

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        lang, score, rejected = self.guess(text)
        return UNKNOWN if rejected else lang, score, rejected

    def guess(self, text: str | None) -> tuple[str, float, bool]:
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        best, gap, rest = self.gap(text)
        score = 1 / (1 + sum(math.exp(-min(60.0, x)) for x in rest))
        return self.names[best], score, bool(rest) and gap <= self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of ``docs`` (doc_id, text; nothing else is read).

    Null texts and texts without a letter are ``und`` with score 0 and are rejected, as is everything when no language
    was learned. Without ``margin`` the one learned by ``fit`` holds. Texts are compressed whole. Equal texts get equal
    results; ties go to the first language by name and are rejected; a null doc_id stays, a repeated row is identified again,
    no rows give no rows.
    """

    def setup():
        c = Classifier(dictionaries, margin)
        return lambda doc_id, text: [(doc_id, *c.guess(text))]

    return map_rows(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, rejected boolean", setup)
