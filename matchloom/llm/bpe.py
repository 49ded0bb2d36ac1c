"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame

from matchloom.llm.common import map_rows

#: Texts above this many characters are encoded in parts of about this size.
LONG = 100_000
#: A place between matches of the pattern that comes with the rank files: none of its alternatives has a visible character
#: before white space.
BEFORE_BLANK = r"(?<=[^\s\x1c-\x1f])(?=[\x20\n])"


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank), one per worker process."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = LONG, boundary: str | None = BEFORE_BLANK) -> list[str]:
    """Cuts a long text at places where ``boundary`` matches nothing between two characters: none of the pattern's matches may
    reach over such a place. Without a boundary the text stays whole."""
    if len(text) <= size or boundary is None:
        return [text]
    out, at, cut = [], 0, re.compile(boundary)
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(enc: tiktoken.Encoding, text: str, boundary: str | None = BEFORE_BLANK) -> list[int]:
    return [i for p in parts(text, boundary=boundary) for i in enc.encode_ordinary(p)]


def tokenize(docs: DataFrame, rank_file: str, pattern: str, boundary: str | None = BEFORE_BLANK) -> DataFrame:
    """doc_id and its token ids (array of int) for each row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts give an empty array. Texts are encoded whole, long ones in parts cut at ``boundary``; with another
    pattern than that of the rank files give one that holds for it, or None. A null doc_id stays, a repeated row is
    encoded again, no rows give no rows.
    """

    def setup():
        enc = encoding(rank_file, pattern)
        return lambda doc_id, text: [(doc_id, encode(enc, text or "", boundary))]

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids array<int>", setup, rows=512)


def detokenize(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of its ids, which need not be valid UTF-8; a null array gives no bytes. Rows as in ``tokenize``."""

    def setup():
        enc = encoding(rank_file, pattern)
        return lambda doc_id, ids: [(doc_id, enc.decode_bytes(ids or []))]

    return map_rows(tokens.select("doc_id", "ids"), "doc_id long, data binary", setup, rows=512)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, boundary: str | None = BEFORE_BLANK) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them, in one pass over ``docs``; rows as in ``tokenize``."""

    def setup():
        enc = encoding(rank_file, pattern)

        def one(doc_id, text):
            ids = encode(enc, text or "", boundary)
            packed = np.array(ids, "<u4").tobytes()
            return [(doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest())]

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", setup)
