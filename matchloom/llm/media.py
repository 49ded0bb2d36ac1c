"""Media columns: texts' bytes as WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's bytes are the samples of a WAV file. Its spectrogram's local maxima, in time and in frequency, are the peaks; each
peak is paired with the next ones a few frames later. A fingerprint is two arrays of equal length: the frame of each pair's
first peak, and a code of both frequencies and their distance in time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from matchloom.llm.common import map_rows

RATE = 8_000
FRAME = 256
HOP = 128
#: A peak is the largest value within so many frames and frequency bins to either side, and at least FLOOR.
FRAMES, BINS, FLOOR = 3, 10, 16.0
#: A peak is paired with the next FAN peaks of later frames, of SPAN frames at most.
FAN, SPAN = 3, 15
#: Bins from which on a constant signal leaves nothing.
LOWEST = 2
_CHUNK = 2_048
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV whose samples are the payload's bytes; an odd payload gets the format's pad byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue() + b"\0" * (len(payload) % 2)


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _frames(samples: np.ndarray) -> np.ndarray:
    n = -(-max(0, len(samples) - FRAME) // HOP) + 1
    padded = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
    padded[: len(samples)] = samples
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]


def spectrogram(frames: np.ndarray) -> np.ndarray:
    """Magnitudes by frame and frequency bin, of bins from LOWEST on."""
    return np.abs(np.fft.rfft((frames.astype(np.float32) - np.float32(128)) * _WINDOW, axis=1))[:, LOWEST:].astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectrogram's local maxima in order; of equal values next to each other the first counts.

    Frames are transformed a chunk at a time, with FRAMES more on either side, so memory doesn't follow the length.
    """
    frames, times, bins = _frames(samples), [], []
    for at in range(0, len(frames), _CHUNK):
        lo, hi = max(0, at - FRAMES), min(len(frames), at + _CHUNK + FRAMES)
        x = spectrogram(frames[lo:hi])
        n, width = x.shape
        edged = np.zeros((n, width + 2 * BINS), np.float32)
        edged[:, BINS:-BINS] = x
        left, right = edged[:, :width].copy(), edged[:, 2 * BINS :].copy()
        for d in range(1, BINS):
            np.maximum(left, edged[:, d : d + width], out=left)
            np.maximum(right, edged[:, BINS + d : BINS + d + width], out=right)
        found = (x > left) & (x >= right) & (x >= FLOOR)
        around = np.maximum(np.maximum(left, right), x)
        for d in range(1, FRAMES + 1):
            found[d:] &= x[d:] > around[:-d]
            found[:-d] &= x[:-d] >= around[d:]
        t, b = np.nonzero(found[at - lo : at - lo + _CHUNK])
        times.append(t + at)
        bins.append(b + LOWEST)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes), 32-bit, in order of the pairs' peaks: code = first bin << 20 | second bin << 10 | frames between."""
    t, b = peaks(samples)
    first = np.searchsorted(t, t, side="right")
    other = first[:, None] + np.arange(FAN)
    valid = other < np.searchsorted(t, t + SPAN, side="right")[:, None]
    i, j = np.nonzero(valid)[0], other[valid]
    return t[i].astype(np.int32), (b[i] << 20 | b[j] << 10 | (t[j] - t[i])).astype(np.int32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes followed by zeros up to a positive multiple of 64, and the number of bytes before them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media (WAV), times and codes (arrays) of each row of ``docs`` (doc_id, text; other columns are not read).

    A null text is empty: 64 samples. Long texts are one WAV each, so they must stay below Spark's 2 GB. A null doc_id stays,
    a repeated row is encoded again, equal texts give equal values; no rows give no rows.
    """

    def setup():
        def one(doc_id, text):
            media = to_wav(payload_of(text)[0])
            return [(doc_id, media, *fingerprint(np.frombuffer(from_wav(media), np.uint8)))]

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, media binary, times array<int>, codes array<int>", setup, rows=256)


def digest(docs: DataFrame) -> DataFrame:
    """Digests of what ``encode`` gives for each row, in one pass, and the time-coded arrays. Rows as there.

    ``feature`` is the number of pairs and the SHA-256 of both arrays as little-endian 32-bit integers, times first.
    """

    def setup():
        def one(doc_id, text):
            payload, n = payload_of(text)
            media = to_wav(payload)
            back = from_wav(media)
            t, c = fingerprint(np.frombuffer(back, np.uint8))
            feature = f"{len(t)}:{hashlib.sha256(t.astype('<i4').tobytes() + c.astype('<i4').tobytes()).hexdigest()}"
            return [(doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, t, c)]

        return one

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"
    return map_rows(docs.select("doc_id", "text"), schema, setup)
