"""Secret scan with a linear-chain conditional random field over base patterns.

Base patterns give spans of three kinds. Beside them a CRF tags the tokens of a text as secret begin (B), inside (I) or
outside (O) from token shape, neighbouring words and file features, and adds the spans that no base pattern overlaps. It is
trained here on windows of a bounded sample of texts. Gold labels are the base spans, and secrets of many other forms that
are planted into ordinary windows, beside planted numbers, dates, names and paths that are no secrets.

Every token of a text takes part. A token whose score as O is above the others by more than all transitions could make up
for is O in the best path whatever stands around it, so Viterbi runs on the stretches between such tokens; that is exact.
Punctuation marks are never part of a secret by themselves.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.llm.common import give_back, map_rows, stage

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
#: Bounds of the fit: texts, windows of each kind that a text gives, windows in training, tokens of a window, steps.
SAMPLE_TEXTS, WINDOWS_OF_TEXT, WINDOWS, WINDOW, STEPS = 1_000, 2, 2_000, 20, 60
#: Words whose scores a worker keeps.
CACHE, LONG_WORD = 100_000, 64
_TOKEN = re.compile(r"[\w+/\-]+(?:\.[\w+/\-]+)*=*|[^\w\s]")
_CREDENTIAL = ("pass", "secret", "token", "key", "auth", "cred", "login", "bearer", "sign")
_PREFIXED = re.compile(r"[A-Za-z]{2,6}[_-](?=[\w\-]{12,})")
_NUMERIC = re.compile(r"[\d.,:/+\-=]+")
_FILE_MARKS = re.compile(r"[=:;{}()\[\]\"']")
_O, _B, _I = range(3)
#: Codes of bytes for the table of neighbouring characters: letters without case, digits, the other ASCII, all else; 29, of a line break or of a mark within tokens, is a word's edge.
_CODE = bytes(c - 97 if 97 <= c < 123 else c - 65 if 65 <= c < 91 else 26 if 48 <= c < 58 else 27 if c < 128 else 28 for c in range(256))
_EDGE, _CODES = 29, 30
_CODE = bytes(_EDGE if chr(b) in "\n/._-+=" else c for b, c in enumerate(_CODE))
_ODD_STEPS = (1.8, 2.2, 2.6, 3.0, 3.4, 3.8, 4.2, 4.6, 5.0)
_SIZES = (4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns in order, kinds as numbered in KINDS."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


# ---- features


def oddness(words: list[str], likely: np.ndarray) -> list[int]:
    """Steps of how unlikely the neighbouring characters of each token's words are, their edges included: 0 for plain words, up to 9."""
    data = "\n".join(["", *words, ""]).encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data.translate(_CODE), np.uint8)
    starts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    sums = np.add.reduceat(likely[codes[:-1], codes[1:]], starts[:-1], dtype=np.float64)
    return np.searchsorted(_ODD_STEPS, -sums / np.diff(starts), side="right").tolist()


def shape(word: str) -> tuple:
    """What the features of a token's characters are made from: classes, and steps of its length, turns, kinds, digits and parts."""
    bare = word.rstrip("=")
    n, alpha = len(bare), bare.isalpha()
    size = bisect_right(_SIZES, n)
    # Classes of characters: lower case, capital, digit, mark of a token, other.
    if alpha and bare.islower():
        mask, turns, digits = "a", 0, 0
    elif alpha and bare[:1].isupper() and bare[1:].islower():
        mask, turns, digits = "aA", 1, 0
    else:
        classes = "".join(["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" if c in "+/_.-=" else "x" for c in bare])
        mask = "".join([c for c in "aA0+x" if c in classes])
        turns, digits = sum(map(str.__ne__, classes, classes[1:])), classes.count("0")
    kinds = bisect_right((4, 7, 10, 13, 20), len(set(bare)))
    share = 0 if not digits else bisect_right((0.15, 0.4, 0.8), digits / n) + 1
    mixed = bisect_right((0.05, 0.15, 0.3, 0.45), turns / max(1, n))
    prefixed = numeric = dots = slashes = 0
    if not alpha:
        prefixed, numeric = int(bool(_PREFIXED.match(bare))), int(bool(_NUMERIC.fullmatch(word)))
        dots, slashes = bisect_right((1, 3), bare.count(".")), bisect_right((1, 2), bare.count("/"))
    return mask, size, bisect_right((1, 2, 4, 8, 16), turns), kinds, share, mixed, prefixed, numeric, dots, slashes


def word_features(of: tuple, odd: int) -> list[str]:
    """Names of the active features of a token by itself, from its ``shape`` and ``oddness``."""
    mask, size, turns, kinds, share, mixed, prefixed, numeric, dots, slashes = of
    out = [f"mask:{mask}", f"size:{size}", f"shape:{mask}:{size}", f"turns:{turns}:{size}", f"kinds:{kinds}:{size}"]
    out += [f"odd:{odd}:{size}", f"odd:{odd}:{mask}", f"digits:{share}:{size}", f"mixed:{mixed}:{odd}"]
    if prefixed:
        out.append(f"prefixed:{odd}")
    if numeric:
        out.append(f"numeric:{size}")
    if dots or slashes:
        out.append(f"parts:{slashes}:{dots}")
    return out


def _of_credentials(lower: str) -> bool:
    return any([x in lower for x in _CREDENTIAL])


def context_class(word: str) -> str:
    """What a token is to its neighbours, besides the word itself."""
    if _of_credentials(word.lower()):
        return "credential=" if word.endswith("=") else "credential"
    if word in "=:":
        return "sign"
    if word in "\"'`":
        return "quote"
    return "mark" if not word[0].isalnum() else "digit" if any(map(str.isdigit, word[:LONG_WORD])) else "word=" if word.endswith("=") else "word"


#: Where a neighbour stands: two words of one class in different places are different features.
PLACES = {"p1": -1, "p2": -2, "p3": -3, "n1": 1}


def file_features(text: str, words: list[str]) -> list[str]:
    """Of the whole text: whether it speaks of credentials, and how many marks of code it has for its words."""
    marks = sum(1 for _ in _FILE_MARKS.finditer(text))
    return [f"file:credential:{_of_credentials(text.lower())}", f"file:marks:{bisect_right((0.02, 0.1, 0.3), marks / max(1, len(words)))}"]


# ---- the model


class Crf:
    """Weights of a three-label chain by feature name. Tokens around the text are O."""

    def __init__(self, likely: np.ndarray | None = None):
        self.likely = np.zeros((_CODES, _CODES), np.float32) if likely is None else likely
        self.emit: dict[str, np.ndarray] = {}
        #: move[x, y]: from label x to label y; nothing goes from outside to inside.
        self.move = np.zeros((3, 3))
        self.move[_O, _I] = -1e9
        self._forget()

    def _forget(self) -> None:
        self.ids, self.used, self.shapes, self.classes = {}, 0, {}, {"edge": 0}
        self.known = {f[3:] for f in self.emit if f[2:3] == "="}
        self.own, self.of = np.zeros((1024, 3)), np.zeros(1024, np.int32)
        self.near = {p: np.zeros((64, 3)) for p in PLACES}
        for p in PLACES:
            self.near[p][0] = self._sum([f"{p}:edge"])

    def __getstate__(self):
        return {"likely": self.likely, "emit": self.emit, "move": self.move}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _sum(self, names: list[str]) -> np.ndarray:
        return sum((self.emit[f] for f in names if f in self.emit), np.zeros(3))

    def _learn(self, words: list[str]) -> list[int]:
        """The places of new words' own scores and of their classes as neighbours."""
        first = self.used
        self.used += len(words)
        while self.used > len(self.own):
            self.own, self.of = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.of, np.zeros_like(self.of)])
        for i, (word, odd) in enumerate(zip(words, oddness(words, self.likely)), first):
            if len(word) == 1 and not word.isalnum():
                self.own[i] = (0, -1e6, -1e6)
            else:
                key = (*shape(word), odd)
                if key not in self.shapes:
                    self.shapes[key] = self._sum(word_features(key[:-1], odd))
                self.own[i] = self.shapes[key]
            self.of[i] = self._class(word)
            if len(word) <= LONG_WORD:
                self.ids[word] = i
        return list(range(first, self.used))

    def _class(self, word: str) -> int:
        name, lower = context_class(word), word.lower()
        key = f"{name}={lower}" if lower in self.known else name
        if key not in self.classes:
            c = self.classes[key] = len(self.classes)
            for p in PLACES:
                if c >= len(self.near[p]):
                    self.near[p] = np.concatenate([self.near[p], np.zeros_like(self.near[p])])
                self.near[p][c] = self._sum([f"{p}:{name}"] + [f"{p}={lower}"] * (lower in self.known))
        return self.classes[key]

    def scores(self, words: list[str], file: list[str]) -> np.ndarray:
        """A row of label scores for each token."""
        if self.used > CACHE:
            self._forget()
        ids = self.ids
        new = list(dict.fromkeys(w for w in words if w not in ids))
        fresh = dict(zip(new, self._learn(new))) if new else {}
        at = np.array([ids[w] if w in ids else fresh[w] for w in words], np.int64)
        out, c = self.own[at] + self._sum(file), self.of[at]
        for p, d in PLACES.items():
            neighbour = np.zeros(len(c), np.int32)
            if d < 0:
                neighbour[-d:] = c[:d]
            else:
                neighbour[:-d] = c[d:]
            out += self.near[p][neighbour]
        return out

    def slack(self, scores: np.ndarray) -> np.ndarray:
        """For each token, how much the labels around it can gain at most where it is not O.

        If a path has B or I at a token, O in its place is allowed once an I that follows becomes B. That changes the two
        transitions of the token, the score of the next token and the transition after it.
        """
        m = self.move
        turned = max(m[x, y] + m[y, z] - m[x, _O] - m[_O, _B if z == _I else z] for x in range(3) for y in (_B, _I) for z in range(3) if m[x, y] > -1e8)
        after = max(0.0, *(m[_I, z] - m[_B, z] for z in range(3)))
        follow = np.zeros(len(scores))
        follow[:-1] = np.maximum(0, scores[1:, _I] - scores[1:, _B])
        return turned + after + follow

    def labels(self, words: list[str], file: list[str]) -> list[tuple[int, list[int]]]:
        """(first token, labels) of each stretch of tokens that can be other than O; all others are."""
        if not self.emit or not words:
            return []
        s = self.scores(words, file)
        open_ = np.flatnonzero(s[:, _O] - s[:, 1:].max(axis=1) <= self.slack(s) + 1e-9)
        return [(int(run[0]), self.viterbi(s[run[0] : run[-1] + 1])) for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(run)]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best path between two tokens that are O."""
        m = self.move.tolist()
        best, back = [0.0, -1e9, -1e9], []
        for s in scores.tolist():
            row = [max(range(3), key=lambda x: best[x] + m[x][y]) for y in range(3)]  # noqa: B023
            best = [best[row[y]] + m[row[y]][y] + s[y] for y in range(3)]
            back.append(row)
        y = max(range(3), key=lambda x: best[x] + m[x][_O])
        out = []
        for row in reversed(back):
            out.append(y)
            y = row[y]
        return out[::-1]

    def train(self, windows: list[dict], steps: int = STEPS, decay: float = 1.0, rate: float = 0.06) -> Crf:
        """Maximise the log-likelihood, less ``decay`` times half the squared weights, by Adam on all windows at once.

        A window has ``tokens`` (lists of feature names) and ``gold`` (labels).
        """
        n, long = len(windows), max(len(w["gold"]) for w in windows)
        names = {f: i + 1 for i, f in enumerate(sorted({f for w in windows for t in w["tokens"] for f in t}))}
        wide = max(len(t) for w in windows for t in w["tokens"])
        at = np.zeros((n, long, wide), np.int32)
        gold, there = np.zeros((n, long), np.int64), np.zeros((n, long), bool)
        for i, w in enumerate(windows):
            for j, t in enumerate(w["tokens"]):
                at[i, j, : len(t)] = [names[f] for f in t]
            gold[i, : len(w["gold"])] = w["gold"]
            there[i, : len(w["gold"])] = True
        weights, move = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
        wall = np.zeros((3, 3))
        wall[_O, _I] = -1e9
        hot = np.eye(3)[gold] * there[..., None]
        before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
        # Behind the last token the chain goes on as O, without features: padding has the scores (0, -1e9, -1e9).
        steps_gold = np.zeros((3, 3))
        np.add.at(steps_gold, (before.ravel(), gold.ravel()), 1)
        np.add.at(steps_gold, (gold[:, -1], _O), 1)
        flat = at.ravel()
        m1, m2 = [np.zeros_like(weights), np.zeros_like(move)], [np.zeros_like(weights), np.zeros_like(move)]
        for step in range(1, steps + 1):
            s = weights[at].sum(axis=2)
            s[~there] = (0, -1e9, -1e9)
            a = move + wall
            f = np.empty((long, n, 3))
            f[0] = a[_O] + s[:, 0]
            for t in range(1, long):
                f[t] = _lse(f[t - 1][:, :, None] + a, 1) + s[:, t]
            b = np.zeros((long, n, 3))
            b[-1] = a[:, _O]
            for t in range(long - 2, -1, -1):
                b[t] = _lse(a + (s[:, t + 1] + b[t + 1])[:, None, :], 2)
            z = _lse(f[-1] + b[-1], 1)
            p = np.exp(f + b - z[:, None]).transpose(1, 0, 2)
            grown = (hot - p * there[..., None]).reshape(-1, 3)
            each = np.repeat(grown, wide, axis=0)
            g = np.stack([np.bincount(flat, each[:, y], len(weights)) for y in range(3)], axis=1) - decay * weights
            g[0] = 0
            moved = steps_gold.copy()
            moved[_O] -= p[:, 0].sum(axis=0)
            moved[:, _O] -= p[:, -1].sum(axis=0)
            for t in range(1, long):
                moved -= np.exp(f[t - 1][:, :, None] + a + (s[:, t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            for k, (x, d) in enumerate(((weights, g), (move, moved - decay * move))):
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                x += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        self.emit = {f: weights[i] for f, i in names.items() if np.abs(weights[i]).max() > 1e-3}
        self.move = move + wall
        self._forget()
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


# ---- training windows


#: What a planted secret stands behind, and words that stand behind planted values that are no secrets.
LEADS = ("auth = ", "AUTH: ", "access key ", "access code: ", "the key: ", "key is ", "login ", "credentials: ", "signing key ", "private key = ", "X-Auth: ", "header: Token ", "pass ", "use ", "the ", "", "", '"', "= ", ": ", "id ", "and ")
PLAIN_LEADS = ("on ", "at ", "see ", "from ", "number ", "version ", "file ", "call ", "id ", "", "", "the ", "of ", "= ", ": ", "key ", "password ", "the token ", "a secret ", "the key ")


def _planted(r: random.Random, letters: list[str]) -> str:
    """A secret of a random form."""
    of = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    alnum = string.ascii_letters + string.digits
    lower, upper = string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits
    form = r.randrange(9)
    if form == 0:
        return of(alnum, 18, 64)
    if form == 1:
        return of(lower, 20, 48)
    if form == 2:
        return of(upper, 16, 40)
    if form == 3:
        return of(alnum + "+/", 24, 64) + "=" * r.randrange(3)
    if form == 4:
        return of(string.ascii_lowercase, 2, 6) + r.choice("_-") + of(alnum, 16, 44)
    if form == 5:
        return of(string.ascii_lowercase, 2, 5) + r.choice("_-") + of(string.ascii_lowercase, 2, 5) + r.choice("_-") + of(r.choice([alnum, lower]), 16, 40)
    if form == 6:
        return of(string.ascii_letters, 18, 44)
    if form == 7:
        return ".".join(of(alnum + "_-", 12, 40) for _ in range(3))
    return r.choice(["-", " "]).join(of(upper, 5, 6) for _ in range(r.randint(3, 5)))


def _harmless(r: random.Random, letters: list[str]) -> str:
    """A value that could be taken for a secret but is none."""
    n = lambda k: str(r.randrange(10 ** (k - 1), 10**k))
    w = lambda: r.choice(letters)
    return r.choice(
        [
            f"20{n(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
            f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
            n(r.randint(5, 15)),
            f"+{n(2)} {n(3)} {n(4)} {n(4)}",
            f"{n(3)}.{n(2)}.{n(1)}.{n(3)}",
            f"v{n(1)}.{n(2)}.{n(1)}",
            f"{w()}{n(2)}@{w()}.example.com",
            f"https://{w()}.example.org/{w()}/{w()}-{n(3)}.html",
            f"/{w()}/{w()}/{w()}.{w()[:3]}",
            f"{w()}_{w()}_{n(1)}",
            f"{w()}-{w()}-{w()}",
            w().title() + w().title() + w().title(),
            w().upper() + "-" + n(4),
            w() + w() + w(),
            w().upper(),
            w(),
        ]
    )


def _window(text: str, words: list[str], at: list[tuple[int, int]], gold: list[tuple[int, int]], lo: int, hi: int, likely: np.ndarray) -> dict:
    """Feature names and labels of the tokens lo to hi of a text; ``gold`` has the secrets' spans."""
    file = file_features(text, words)
    tokens, labels, inside = [], [], -1
    for i in range(lo, hi):
        s, e = at[i]
        hit = next((k for k, (a, b) in enumerate(gold) if a < e and s < b), -1)
        labels.append(_O if hit < 0 else _I if hit == inside and i > lo else _B)
        inside = hit
        names = word_features(shape(words[i]), oddness(words[i : i + 1], likely)[0]) if len(words[i]) > 1 or words[i].isalnum() else []
        for p, d in PLACES.items():
            word = words[i + d] if 0 <= i + d < len(words) else None
            names.append(f"{p}:{context_class(word) if word else 'edge'}")
            if word and len(word) <= 16:
                names.append(f"{p}={word.lower()}")
        tokens.append(names + file)
    return {"tokens": tokens, "gold": labels}


def windows(text: str, likely: np.ndarray) -> list[tuple[int, dict]]:
    """(kind, window) of a text, by its hash: around base spans (0), without any (1), with planted values (2)."""
    r = random.Random(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
    found = list(_TOKEN.finditer(text))
    if not found:
        return []
    words, at = [m.group() for m in found], [m.span() for m in found]
    # Of an assignment the value alone is the secret.
    gold = [m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    gold += [(s, e) for s, e, k in base_spans(text) if k and not any(a < e and s < b for a, b in gold)]
    starts, out = [s for s, _ in at], []
    half = WINDOW // 2
    for s, _ in r.sample(gold, min(len(gold), WINDOWS_OF_TEXT)):
        i = int(np.searchsorted(starts, s, side="right")) - 1
        out.append((0, _window(text, words, at, gold, max(0, i - half), min(len(words), i + half), likely)))
    plain = [w for w in words if len(w) < 12 and w.isalpha()] or ["a"]
    for _ in range(WINDOWS_OF_TEXT):
        i = r.randrange(len(words))
        lo, hi = max(0, i - half), min(len(words), i + half)
        out.append((1, _window(text, words, at, gold, lo, hi, likely)))
        # The same place with a value behind its first half.
        a, cut, b = at[lo][0], at[i][0], at[hi - 1][1]
        secret = r.random() < 0.5
        value, lead = (_planted, _harmless)[not secret](r, plain), r.choice(LEADS if secret else PLAIN_LEADS)
        made = text[a:cut] + lead + value + r.choice(['"', ".", ",", " ", "", ""]) + " " + text[cut:b]
        start = cut - a + len(lead)
        spans_ = [m.span(2) for m in _ASSIGN.finditer(made) if len(m.group(2)) >= 12] + [(s, e) for s, e, k in base_spans(made) if k]
        spans_ = [(s, e) for s, e in spans_ if not (s < start + len(value) and start < e)] if secret else spans_
        if secret:
            spans_.append((start, start + len(value)))
        found_ = list(_TOKEN.finditer(made))
        near = [m.group() for m in found_]
        window = _window(made, near, [m.span() for m in found_], spans_, 0, len(near), likely)
        # File features are those of the whole text.
        own, whole = set(file_features(made, near)), file_features(text, words)
        window["tokens"] = [[f for f in t if f not in own] + whole for t in window["tokens"]]
        out.append((2, window))
    return out


def fit(docs: DataFrame) -> Crf:
    """Train on windows of about SAMPLE_TEXTS texts, taken by a hash of doc_id and text; at most WINDOWS of them.

    Sampled texts are read whole, where they are; windows come to the driver as names of features, so what it holds doesn't
    follow the length of texts or tokens. Without any text the model adds nothing.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    rank = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    sample = stage(docs.where(rank < int(share * (1 << 30)) + 1).select("text").limit(2 * SAMPLE_TEXTS), "sample")

    def pairs():
        def one(text):
            # Each distinct word counts once in a text.
            data = "\n".join(["", *sorted(set(_TOKEN.findall(text))), ""]).encode("utf-8", "surrogatepass").translate(_CODE)
            codes = np.frombuffer(data, np.uint8).astype(np.int64)
            seen, n = np.unique(codes[:-1] * _CODES + codes[1:], return_counts=True)
            return list(zip(seen.tolist(), n.tolist()))

        return one

    got = map_rows(sample, "pair int, n long", pairs).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((_CODES, _CODES))
    for r in got:
        counts[r["pair"] // _CODES, r["pair"] % _CODES] = r["n"]
    likely = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)

    def cut():
        def one(text):
            made = windows(text, likely)
            size = len(text)
            return [(kind, xxhash.xxh32_intdigest(f"{size}:{i}".encode() + text[:64].encode("utf-8", "surrogatepass")), w["tokens"], w["gold"]) for i, (kind, w) in enumerate(made)]

        return one

    rows = map_rows(sample, "kind int, rank long, tokens array<array<string>>, gold array<int>", cut, rows=256)
    rows = rows.orderBy("rank", "gold").limit(WINDOWS).collect()
    data = [{"tokens": r["tokens"], "gold": r["gold"]} for r in sorted(rows, key=lambda r: (r["rank"], r["kind"], r["gold"]))]
    # Words next to a token are features of their own only where they are seen often.
    seen = Counter(f for w in data for t in w["tokens"] for f in set(t) if f[2:3] == "=")
    for w in data:
        w["tokens"] = [[f for f in t if f[2:3] != "=" or seen[f] >= 8] for t in w["tokens"]]
    return Crf(likely).train(data) if data else Crf(likely)


# ---- scanning


def chain_spans(text: str, model: Crf) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the chain's secrets in the whole text, in order."""
    words = _TOKEN.findall(text)
    runs = [(i, y) for i, y in model.labels(words, file_features(text, words) if model.emit else []) if any(y)]
    if not runs:
        return []
    at = [m.span() for m in _TOKEN.finditer(text)]
    out: list[list[int]] = []
    for first, labels in runs:
        for i, y in enumerate(labels, first):
            if y == _B:
                out.append([*at[i], 3])
            elif y == _I:
                out[-1][1] = at[i][1]
    return [tuple(x) for x in out]


def spans(text: str, model: Crf) -> list[tuple[int, int, int]]:
    """Base spans, and those of the chain that overlap none of them, by start and kind."""
    base = base_spans(text)
    more = chain_spans(text, model)
    out, k, reach = list(base), 0, -1
    for s, e, kind in more:
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s:
            out.append((s, e, kind))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


def join(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def scan(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points) for each row of ``docs`` (doc_id, text; other columns are not read).

    A null text is empty and has no spans. Texts are scanned whole. Equal texts have equal spans, a null doc_id stays, a
    repeated row is scanned again; where two labellings are equally good the one with more O wins; no rows give no rows.
    """

    def setup():
        return lambda doc_id, text: [(doc_id, [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans(text or "", model)])]

    return map_rows(docs.select("doc_id", "text"), "doc_id long, spans array<struct<kind string, start int, end int>>", setup)


def redact(docs: DataFrame, model: Crf, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``; overlapping spans become one.

    All other columns stay as they are, whatever their names, and a null text stays null. Rows as in ``scan``.
    """

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s, e, _ in spans(text, model):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    arrow, where = to_arrow_schema(docs.schema), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [one(t) for t in part.column(where).to_pylist()]
                columns = [pa.array(texts, arrow.field(where).type) if i == where else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, model: Crf) -> DataFrame:
    """The scan's digest columns: counts by base kind, SHA-256 of the joined base spans, all spans joined. Rows as in ``scan``."""

    def setup():
        def one(doc_id, text):
            found = spans(text or "", model)
            base = [x for x in found if x[2] < 3]
            n = [sum(x[2] == k for x in base) for k in range(3)]
            return [(doc_id, *n, hashlib.sha256(join(base).encode()).hexdigest(), join(found))]

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", setup)
