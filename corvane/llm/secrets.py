"""Secret scan: a linear-chain CRF tags tokens as outside, begin or inside of a secret; Viterbi decodes.

Tokens are runs of letters, digits and "+/_-", or single other marks. Their features are shape (length, classes of
letters, how mixed they are), what stands before and after (a key word, an operator, a quote), and the file (does the
text hold key words, does it look like code). The CRF is fitted on the tokens around the base matches and around other
odd tokens (with digits or capitals inside, or long) of at most TRAIN_DOCS texts, half of them texts with a base match
(found over the whole table, however rare), the others without, and of each text at most TRAIN_WINDOWS windows, spread
over all of it. Its labels come from the base patterns; so that it learns what secrets have in common rather than the
patterns, each text with a base match comes again in VARIANTS forms, in which the values are random in other alphabets and
lengths and stand after other key words, operators and quotes.

Decoding is exact. A token whose emission score is below minus the margin of the transitions is outside on every best
path (see Chain.margin), so the text falls apart there. A text isn't decoded only where it has no LEAST characters in a row
without blanks: no span could be that long there. Ties go to outside.

Base matches are always spans. Tagged spans that overlap none are added, under the kind "assign" after a key word, else
"access" (capitals and digits only) or "hex". Null text is read as empty. Texts are read whole, in linear time. Repeated
rows give repeated results, an empty table none. Other columns pass unread. Without any base match in the table there is
nothing to learn from, and only base spans are given.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import map_columns, table, texts
from .crf import FORBIDDEN, Chain

KINDS = ("assign", "access", "hex")
TRAIN_DOCS, TRAIN_WINDOWS, VARIANTS = 1500, 6, 2
#: Shortest run of tokens that is added as a span.
LEAST = 12
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: An assignment has one of these in small letters; looking for them is much faster than for the pattern.
_NAMED = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_KEY = re.compile(r"pass(?:word|wd|phrase)?$|secret|token|api_?key|auth|bearer|credential|private_?key|access_?key|pwd$", re.I | re.A)


def _matches(text: str):
    """(start of the match, number of its kind, start and end of what is secret in it) of the base matches."""
    low = text.lower()
    if any(name in low for name in _NAMED):
        yield from ((m.start(), 0, *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12)
    if "AKIA" in text:
        yield from ((m.start(), 1, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18)
    yield from ((m.start(), 2, *m.span()) for m in _HEX.finditer(text))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    return [(s, KINDS[k], e) for s, k, _, e in sorted(_matches(text), key=lambda m: (m[0], m[1]))]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What is secret in the base matches: the value of an assignment, and the other matches as they are."""
    return [(s, e) for _, _, s, e in _matches(text)]


#: What variants put before values, and the letters that values are made of.
_KEYS = ("password", "passphrase", "secret", "Bearer", "credential", "access_key", "AUTH", "api_key", "pwd", "token")
_LINKS = (" = ", ": ", "=", ":", " ", "': '", '": "')
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789")


def variant(text: str, number: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with other secrets in place of its own, and where they are; the same for the same text and number. Values
    without a key word before them are replaced by such as mix capitals, small letters and digits."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{number}|{text}".encode("utf-8", "surrogatepass")).digest()[:8], "big"))
    out, done, at, where = [], 0, 0, []

    def add(piece: str) -> None:
        nonlocal at
        out.append(piece)
        at += len(piece)

    for start, _, s, e in sorted(_matches(text), key=lambda p: (p[0], -p[3])):
        if start < done:
            continue
        add(text[done:start])
        keyed = s > start or rng.random() < 0.5
        letters = _ALPHABETS[rng.integers(len(_ALPHABETS)) if keyed else rng.integers(1, 4)]
        value = "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(16 if keyed else 20, 80)))
        quote = rng.choice(["", "'", '"'])
        if keyed:
            add(f"{rng.choice(_KEYS)}{rng.choice(_LINKS)}{quote}")
        where.append((at, at + len(value)))
        add(value)
        done = e
        if keyed and text[e : e + 1] not in ("'", '"'):
            add(str(quote))
    add(text[done:])
    return "".join(out), where


# Roles of a neighbour: other, key word, operator, quote, token with a digit, edge of the text.
OTHER, KEY, OPERATOR, QUOTE, DIGIT, EDGE = range(6)
#: Sizes of the fields of a token: length, letter classes, mixture, only hex digits, role two before, before, after, key word within 4 before, text holds key words, text looks like code.
FIELDS = (8, 16, 4, 2, 6, 6, 6, 2, 2, 2)
_OFFSET = np.concatenate([[0], np.cumsum(FIELDS)])
_LENGTHS = (2, 4, 8, 12, 16, 24, 40)
#: Class of each byte: lower, upper, digit, other ("?" stands for what isn't ASCII); and all pairs of different classes.
_CLASS = bytes(b"l"[0] if 97 <= c <= 122 else b"u"[0] if 65 <= c <= 90 else b"D"[0] if 48 <= c <= 57 else b"o"[0] for c in range(256))
_PAIRS = [bytes(p) for p in itertools.permutations(b"luDo", 2)]


def shape(token: str) -> tuple[int, int, int, int, int]:
    """Length bin, classes (lower 1, upper 2, digit 4, other 8), mixture of classes, hex only; and role."""
    n = len(token)
    if token.isascii() and token.isalpha() and token.islower():  # most words
        low, up, dig, other, changes = True, False, False, False, 0
    else:
        kinds = token.encode("ascii", "replace").translate(_CLASS)
        low, up, dig, other = (k in kinds for k in b"luDo")
        changes = sum(map(kinds.count, _PAIRS)) if n > 1 else 0
    role = KEY if _KEY.search(token) else DIGIT if dig else OPERATOR if token in (":", "=") else QUOTE if token in ('"', "'") else OTHER
    return sum(n > e for e in _LENGTHS), low + 2 * up + 4 * dig + 8 * other, min(3, changes * 4 // max(1, n - 1)) if n > 1 else 0, int(n >= 8 and all(c in "0123456789abcdef" for c in token)), role


#: Shape of each number that Shapes gives.
_SHAPES = np.array(list(np.ndindex(*FIELDS[:4], 6)), np.int32)


class Shapes(dict):
    """Number of each token's shape()."""

    def __missing__(self, token: str) -> int:
        length, classes, mixture, hexa, role = shape(token)
        out = (((length * FIELDS[1] + classes) * FIELDS[2] + mixture) * FIELDS[3] + hexa) * 6 + role
        if len(token) < 48:
            if len(self) > 400_000:
                self.clear()
            self[token] = out
        return out


def numbers(text: str, shapes: Shapes) -> np.ndarray:
    return np.array(list(map(shapes.__getitem__, _TOKEN.findall(text))), np.int32)


def around(s: np.ndarray) -> tuple:
    """The fields after those of the token itself: three roles, key word near, text holds key words, looks like code."""
    n, own = len(s), s % 6
    role = np.r_[EDGE, EDGE, own, EDGE].astype(np.int32)
    key = np.r_[np.zeros(4, bool), own == KEY]
    near = key[3 : 3 + n] | key[2 : 2 + n] | key[1 : 1 + n] | key[:n]
    code = np.count_nonzero((own == OPERATOR) | (own == QUOTE)) * 20 > n
    return role[:n], role[1 : n + 1], role[3 : n + 3], near.astype(np.int32), int(key.any()), int(code)


def fields(text: str, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Spans [tokens, 2] and feature numbers [tokens, fields] of a whole text."""
    s = numbers(text, shapes)
    if not len(s):
        return np.empty((0, 2), np.int64), np.empty((0, len(FIELDS)), np.int32)
    cols = [*_SHAPES[s, :4].T, *(np.broadcast_to(c, len(s)) for c in around(s))]
    return np.array([m.span() for m in _TOKEN.finditer(text)], np.int64), np.stack(cols, 1).astype(np.int32) + _OFFSET[:-1].astype(np.int32)


ALLOWED = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)  # outside, begin, inside: no inside after outside


class SecretModel:
    def __init__(self, chain: Chain):
        self.chain, self.cut = chain, -chain.margin()
        self.after = Chain(chain.gain, chain.w, chain.trans, np.array([0.0, FORBIDDEN, FORBIDDEN]))
        # Of a run of tagged tokens, over all of them outside: what one within it gains at most by its transition, and what
        # its edges gain at most beyond that, in the text or at its start or end.
        t, begin = chain.trans - chain.trans[0, 0], float(chain.start[1:].max() - chain.start[0])
        enter, leave = float(t[0, 1:].max()), float(t[1:, 0].max())
        self.inner = float(t[1:, 1:].max())
        self.edges = max(enter, begin) + max(leave, 0.0) - self.inner
        parts = [chain.w[i:j] for i, j in itertools.pairwise(_OFFSET)] if len(chain.w) == _OFFSET[-1] else []
        # The same sums of weights by number of shape, and by field of what stands around.
        self.own = sum(w[_SHAPES[:, i]] for i, w in enumerate(parts[:4]))
        self.rest = parts[4:]

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Labels of tokens with the features x."""
        return self.decoded(self.chain.w[x].sum(1) if len(x) else np.empty(0))

    def decoded(self, score: np.ndarray) -> np.ndarray:
        """Viterbi over the stretches between tokens that are certain to be outside."""
        tags = np.zeros(len(score), np.int8)
        open_ = np.flatnonzero(score >= self.cut)
        if len(open_):
            first = np.flatnonzero(np.r_[True, np.diff(open_) > 1])
            # A stretch in which no run of tagged tokens can score as much as outside stays outside.
            gain = score[open_] + self.inner
            plus, best = np.add.reduceat(np.maximum(gain, 0), first), np.maximum.reduceat(gain, first)
            most = np.where(plus > 0, plus, best) + self.edges
            ends = np.r_[first[1:], len(open_)]
            parts = [(max(0, int(open_[first[k]]) - 1), min(len(score), int(open_[ends[k] - 1]) + 2)) for k in np.flatnonzero(most >= -1e-6)]
            # Where a token before is certain to be outside, the start scores don't apply.
            for chain, some in ((self.chain, [p for p in parts if not p[0]]), (self.after, [p for p in parts if p[0]])):
                for (a, b), got in zip(some, chain.viterbi_all([score[a:b] for a, b in some]), strict=True):
                    tags[a:b] = got
        return tags

    def spans(self, text: str, shapes: Shapes) -> list[tuple[int, int, bool]]:
        """Tagged (start, end, follows a key word)."""
        s = numbers(text, shapes)
        if not len(s):
            return []
        seen = around(s)
        score = self.own[s]
        for w, c in zip(self.rest, seen, strict=True):
            score += w[c]
        tags = self.decoded(score)
        if not tags.any():
            return []
        at = np.array([m.span() for m in _TOKEN.finditer(text)], np.int64)
        out: list[list] = []
        for i in np.flatnonzero(tags):
            if tags[i] == 2 and out and out[-1][3] == i - 1 and at[i, 0] == out[-1][1]:
                out[-1][1], out[-1][3] = int(at[i, 1]), i
            else:
                out.append([int(at[i, 0]), int(at[i, 1]), bool(seen[3][i]), i])
        return [(s, e, k) for s, e, k, _ in out]


def _holding(docs: DataFrame) -> DataFrame:
    """texts(), with an empty text where no span is possible: none is without LEAST marks in a row that aren't blank (Java's
    blanks are among Python's). Such texts needn't reach Python."""
    return texts(docs).withColumn("text", F.when(F.col("text").rlike(rf"\S{{{LEAST}}}"), F.col("text")).otherwise(F.lit("")))


def windows(text: str, secret: list[tuple[int, int]], shapes: Shapes, reach: int = 4, most: int = TRAIN_WINDOWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: the tokens around odd ones, labelled by what is secret; of more than `most`, as many from all over
    the text, half of them with a secret if there are so many. Sequences are cut at 64 tokens or the next that is outside."""
    at, x = fields(text, shapes)
    if not len(at):
        return []
    y = np.zeros(len(at), np.int8)
    for s, e in secret:
        inside = np.arange(np.searchsorted(at[:, 1], s, "right"), np.searchsorted(at[:, 0], e, "left"))
        y[inside] = 2
        y[inside[:1]] = 1
    keep = np.zeros(len(at), bool)
    odd = np.flatnonzero((y > 0) | ((x[:, 1] - _OFFSET[1]) & 4 > 0) | (x[:, 2] > _OFFSET[2]) | (x[:, 0] >= _OFFSET[0] + 4))
    for d in range(-reach, reach + 1):
        keep[np.clip(odd + d, 0, len(at) - 1)] = True
    out = []
    for p in np.split(np.flatnonzero(keep), np.flatnonzero(np.diff(np.flatnonzero(keep)) > 1) + 1):
        a = 0
        while a < len(p):
            b = min(a + 64, len(p))
            while b < len(p) and y[p[b]] == 2:
                b += 1
            out.append((x[p[a:b]], y[p[a:b]]))
            a = b
    with_, without = [w for w in out if w[1].any()], [w for w in out if not w[1].any()]
    n = min(len(with_), max(most // 2, most - len(without)))
    return _spread(with_, n) + _spread(without, most - n)


def _spread(items: list, n: int) -> list:
    return items if len(items) <= n else [items[k] for k in np.linspace(0, len(items) - 1, n).astype(int)]


def strata(docs: DataFrame) -> DataFrame:
    """Table of (key, held) of each row: whether it holds a base match."""
    rows = texts(docs).select(_key().alias("key"), "text")
    return table(map_columns(rows, "key long, held boolean", lambda: lambda key, text: [key, [bool(secret_parts(t)) for t in text]]), "strata")


def _key():
    return F.xxhash64("doc_id", "text", F.lit("secrets"))


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """Texts to fit on: half of `rows` of those with a base match anywhere in the table, the rest of those without."""
    found, half = strata(docs), max(1, rows // 2)

    total = {r.held: r["count"] for r in found.groupBy("held").count().collect()}

    def least(held: bool, n: int) -> DataFrame:
        # Repeated rows count once. A hash threshold leaves some 50 n keys, so that few are shuffled to be told apart.
        share = int(min(1.0, 50 * n / max(1, total.get(held, 0))) * (1 << 30))
        some = found.where((F.col("held") == held) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share))
        return some.select("key").distinct().orderBy("key").limit(n)

    pick = least(True, half).unionAll(least(False, rows - half))
    return texts(docs).withColumn("key", _key()).join(F.broadcast(pick), "key", "left_semi").dropDuplicates(["key"]).select("text")


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> SecretModel | None:
    """None where the table has no base match."""
    sample = sampled(docs, rows)

    def make():
        shapes = Shapes()

        def f(text):
            out = []
            for t in text:
                secret = secret_parts(t)
                out += windows(t, secret, shapes)
                for n in range(VARIANTS if secret else 0):
                    out += windows(*variant(t, n), shapes)
            return [[w[0].astype(np.int16).tobytes() for w in out], [w[1].tobytes() for w in out]] if out else None

        return f

    seqs = Counter((bytes(r.x), bytes(r.y)) for r in map_columns(sample, "x binary, y binary", make).collect())
    # Windows that come again and again, as of copies, count as their square root.
    got = [(np.frombuffer(x, np.int16).astype(np.int32).reshape(-1, len(FIELDS)), np.frombuffer(y, np.int8)) for (x, y), n in sorted(seqs.items()) for _ in range(max(1, round(n**0.5)))]
    if not any((y > 0).any() for _, y in got):
        return None
    return SecretModel(Chain.fit(got, int(_OFFSET[-1]), np.array([0.0, 1.0, 1.0]), ALLOWED, np.array([True, True, False]), steps=150, l2=1e-5))


def all_spans(text: str, base: list[tuple[int, str, int]], model: SecretModel | None, shapes: Shapes) -> list[tuple[int, str, int]]:
    """Base spans and the tagged ones that overlap none of them, in order."""
    out = list(base)
    if model and text:
        taken = ts.Taken([(s, e) for s, _, e in base])
        for s, e, key in model.spans(text, shapes):
            if e - s >= LEAST and taken.free(s, e):
                body = text[s:e]
                out.append((s, "assign" if key else "access" if not any("a" <= c <= "z" for c in body) else "hex", e))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """One row per document; the counts and the digest are those of the base spans."""

    def make():
        shapes = Shapes()

        def f(ids, text):
            rows = []
            for t in text:
                base = base_spans(t)
                n = Counter(k for _, k, _ in base)
                said = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
                rows.append((*map(n.__getitem__, KINDS), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in all_spans(t, base, model, shapes))))
            return [ids, *map(list, zip(*rows, strict=True))]

        return f

    return map_columns(_holding(docs), SCHEMA, make)


def scan(docs: DataFrame, rows: int = TRAIN_DOCS) -> DataFrame:
    return find(docs, train(docs, rows))
