"""Quality rules: base counts of a text, and a linear-chain CRF that marks each line as content or boilerplate.

Lines are the pieces between "\\n" that hold a word. Each line gives a few binned features; a two-label CRF scores line and
transition; Viterbi decoding marks the lines, and the share of words in content lines decides. The CRF is fitted on a
bounded sample of labelled documents (TRAIN_DOCS). Labels are of documents, those of lines are latent: lines begin with
their document's label, but repeats, notices and lines full of symbols as boilerplate; a fit to single lines labels them
anew, then ROUNDS times the chain is fitted and its posteriors label them, always so that a good document keeps half content
and a bad one less than half.

Null text is read as empty; a text without words fails the base rule. Ties of Viterbi go to content. With no usable
labels the CRF says content everywhere, so only the base rule rejects. Repeated rows are judged each, whole texts are read
however long, an empty table gives no rows. Other columns, of any name, pass unread.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textstats as ts
from .common import keep_rows, labelled_sample, map_columns, texts
from .crf import Chain

#: Labelled documents that the CRF is fitted on, at most, and lines of each; of a longer one, a stretch that its hash chooses.
TRAIN_DOCS, TRAIN_LINES = 3000, 400
#: Fits of the chain, each on the lines as the one before labels them.
ROUNDS = 2
#: A text stays if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT = 20, 30
NOTICE = (b"licensed under", b"all rights reserved", b"copyright", b"cookie", b"terms of use", b"privacy policy")
#: Upper edges of the bins of each line feature: words, bytes a word, and per hundred bytes: symbols, capitals, digits, pipes, "!";
#: then words that differ per hundred, lines like an earlier one, notices, share of the commonest word per hundred.
EDGES = [
    np.array(e, float)
    for e in ((2, 4, 8, 16, 32, 64, 128), (3, 4, 5, 6, 7, 8, 10, 14), (0.1, 1, 3, 6, 10, 20), (1, 3, 6, 12, 25, 50), (0.1, 2, 5, 10, 20), (0.1, 1, 3, 8), (0.1, 1, 3, 8), (15, 30, 45, 60, 75, 90, 99), (0.5,), (0.5,), (5, 10, 20, 35, 60))
]
_START = np.concatenate([[0], np.cumsum([len(e) + 1 for e in EDGES])])
N_FEATURES = int(_START[-1])


def line_rows(data: bytes) -> list[tuple]:
    """Raw features of each line with a word; the first is its number of words."""
    out, seen = [], set()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        counts = Counter(words)
        low = line.lower()
        most = max(counts.values())
        per = 100.0 / n
        out.append((k, (n - k + 1) / k, per * ts.less(line, ts.SYMBOLS), per * ts.less(line, ts.UPPER), per * ts.less(line, ts.DIGITS), per * line.count(b"|"), per * line.count(b"!"), 100.0 * len(counts) / k, line in seen, any(map(low.__contains__, NOTICE)), 100.0 * most / k))
        seen.add(line)
    return out


def binned(rows: list[tuple]) -> np.ndarray:
    """Feature numbers (one for each raw feature) of each line."""
    x = np.array(rows, float).reshape(len(rows), len(EDGES))
    return np.stack([np.searchsorted(e, x[:, i], "left") + _START[i] for i, e in enumerate(EDGES)], axis=1).astype(np.int32)


#: Labels. Ties go to content.
CONTENT, BOILERPLATE = 0, 1
_GAIN, _ALL = np.array([0.0, 1.0]), np.ones((2, 2), bool)
#: Raw features that give a line a first label by themselves: a repeat, a notice, a tenth of symbols or more.
_REPEAT, _NOTICE, _SYMBOLS = 8, 9, 2


def neutral() -> Chain:
    """Content everywhere."""
    return Chain(_GAIN, np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))


def seeded(rows: list[tuple]) -> np.ndarray:
    """Which lines are boilerplate by a rule of thumb."""
    return np.array([bool(r[_REPEAT] or r[_NOTICE] or r[_SYMBOLS] > 10) for r in rows], bool)


def relabelled(boilerplate: np.ndarray, words: np.ndarray, seed: np.ndarray, good: bool) -> np.ndarray:
    """Labels of a document's lines from how likely each is boilerplate, held to the document's own label: by words, a good
    document has half content or more, another one less than half. Seeded lines come first among boilerplate."""
    chance = np.where(seed, 1 + boilerplate, boilerplate)
    y = np.where(chance > 0.5, BOILERPLATE, CONTENT)
    total = words.sum()
    for i in np.argsort(chance if good else -chance, kind="stable"):  # the most content-like first where content is wanted
        share = words[y == CONTENT].sum() / total
        if (share >= CONTENT_SHARE) == good:
            break
        y[i] = CONTENT if good else BOILERPLATE
    return y


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: int = ROUNDS) -> Chain:
    """docs: (feature numbers [lines, features], words [lines], seeds [lines], quality). Lines have no labels of their own:
    they begin with their document's, seeded ones as boilerplate. The first fit takes each line by itself, so that what a
    line is like decides and not its neighbours, which have the same label yet; then chains are fitted to the lines as the
    fit before labels them."""
    docs = [d for d in docs if len(d[1])]
    if len({d[3] for d in docs}) < 2:
        return neutral()
    x = [d[0] for d in docs]
    chance = [np.full(len(n), 0.0 if good else 1.0) for _, n, _, good in docs]
    first = [relabelled(c, n, s, bool(good)) for c, (_, n, s, good) in zip(chance, docs, strict=True)]
    alone = [(line[None], label[None]) for d, ys in zip(x, first, strict=True) for line, label in zip(d, ys, strict=True)]
    model = Chain.fit(alone, N_FEATURES, _GAIN, _ALL, np.ones(2, bool), steps=120)
    score = [model.w[d].sum(1) + model.start[BOILERPLATE] - model.start[CONTENT] for d in x]
    chance = [1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in score]
    model = None
    for r in range(rounds):
        y = [relabelled(c, n, s, bool(good)) for c, (_, n, s, good) in zip(chance, docs, strict=True)]
        model = Chain.fit(list(zip(x, y, strict=True)), N_FEATURES, _GAIN, _ALL, np.ones(2, bool), steps=60 if r else 120, since=model)
        chance = [p[:, BOILERPLATE] for p in model.posteriors(x)]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> Chain:
    """Features come from the executors; the driver fits on at most `rows` documents and TRAIN_LINES lines of each."""
    sample = labelled_sample(docs, labels, F.lit(True), rows)

    def make():
        def f(_, text, y):
            data = [line_rows(b) for b in (t.encode("utf-8", "surrogatepass") for t in text)]
            begin = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % max(1, len(d) - TRAIN_LINES + 1) for t, d in zip(text, data, strict=True)]
            data = [d[b : b + TRAIN_LINES] for b, d in zip(begin, data, strict=True)]
            return [[binned(d).astype(np.int16).tobytes() if d else b"" for d in data], [np.array([r[0] for r in d], np.int64).tobytes() for d in data], [seeded(d).tobytes() for d in data], y]

        return f

    got = map_columns(sample.select("doc_id", "text", "y"), "x binary, n binary, seed binary, y int", make).orderBy("x", "y", "n", "seed").collect()
    return fit([(np.frombuffer(r.x, np.int16).astype(np.int32).reshape(-1, len(EDGES)), np.frombuffer(r.n, np.int64), np.frombuffer(r.seed, bool), r.y) for r in got])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, content_tags string, kept boolean"


def judge(docs: DataFrame, model: Chain, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: base counts, line tags ("C" or "b" for each line with a word), content share, verdict."""

    def make():
        return lambda ids, text: [ids, *map(list, zip(*verdicts(text, model, share), strict=True))]

    return map_columns(texts(docs), SCHEMA, make)


def verdicts(text: list[str], model: Chain, share: float) -> list[tuple]:
    """The columns of SCHEMA after the id, for each text."""
    rows, feats, sizes = [], [], []
    for t in text:
        data = t.encode("utf-8", "surrogatepass")
        words = data.split()
        rows.append(ts.base_counts(t, data, words, ts.word_hashes(words)))
        lines = line_rows(data)
        feats.append(binned(lines) if lines else np.empty((0, len(EDGES)), np.int32))
        sizes.append(np.array([r[0] for r in lines], np.int64))
    out = []
    scores = [model.w[x].sum(1) for x in feats]
    for (n, chars, sym, dup, rep), k, tags in zip(rows, sizes, model.viterbi_all(scores), strict=True):
        bad = n < MIN_WORDS or 100 * rep > REPEAT_PERCENT * n
        part = float(k[tags == CONTENT].sum() / n) if n else 0.0
        out.append((n, chars, sym, dup, rep, bad, len(k), int((tags == CONTENT).sum()), part, "".join("Cb"[x] for x in tags), not bad and part >= share))
    return out


def keep(docs: DataFrame, model: Chain, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that are kept, with their columns as they are."""
    return keep_rows(docs, "text", lambda: lambda text: [v[-1] for v in verdicts([t or "" for t in text], model, share)])


def quality_rules(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, share: float = CONTENT_SHARE) -> DataFrame:
    return judge(docs, train(docs, labels, train_docs), share)
