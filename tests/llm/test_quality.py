"""Quality rules and the quality classifier."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lines, pu
from corvane.llm import textstats as ts

from .conftest import prose


def plain_counts(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if __import__("re").search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts(docs, no_docs, labels, no_labels):
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for given in (labels, no_labels):
        got = lines.quality_rules(docs, given).collect()
        assert len(got) == docs.count()
        for r in got:
            if len(text[r.doc_id]) < 5000:
                n = plain_counts(text[r.doc_id])
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
                assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
            assert not (r.base_failed and r.kept)
            assert given is labels or r.kept != r.base_failed
    assert lines.quality_rules(no_docs, labels).collect() == []


CLEAN = (18, 6.0, 0.0, 1.0, 0.0, 0.0, 0.0, 90.0, False, False, 5.0)
DIRTY = (18, 6.0, 9.0, 1.0, 0.0, 0.0, 0.0, 90.0, False, False, 5.0)


def line_docs(n=120):
    """Documents of clean and dirty lines; a good one is mostly clean, a bad one mostly dirty."""
    rng, data = np.random.default_rng(0), []
    for k in range(n):
        size = int(rng.integers(3, 12))
        dirty = np.arange(size) < size * (0.3 if k % 2 else 0.7)
        if rng.random() < 0.5:
            dirty = dirty[::-1]
        rows = [DIRTY if d else CLEAN for d in dirty]
        data.append((lines.binned(rows), np.array([r[0] for r in rows]), lines.seeded(rows), k % 2, dirty))
    return data


def test_lines_of_one_document_are_marked_apart():
    data = line_docs()
    model = lines.fit([d[:4] for d in data])
    tags = model.viterbi_all([model.w[d[0]].sum(1) for d in data])
    assert np.mean([(t == d[4]).mean() for t, d in zip(tags, data, strict=True)]) > 0.97
    assert np.mean([len(set(t.tolist())) == 2 for t in tags]) > 0.9


def test_chain_decodes_exactly():
    rng = np.random.default_rng(2)
    model = lines.fit([d[:4] for d in line_docs(40)])
    for n in range(1, 9):
        for _ in range(6):
            score = rng.normal(size=n) * 3
            value = lambda y: model.start[y[0]] + sum(g for g, v in zip(score, y, strict=True) if v) + sum(model.trans[a, b] for a, b in itertools.pairwise(y))
            assert np.isclose(value(tuple(model.viterbi(score))), max(map(value, itertools.product((0, 1), repeat=n))))


def test_relabelling_keeps_the_documents_label():
    words, seed = np.array([10, 10, 10, 5]), np.array([False, True, False, False])
    for good in (True, False):
        for chance in ([0.9, 0.9, 0.9, 0.9], [0.1, 0.1, 0.1, 0.1], [0.1, 0.9, 0.6, 0.4]):
            y = lines.relabelled(np.array(chance), words, seed, good)
            assert (words[y == lines.CONTENT].sum() >= lines.CONTENT_SHARE * 35) == good
            assert good or y[1] == lines.BOILERPLATE


def test_verdict_against_all_labellings(spark, labels):
    """kept by brute force: the best of all labellings of the lines, and the words in its content lines."""
    text = [prose(1, 30) + "\n" + "### $$$ && " * 10, "### $$$ && " * 20 + "\n" + prose(2, 25), prose(3, 40) + "\n\n" + prose(4, 25) + "\n" + "a | b | c | d |", prose(5, 21), "x " * 30, prose(6, 22) + "\n" + prose(7, 50).upper().replace(" ", "!! ")]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(text)] + [(5, prose(1, 60)), (7, prose(2, 80)), (9, prose(3, 90)), (14, prose(8, 70)), (13, "### $$$ && | | | " * 30), (15, "BUY!! NOW!! " * 20), (16, "a | b | c | d | e\n" * 9)], "doc_id long, text string")
    model = lines.train(df, labels)
    for r in lines.judge(df, model).collect():
        rows = lines.line_rows(next(x.text for x in df.where(F.col("doc_id") == r.doc_id).collect()).encode())
        gain = model.w[lines.binned(rows)].sum(1)
        value = lambda y: model.start[y[0]] + sum(g for g, v in zip(gain, y, strict=True) if v) + sum(model.trans[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(rows)), key=value)
        share = sum(x[0] for x, v in zip(rows, best, strict=True) if v == lines.CONTENT) / sum(x[0] for x in rows)
        assert r.content_tags == "".join("Cb"[v] for v in best) and np.isclose(r.content_share, share) and r.kept == (not r.base_failed and share >= 0.5)


def test_kept_documents_keep_their_columns(docs, labels):
    model = lines.train(docs, labels)
    out = lines.keep(docs, model)
    kept = lines.judge(docs, model).where("kept")
    assert out.schema == docs.schema and out.count() == kept.count()


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(1200):
        w = list(rng.choice(words, rng.integers(40, 120)))
        bad = i % 6 == 0
        rows.append((i, " ".join(x + ("$$$" if i % 12 else "!!") for x in w) if bad else " ".join(w), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = pu.quality_classifier(df.select("doc_id", "text"), df.where("doc_id % 2 = 0")).join(df, "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_classifier_on_awkward_rows(docs, no_docs, labels, no_labels):
    got = pu.quality_classifier(docs, labels)
    assert got.count() == docs.count() and got.where(F.col("score").isNull()).isEmpty()
    assert {r.score for r in pu.quality_classifier(docs, no_labels).collect()} == {0.5}
    assert pu.quality_classifier(no_docs, labels).collect() == []


def plain_features(text):
    """The classifier's features, counted one by one."""
    data = text.encode()
    words, n = data.split(), max(1, len(data))
    k = max(1, len(words))
    each = lambda letters: sum(b in letters for b in data) / n
    found = [x for x in data.split(b"\n") if x.split()]
    sizes = list(map(len, words)) or [0]
    two = list(itertools.pairwise(words))
    most = lambda items: max(Counter(items).values(), default=0)
    return [
        np.log1p(len(words)), each(ts.SYMBOLS), each(ts.UPPER), each(ts.DIGITS), each(b"|"), each(b"!"), each(pu.PUNCT), np.mean(sizes), np.std(sizes), np.mean([x <= 3 for x in sizes]),
        most(words) / k, len(set(words)) / k**0.8, len(set(two)) / max(1, len(two)), plain_counts(text)[4] / k, 1 - len(set(found)) / max(1, len(found)), (n * bool(data) - len(text)) / n,
    ]


def test_scores_by_brute_force(docs, labels):
    """Each row's score from features counted one by one and a sum over them, with the model that the rows train."""
    model = pu.train(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pu.quality_classifier(docs, labels).collect():
        x = plain_features(text[r.doc_id]) if len(text[r.doc_id]) < 20_000 else pu.features(text[r.doc_id])
        gain = sum(model.w[i, sum(e < v for e in model.edges[i])] for i, v in enumerate(x))
        assert np.isclose(r.score, 1 / (1 + np.exp(-gain))) and r.predicted == (r.score >= 0.3)


def test_weights_are_near_the_least_risk():
    """The fitted risk against that of random changes of the weights."""
    rng = np.random.default_rng(3)
    pos, mixed = rng.normal(1, 1, (300, pu.N_RAW)), np.r_[rng.normal(1, 1, (300, pu.N_RAW)), rng.normal(-1, 1, (300, pu.N_RAW))]
    model = pu.fit(pos, mixed)
    cp, cu, at = model.codes(pos), model.codes(mixed), np.arange(pu.N_RAW)

    def risk(w):
        gp, gu = w[at, cp].sum(1), w[at, cu].sum(1)
        return model.prior * np.logaddexp(0, -gp).mean() + max(0.0, np.logaddexp(0, gu).mean() - model.prior * np.logaddexp(0, gp).mean()) + 5e-5 * (w * w).sum()

    assert all(risk(model.w) <= risk(model.w + rng.normal(0, 0.1, model.w.shape)) + 0.01 for _ in range(50))


def test_prior_estimate():
    rng = np.random.default_rng(1)
    pos = rng.beta(8, 2, 4000)
    mixed = np.r_[rng.beta(8, 2, 5600), rng.beta(2, 8, 2400)]
    assert 0.6 < pu.estimate_prior(pos, mixed) < 0.75


def test_repeat_words_marks_every_window():
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"]
    assert ts.repeat_words(ts.word_hashes(words + [b"x"] + words)) == 16
    assert ts.repeat_words(ts.word_hashes(words)) == 0


@pytest.mark.parametrize(("times", "others"), [(7000, 65), (75, 25), (1, 0), (3, 200)])
def test_commonest_word_of_any_line(times, others):
    line = " ".join(["spam"] * times + [f"w{i}" for i in range(others)])
    assert lines.line_rows(line.encode())[0][-1] == 100.0 * times / (times + others)
