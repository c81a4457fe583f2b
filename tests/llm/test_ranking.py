"""MaxScore search, ball k-means and mixing by flow, each against a plain version."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import balls, lexical, mixing

from .conftest import prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k=20):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := _terms(text))]
    n_docs, n_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for doc, tf, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in _terms(text) if t in tf)
            if s:
                scores.append((-s, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if null else doc, -s] += 1
    return out


ITEMS = [(1, "one two three four five"), (1, "one two three four five"), (2, prose(1, 12)), (2, prose(7, 9)), (3, None), (4, "!!"), (5, "nowhere-to-be-found"), (None, "中文 İß MAIL mail mail card"), (6, prose(3, 800))]


@pytest.mark.parametrize("settings", [{}, {"shard_docs": 3, "round_rows": 40, "tasks": 1}, {"shard_bytes": 500, "max_terms": 5}, {"k": 2, "shard_docs": 4}])
def test_search_is_that_of_every_score(spark, docs, settings):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id int, text string, item int")
    got = Counter(tuple(r) for r in lexical.rank(docs, items, **settings).collect())
    assert got == _ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS, settings.get("k", 20)) and got


def test_search_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.rank(no_docs, items).collect() == [] == lexical.rank(docs, items.where("false")).collect()


def test_many_copies_rank_by_id(spark):
    rows = [(i, "the same words here") for i in range(500)] + [(1000 + i, f"other words {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same words")], "item_id int, text string")
    got = [(r.rank, r.doc_id) for r in lexical.rank(df, items, shard_docs=40).orderBy("rank").collect()]
    assert got == [(i + 1, i) for i in range(20)]


def test_non_essential_lists_are_only_probed():
    r = np.random.default_rng(1)
    writer = lexical.ShardWriter()
    for i in range(4000):
        writer.add(i, b"common " * int(r.integers(1, 4)) + (b"rare " if i % 200 == 0 else b"") + b"filler " * int(r.integers(1, 30)), None)
    row = dict(zip([c.split()[0] for c in lexical.INDEX.split(", ")], writer.row(), strict=True))
    shard = lexical.Shard({k: v if k == "terms" else np.array(v) for k, v in row.items() if k in ("terms", "dfs", "positions", "tfs", "lengths")}, row["n_docs"], row["n_terms"])
    at, score = shard.top([("common", 10), ("rare", 5000)], 1, 10)
    assert len(at) <= 20 and set(at) <= set(range(0, 4000, 200))  # the common list of 4,000 gave no document of its own
    assert not len(shard.top([("common", 10)], 10**9, 10)[0])  # under the bar of other shards


def _lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign(), strict=True):
            groups[j].append(v)
        for j, members in groups.items():
            centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = assign()
    by = Counter()
    for d, j in last:
        by[j] += d
    return Counter((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


def _vectors(n, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)]) for i in range(n)]
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (5, rows[1][1]), (5, rows[2][1]), (None, rows[-1][1]), (None, rows[3][1])]
    return rows + [(n + 3, None), (n + 4, [1.0] * 63), (n + 5, [1.0] * 63 + [None]), (n + 6, [1.0] * 63 + [float("nan")]), (n + 7, [float("inf")] + [1.0] * 63), (n + 8, []), (n + 9, [0.0] * 64), (n + 10, [0.0] * 64)]


@pytest.mark.parametrize("rows", [_vectors(400), _vectors(4), [(i, [float(i // 30)] * 64) for i in range(90)]], ids=["many", "few", "ties"])
def test_ball_k_means_is_plain_k_means(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(5)
    got = Counter(tuple(r) for r in balls.ball_k_means(df, block=32).collect())
    assert got == _lloyd(rows)


def test_balls_spare_distances(spark):
    df = spark.createDataFrame(_vectors(600), "vec_id long, embedding array<double>").repartition(3)
    blocks, centroids = balls.cluster(df, block=64)
    n, compared = blocks.select(F.sum(F.size("ids")), F.sum("compared")).first()
    assert len(centroids) == 16 and n <= compared < 0.35 * n * 16
    assert blocks.select(F.max(F.size("ids"))).first()[0] <= 64 + 1024


def test_balls_of_nothing_and_of_huge_values(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert balls.ball_k_means(none).collect() == [] == balls.ball_k_means(none.where("false")).collect()
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in balls.ball_k_means(huge).collect()) == [(1, 0), (2, 0), (3, 0)]


def _mixed(rows, weights=(5, 2, 1)):
    """Sizes and targets of documents with one source each, by sharing the excess again and again."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}, set()
    while over := {s for s in names if s not in full and target[s] > 3 * sizes[s] + 1e-9}:
        excess = sum(target[s] - 3 * sizes[s] for s in over)
        for s in over:
            target[s] = 3 * sizes[s]
        full |= over
        open_ = [s for s in names if s not in full]
        for s in open_:
            target[s] += excess * weight[s] / sum(weight[x] for x in open_)
    return sizes, target


def test_mix_meets_targets(spark):
    r = random.Random(5)
    rows = [(i, prose(i, r.choice([1, 5, 40, 90])) if i % 17 else None, r.choice(["a", "a", "a", "a", "b", "c", "Z", None, "é", "x"])) for i in range(700)]
    rows += [(900, "\x1cone\x85 \x0btwo", "tiny"), (900, "\x1cone\x85 \x0btwo", "tiny"), (None, "null id", "b"), (None, None, "void")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, line int, range int")
    got = mixing.mix(df, F.array("source"), group=50).collect()
    sizes, target = _mixed(rows)
    assert len(got) == len(rows) and Counter((x.doc_id, x.size) for x in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, _ in rows)
    taken = Counter()
    for x in got:
        one = x.routes[0]
        assert 0 <= x.taken <= 3 * x.size and x.taken == one.words and one.source_size == sizes[one.source] and one.target == pytest.approx(target[one.source])
        taken[one.source] += x.taken
    assert all(taken[s] == math.floor(t + 1e-6) for s, t in target.items()) and max(target.values()) > min(sizes.values())
    parts = [x for x in got if x.size and x.taken % x.size]
    assert len(parts) <= len(sizes)  # one document of a source at most is taken in part
    again = mixing.mix(df.repartition(6), F.array("source"), group=9).select("doc_id", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((x.doc_id, x.size, x.taken) for x in got)


def test_mix_of_overlapping_sources(spark):
    texts = [(i, " ".join("w" * 10), s) for i, s in enumerate([["a"]] * 10 + [["a", "b"]] * 30 + [["b", "c", "b"]] * 10 + [["c", None]] * 10 + [[]] * 2 + [None])]
    df = spark.createDataFrame(texts, "doc_id long, text string, sources array<string>")
    got = mixing.mix(df, F.col("sources")).collect()
    words = Counter()
    for x in got:
        assert x.taken == sum(y.words for y in x.routes) <= 3 * x.size
        for y in x.routes:
            words[y.source] += y.words
    target = {y.source: y.target for x in got for y in x.routes}
    assert set(target) == {"a", "b", "c", None} and all(words[s] == math.floor(t) for s, t in target.items())
    assert {y.source: y.source_size for x in got for y in x.routes} == {"a": 400, "b": 400, "c": 200, None: 100}
    assert [x.taken for x in got if not x.routes] == [0, 0, 0]


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none, F.array("source")).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert [(x.size, x.taken, x.routes[0].target) for x in mixing.mix(blank, F.array("source")).collect()] == [(0, 0, 0.0)] * 2


def test_flow_is_largest_and_cheapest():
    """Against all whole flows of small graphs: first the most words, then the least cost of repetition."""
    r = random.Random(2)
    for _ in range(40):
        quotas = [r.randint(0, 6) for _ in range(3)]
        patterns = [(tuple(sorted(r.sample(range(3), r.randint(1, 3)))), r.randint(0, 2)) for _ in range(3)]
        cost = lambda n, w: sum(k * max(0, min(w, n - k * w)) for k in range(3)) if w else 0
        best = None
        for totals in itertools.product(*[range(3 * w + 1) for _, w in patterns]):
            # Quotas hold what totals send if every set of sources has room for the patterns that can go nowhere else (Hall).
            if all(sum(t for t, (s, _) in zip(totals, patterns, strict=True) if set(s) <= set(u)) <= sum(quotas[i] for i in u) for n in range(4) for u in itertools.combinations(range(3), n)):
                new = (-sum(totals), sum(cost(t, w) for t, (_, w) in zip(totals, patterns, strict=True)))
                best = new if best is None or new < best else best
        given = mixing.plan(patterns, quotas)
        used = [sum(g) for g in given]
        assert (-sum(used), sum(cost(n, w) for n, (_, w) in zip(used, patterns, strict=True))) == best
        assert all(sum(g[s.index(i)] for g, (s, _) in zip(given, patterns, strict=True) if i in s) <= quotas[i] for i in range(3))
