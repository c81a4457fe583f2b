"""Hard negatives by an index of keywords, against every score."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import candidates, negatives


def _brute(tools, asked, own, correct, k):
    scores = [(-(2 * len(set(asked) & set(w)) - len(set(own) & set(w))), pos, name) for pos, name, w in tools if name != correct]
    return sorted(scores)[:k]


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_the_best_of_all(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice([3, 12, 60]))]
    weights = [1 / (1 + i) for i in range(len(words))]  # a few words are in most tools
    for _ in range(60):
        n = r.choice([1, 2, 5, 40, 300])
        tools = [(r.randint(0, 10 * n), f"t{r.randint(0, n)}", list(set(r.choices(words, weights, k=r.randint(0, 6))) | ({"all"} if seed % 2 else set()))) for _ in range(n)]
        index = candidates.ToolIndex(*map(list, zip(*tools, strict=True)))
        for _ in range(6):
            asked, own = r.sample(words, min(len(words), r.randint(0, 5))) + ["all"] * (r.random() < 0.5), r.sample(words, min(len(words), r.randint(0, 4))) + ["all"] * (r.random() < 0.5)
            correct, k = f"t{r.randint(0, n)}", r.randint(1, 4)
            got = [(-s, index.pos[at], index.names[at]) for at, s in index.best(asked, own, correct, k)]
            assert got == _brute(tools, asked, own, correct, k)
            assert not index.score.any()


def test_common_words_are_not_added_up():
    """2,000 tools share a common word; the row's rare words decide before it is read."""
    tools = [(i, f"t{i}", ["common", f"rare{i // 4}"]) for i in range(2000)] + [(5000, "other", ["x"])]
    index = candidates.ToolIndex(*map(list, zip(*tools, strict=True)))
    looked = []
    real = candidates.ToolIndex._in
    index._in = lambda of, word: looked.append(len(of)) or real(index, of, word)
    got = index.best(["common", "rare7", "rare9"], [], "t28", 3)
    assert [(index.names[at], s) for at, s in got] == [("t29", 4), ("t30", 4), ("t31", 4)]
    assert max(looked) <= 8


def _tables(spark):
    r = random.Random(4)
    words = ["red", "blue", "green", "gear", "bolt", "size", "tin", "brass"]
    tools = [("hot" if r.random() < 0.8 else f"r{r.randint(0, 3)}", i, "_".join(r.sample(words, 2)) + str(r.randint(0, 40)), " ".join(r.sample(words, 3)) if r.random() < 0.9 else None) for i in range(400)]
    rows = [(f"x{i}", reg, "find a " + " ".join(r.sample(words, 3)), name) for i, (reg, _, name, _) in enumerate(tools[:150])]
    rows += [("lonely", "nowhere", "red", "t"), ("null", "hot", None, "t"), ("none", "hot", "red", None), ("new", None, "red", "t"), ("zero", "hot", "nothing known", "t")]
    tools += [("single", 1, "only_one", "red")]
    rows += [("alone", "single", "red", "only_one")]
    return spark.createDataFrame(rows, "traj_id string, registry string, query string, correct_tool string").repartition(3), spark.createDataFrame(tools, "registry string, pos long, name string, description string")


@pytest.mark.parametrize("sizes", [{}, {"tools": 30, "group": 20}])
def test_best_is_the_top_of_all_scores(spark, sizes, monkeypatch):
    rows, tools = _tables(spark)
    whole = candidates.best_candidates
    monkeypatch.setattr(candidates, "best_candidates", lambda *a: whole(*a, **sizes))
    got = {(r.traj_id, r["rank"], r.name, r.pos, r.score) for r in negatives.best(rows, tools).collect()}
    want = {(r.traj_id, r["rank"], r.name, r.pos, r.score) for r in negatives.top_candidates(negatives.candidate_scores(rows, tools)).collect()}
    assert got == want and len({t for t, *_ in got}) == 152 and "alone" not in {t for t, *_ in got}


def test_hot_registry_is_split(spark):
    rows, tools = _tables(spark)
    asked, words = negatives._worded(rows, tools)
    sizes = []
    dealt = candidates.best_candidates(asked, words, 3, tools=30, group=20)
    sizes = dealt.groupBy("traj_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert sizes > 3  # rows of the hot registry met several blocks, k of each


def test_no_rows_or_tools(spark):
    rows, tools = _tables(spark)
    assert negatives.best(rows.where("false"), tools).collect() == [] == negatives.best(rows, tools.where("false")).collect()
