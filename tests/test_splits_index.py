"""Containment by an index of n-grams, against looking into every text."""

import random

import numpy as np
import pytest

from corvane.functions import grams as G
from corvane.operators import splits


def test_hashes_know_only_their_characters():
    r = random.Random(1)
    for size in (1, 2, 3, 5, 7, 8):
        text = "".join(r.choice("abé中\U0001f600 ") for _ in range(200))
        h = G.hashes(text, size)
        parts = [text[i : i + size] for i in range(len(text) - size + 1)]
        assert len(h) == len(parts) and len(set(zip(parts, h.tolist(), strict=True))) == len(set(parts)) == len(set(h.tolist()))
        assert not len(G.hashes(text[: size - 1], size))


def test_keys_of_a_part_are_keys_of_the_whole():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 300)))
        a = r.randint(0, len(text))
        part = text[a : r.randint(a, len(text))]
        for kinds in ({"windows": True}, {"every": True}, {"sizes": (2, 5)}):
            keys = G.Keys(**kinds)
            own = keys(part)
            assert set(own) <= set(keys(text))
            assert len(own) or len(part) < {"windows": G.LONG, "every": G.SIZE, "sizes": 2}[next(iter(kinds))]
            only = np.unique(own[::2])
            assert set(G.Keys(**kinds, only=only)(text)) == set(only)


def _cases():
    r = random.Random(3)
    texts = ["".join(r.choice("abc é\n") for _ in range(r.choice([0, 3, 10, 40, 200]))) for _ in range(150)] + [None, "", "z", "zz" * 60]
    items = [t[a : a + n] for t in texts[:60] if t for a, n in [(r.randrange(len(t)), r.choice([1, 2, 5, 7, 8, 9, 22, 23, 24, 60, 500]))]]
    return texts, [*items, items[0], None, "", "not in any text at all", "qqqq", "z"]


@pytest.mark.parametrize("most_keys", [1_000_000, 3])
@pytest.mark.parametrize("least", [0, 8, 23])
def test_holding_is_containment(spark, most_keys, least):
    texts, items = _cases()
    items = [i for i in items if i is None or i == "" or len(i) >= least]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts * 2)], "ord int, query string").repartition(3)
    got = splits.holding(rows, spark.createDataFrame([(i,) for i in items], "text string"), most_keys)
    assert got.columns == ["ord", "query"]
    want = [n for n, t in enumerate(texts * 2) if t is not None and any(i and i in t for i in items)]
    assert sorted(r.ord for r in got.collect()) == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_holding_nothing(spark):
    rows, none = spark.createDataFrame([(1, "a")], "ord int, query string"), spark.createDataFrame([], "text string")
    assert splits.holding(rows, none).collect() == [] == splits.holding(rows.where("false"), spark.createDataFrame([("a",)], "text string")).collect()
