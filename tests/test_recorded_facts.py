"""Facts of recorded fixtures, where CORVANE_FIXTURES names a folder that has them anywhere below: registries, all queries, the
expected selections, and the results of each level."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluate, registry
from corvane.sources import readers

BASE = os.environ.get("CORVANE_FIXTURES")


def found(pattern):
    return sorted(glob.glob(f"{BASE}/**/{pattern}", recursive=True))


needs = pytest.mark.skipif(not BASE, reason="CORVANE_FIXTURES isn't set")

# Tools, estimated tokens, and answerable cases of each registry.
FACTS = {"small_10": (10, 939, 7), "medium_25": (25, 2308, 12), "large_50": (49, 4663, 25)}


def test_spaced_json(spark):
    df = spark.createDataFrame([('{"a":[1,2],"é":{}}',), ("no",), (None,)], "s string")
    assert [r.x for r in df.select(T.spaced_json("s").alias("x")).collect()] == ['{"a": [1, 2], "\\u00e9": {}}', "no", None]


@needs
@pytest.mark.parametrize("name", FACTS)
def test_registries_and_cases(spark, name):
    tools = readers.read_registry(spark, found(f"{name}.json")[0])
    n, tokens, cases = FACTS[name]
    assert registry.counts(tools).first().n_tools == n
    assert registry.token_estimate(tools, T.spaced_json("schema")).first().tokens == tokens
    given = readers.load_cases(spark, found("all*.json")[0], found("expected*.json")[0])
    assert given.count() == 28 and evaluate.keep_answerable(given, tools, name).count() == cases


@needs
def test_metrics_of_recorded_results(spark):
    files = found("level*.json")
    assert len(files) == 13
    rows, want = [], {}
    for f in files:
        with open(f) as opened:
            run = json.load(opened)
        want[f] = run["metrics"]
        rows += [(f, r["tool_correct"], r["params_correct"], float(r["code_validity"]), float(r["turns_used"]), r["success"]) for r in run["results"]]
    got = evaluate.metrics(spark.createDataFrame(rows, "file string, tool_correct boolean, params_correct boolean, code_validity double, turns_used double, success boolean"), "file")
    for r in got.select("*", F.lit(1.0).alias("context_savings_pct")).collect():
        have = r.asDict()
        assert {k: have[k] for k in want[r.file]} == pytest.approx(want[r.file], abs=1e-4), r.file
