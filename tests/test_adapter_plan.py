"""What an adapted entry needs is computed once for it."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import labels as L
from corvane.operators import adapter


def test_targets_are_resolved_before_turns_are_dealt(spark):
    columns = "uuid subset_name question target_tools tools messages".split()
    rows = adapter.turns(spark.range(4).select(*(F.col("id").cast("string").alias(c) for c in columns))).where("status = 'ok'")
    plan = rows.select("uuid", "turn", "query", "correct_tool")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "array_contains" not in above and "regexp_replace" not in above


@pytest.mark.parametrize("name, want", [("Send_EMAIL", "communication"), ("srv-fn_1", "general"), ("MLx", "ml"), ("read_mail", "communication"), (None, "general"), ("", "general")])
def test_categories_and_bound_values(spark, name, want):
    df = spark.createDataFrame([(name, 3)], "n string, k int")
    got = df.select(L.category_of(F.col("n")).alias("c"), L.bound(F.col("k") + 1, lambda x: x * x).alias("b")).collect()[0]
    assert (got.c, got.b) == (want, 16)
