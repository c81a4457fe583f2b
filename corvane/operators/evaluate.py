"""Scoring of recorded answers: joins with the truth, comparison, and metrics by any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P


def with_truth(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """queries(query, ...) left join truth(query, ord, expected_tool, expected_params): its last row of a query wins."""
    last = truth.groupBy("query").agg(F.max_by(F.struct("expected_tool", "expected_params"), "ord").alias("t"))
    out = queries.join(last, "query", "left")
    return out.withColumn("expected_tool", F.coalesce("t.expected_tool", F.lit(""))).withColumn("expected_params", F.coalesce("t.expected_params", F.lit("{}"))).drop("t")


def keep_answerable(cases: DataFrame, tools: DataFrame, registry: str | None = None, discovery: bool = False) -> DataFrame:
    """Cases whose expected tool is in the registry (a column of the cases, or the one named); open-ended ones by flag."""
    names = tools.select("registry", F.col("name").alias("expected_tool")).distinct()
    on = ["registry", "expected_tool"]
    if registry is not None:
        names, on = names.where(F.col("registry") == registry).select("expected_tool"), ["expected_tool"]
    open_ended = F.col("expected_tool") == "DISCOVERY"
    kept = cases.where(~open_ended).join(names, on, "left_semi").select(*cases.columns)
    return kept.unionByName(cases.where(open_ended)) if discovery else kept


def compare(df: DataFrame, strict_case: bool = False, stripped: bool = False) -> DataFrame:
    """Adds tool_correct and params_correct to (expected_tool, expected_params, predicted_tool, predicted_params);
    parameters of a wrong tool are wrong."""
    a, b = F.col("expected_tool"), F.col("predicted_tool")
    same = (a == b) if strict_case else (F.lower(a) == F.lower(b))
    out = df.withColumn("tool_correct", F.coalesce(same, F.lit(False)))
    return out.withColumn("params_correct", F.col("tool_correct") & P.match(P.as_map(F.col("expected_params")), P.as_map(F.col("predicted_params")), stripped))


def validity(turns: DataFrame, by: str, level: Column | None = None) -> DataFrame:
    """Share of code blocks that ran: 1 without code at level 0, else 0."""
    none = F.when((level if level is not None else F.lit(1)) == 0, 1.0).otherwise(0.0)
    return turns.groupBy(by).agg(F.coalesce(F.avg(F.col("success").cast("double")), F.max(none)).alias("code_validity"))


def metrics(results: DataFrame, *by: str) -> DataFrame:
    """Rates over results(tool_correct, params_correct, code_validity, turns_used, success); without groups, null if empty."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    return results.groupBy(*by).agg(
        rate(F.col("tool_correct")).alias("tool_selection_accuracy"), rate(F.col("params_correct")).alias("parameter_correctness"), rate(F.col("code_validity")).alias("repl_code_validity"),
        rate(F.col("tool_correct") & F.col("params_correct")).alias("end_to_end_accuracy"), F.round(F.avg("turns_used"), 2).alias("avg_turns"), rate(~F.col("success")).alias("failure_rate"), F.count("*").alias("total_queries"),
    )


def context_savings(with_lookup: Column, without: Column) -> Column:
    """1 - share of prompt tokens that lookup needs; 1 where nothing is known of either."""
    return F.when(F.coalesce(without, F.lit(0)) <= 0, F.lit(1.0)).otherwise(1 - F.coalesce(with_lookup, F.lit(0)) / without)


def answered(cases: DataFrame, answers: DataFrame, *on: str) -> DataFrame:
    """Every case with its recorded answer; one without counts as failed, with no turns and no code."""
    rows = cases.join(answers, list(on), "left")
    return rows.withColumn("success", F.coalesce("success", F.lit(False))).withColumn("turns_used", F.coalesce("turns_used", F.lit(0))).withColumn("code_validity", F.coalesce("code_validity", F.lit(0.0)))


def matrix(cases: DataFrame, answers: DataFrame, tools: DataFrame) -> DataFrame:
    """Metrics of every (level, registry) that recorded answers(level, registry, query, predicted_tool, predicted_params,
    code_validity, turns_used, success, elapsed_seconds) has, over the cases that the registry can answer; cell is the key
    level{L}_{registry}. A case without an answer counts as failed, with no turns; a cell without cases is left out."""
    cells = answers.select("level", "registry").distinct()
    open_ = keep_answerable(cells.join(tools.select("registry", F.col("name").alias("expected_tool")).distinct(), "registry").join(cases, "expected_tool"), tools)
    rows = answered(open_, answers, "level", "registry", "query")
    seconds = rows.groupBy("level", "registry").agg(F.round(F.sum("elapsed_seconds"), 1).alias("total_time"))
    return metrics(compare(rows), "level", "registry").join(seconds, ["level", "registry"]).withColumn("cell", F.concat(F.lit("level"), F.col("level").cast("string"), F.lit("_"), "registry"))
