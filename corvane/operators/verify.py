"""Staged verification of trajectories; a stage's reason is null where it passes, and the first reason stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions import text as T
from . import messages as M
from .registry import last_by_name


def _first(*rules: tuple[Column, str | Column]) -> Column:
    head, *rest = [(c, F.lit(r) if isinstance(r, str) else r) for c, r in rules]
    return reduce(lambda chain, rule: chain.when(*rule), rest, F.when(*head))


def role_reason(messages: Column) -> Column:
    """Too few messages, or roles out of place."""
    return _first((F.size(messages) < 4, "too few messages"), (M.role_at(messages, 0) != "system", "first message is not system"), (M.role_at(messages, 1) != "user", "second message is not user"), (M.role_at(messages, -1) != "assistant", "last message is not assistant"))


def format_reason(messages: Column, turns: Column, max_turns: int = 12, strict: bool = False, json_ok: Column | None = None) -> Column:
    """Format: roles, a final answer, code, turns, an object as answer, valid JSON.

    Code tags count wherever they stand, so a prompt that explains them passes; strict looks at assistant messages only.
    json_ok replaces the built-in test of JSON (which takes trailing text) by a stricter one, as T.valid_json of
    T.final_object gives.
    """
    last = M.last_of_role(messages)
    body = T.final_object(last)
    where = M.of_role(messages, "assistant") if strict else messages
    code = F.exists(where, lambda m: m["content"].contains("<code>"))
    valid = json_ok if json_ok is not None else F.from_json(body, "map<string,string>").isNotNull()
    return F.coalesce(role_reason(messages), _first((~last.rlike(r"FINAL\s*\("), "no final answer"), (~code, "no code"), (turns > max_turns, "too many turns"), (body.isNull(), "final answer is no object"), (~F.coalesce(valid, F.lit(False)), "final answer is no valid JSON")))


def execution_reason(blocks: Column, failed: Column) -> Column:
    """No code at all, or more than half of the blocks failed; exactly half passes."""
    rate = F.concat(F.lit("code error rate too high: "), failed.cast("string"), F.lit("/"), blocks.cast("string"))
    return _first((F.coalesce(blocks, F.lit(0)) == 0, "no code blocks"), (failed * 2 > blocks, rate))


def semantic_reason(correct_tool: Column, final: Column, known: Column, required: Column, expected: Column, judged: Column | None = None) -> Column:
    """Tool and parameters of the final object against the registry and the expected parameters. known: the tool is in
    the registry; expected: map of expected parameters, null for none; judged: a recorded verdict, null passes."""
    said = P.as_map(final)
    tool, body = said["tool"], said["params"]
    given = P.as_map(F.coalesce(body, F.lit("{}")))
    return _first(
        (F.coalesce(correct_tool, F.lit("")) == "", "no correct tool"), (said.isNull(), "final answer is no object"), (F.coalesce(tool, F.lit("")) != correct_tool, "wrong tool"), (given.isNull(), "parameters are no object"),
        (~F.coalesce(known, F.lit(False)), "tool is not in the registry"), (~P.has_required(required, given), "required parameter missing"), (~P.match(expected, given, stripped=True), "unexpected parameter value"),
        *([(~F.coalesce(judged, F.lit(True)), "judged wrong")] if judged is not None else []),
    )


def staged(df: DataFrame, *reasons: Column) -> DataFrame:
    """Adds reject_stage and reject_reason; a later stage counts only where the earlier ones passed."""
    stage = reduce(lambda chain, i: chain.when(reasons[i].isNotNull(), i + 1), range(1, len(reasons)), F.when(reasons[0].isNotNull(), 1))
    return df.withColumn("reject_stage", stage).withColumn("reject_reason", F.coalesce(*reasons))


def funnel(df: DataFrame) -> DataFrame:
    """Rows by stage (0: verified) with their share."""
    total = F.sum("n").over(_everything())
    return df.groupBy(F.coalesce("reject_stage", F.lit(0)).alias("reject_stage")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / total, 4))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def verify(trajectories: DataFrame, tools: DataFrame, expected: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """All three stages over trajectories(traj_id, registry, query, correct_tool, turns, messages, blocks, failed).

    tools(registry, name, pos, required); expected(query, ord, expected_params): the last of a query wins;
    verdicts(traj_id, passed): recorded judgements, missing ones pass.
    """
    known = last_by_name(tools).select("registry", F.col("name").alias("correct_tool"), F.col("required").alias("_required"), F.lit(True).alias("_known"))
    out = trajectories.join(known, ["registry", "correct_tool"], "left")
    if expected is not None:
        out = out.join(expected.groupBy("query").agg(F.max_by("expected_params", "ord").alias("_expected")), "query", "left")
    else:
        out = out.withColumn("_expected", F.lit(None).cast("string"))
    if verdicts is not None:
        out = out.join(verdicts.select("traj_id", F.col("passed").alias("_passed")), "traj_id", "left")
    final = T.final_object(M.last_of_role(F.col("messages")))
    out = staged(
        out.withColumn("_ok", T.valid_json(final)),
        format_reason(F.col("messages"), F.col("turns"), json_ok=F.col("_ok")),
        execution_reason(F.col("blocks"), F.col("failed")),
        semantic_reason(F.col("correct_tool"), final, F.col("_known"), F.col("_required"), P.as_map(F.col("_expected")), F.col("_passed") if verdicts is not None else None),
    )
    return out.select(*trajectories.columns, "reject_stage", "reject_reason")
