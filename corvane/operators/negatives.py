"""Preference pairs: a correct trajectory and the same with a wrong tool, or with wrong parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import hash_order, hash_pick
from ..functions.params import corrupt
from . import candidates
from . import messages as M

TOP = 3


def _worded(rows: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the words of their query and of their correct tool (the first of its name), tools with theirs."""
    words = tools.select("registry", "name", "pos", T.tool_keywords(F.col("name"), F.col("description")).alias("words"))
    first = words.groupBy("registry", F.col("name").alias("correct_tool")).agg(F.min_by("words", "pos").alias("own"))
    asked = rows.select("traj_id", "registry", "correct_tool", T.keywords(F.coalesce("query", F.lit(""))).alias("asked"))
    return asked.join(first, ["registry", "correct_tool"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>"))), words


def candidate_scores(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """(traj_id, name, pos, score) of every other tool of the row's registry: twice the words it shares with the query,
    less those it shares with the correct tool. rows(traj_id, registry, query, correct_tool). That is the whole table of rows
    and tools; best() finds the highest of it without it."""
    asked, words = _worded(rows, tools)
    pairs = asked.join(words, "registry").where(F.col("name") != F.col("correct_tool"))
    return pairs.select("traj_id", "name", "pos", (2 * F.size(F.array_intersect("words", "asked")) - F.size(F.array_intersect("words", "own"))).alias("score"))


def top_candidates(scores: DataFrame, k: int = TOP) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("traj_id").orderBy(F.desc("score"), "pos"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def best(rows: DataFrame, tools: DataFrame, k: int = TOP) -> DataFrame:
    """top_candidates(candidate_scores(...)), by an index of keywords."""
    return top_candidates(candidates.best_candidates(*_worded(rows, tools), k), k)


def wrong_tools(rows: DataFrame, tools: DataFrame, seed: int = 42, k: int = TOP) -> DataFrame:
    """(traj_id, wrong_tool): one of the k best candidates, by hash; none where the registry has no other tool."""
    names = best(rows, tools, k).groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    return names.select("traj_id", F.get("names", hash_pick(seed, F.size("names"), F.col("traj_id"))).alias("wrong_tool"))


def own_registries(rows: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and tools such that a row with tools of its own, array<struct<name,description,...>>, meets these only, as a
    registry named after the row; other rows keep the registry that they name."""
    inline = F.size(F.coalesce("tools", F.array())) > 0
    own = F.concat(F.lit("row:"), F.col("traj_id").cast("string"))
    listed = rows.where(inline).select(own.alias("registry"), F.posexplode("tools").alias("pos", "t")).select("registry", F.col("pos").cast("long").alias("pos"), "t.name", "t.description")
    return rows.withColumn("registry", F.when(inline, own).otherwise(F.col("registry"))), tools.select("registry", F.col("pos").cast("long").alias("pos"), "name", "description").unionByName(listed)


def completed(rows: DataFrame) -> DataFrame:
    """Rows whose tool is the predicted one where there is no correct one, and whose parameters are those of the last
    message that has a final object where there are none."""
    tool = F.when(F.coalesce("correct_tool", F.lit("")) == "", F.col("predicted_tool")).otherwise(F.col("correct_tool")) if "predicted_tool" in rows.columns else F.col("correct_tool")
    answers = F.filter(F.transform(M.of_role(F.col("messages"), "assistant"), lambda m: T.final_object(m["content"])), lambda x: x.isNotNull())
    said = F.get_json_object(F.get(answers, F.size(answers) - 1), "$.params")
    empty = F.regexp_replace(F.coalesce("params", F.lit("")), r"\s", "").isin("", "{}")
    return rows.withColumn("correct_tool", tool).withColumn("params", F.when(empty, F.coalesce(said, "params")).otherwise(F.col("params")))


def pairs(rows: DataFrame, tools: DataFrame, target: int | None = None, seed: int = 42) -> DataFrame:
    """Preference pairs of rows(traj_id, registry, query, correct_tool, params, required, messages): a wrong tool where
    there is one, and wrong parameters; the first `target` in hash order of the rows, the wrong tool of a row first."""
    base = completed(rows).where((F.size("messages") > 0) & (F.coalesce("query", F.lit("")) != "") & (F.coalesce("correct_tool", F.lit("")) != ""))
    keep = ("traj_id", "query", "correct_tool", "negative_type", "wrong_tool", "wrong_params", "chosen_messages", "rejected_messages")
    tool = base.join(wrong_tools(base, tools, seed), "traj_id").withColumn("negative_type", F.lit("wrong_tool")).withColumn("wrong_params", F.lit(None).cast("string"))
    tool = tool.withColumn("rejected_messages", M.swap_final(F.col("messages"), F.col("wrong_tool"), F.coalesce("params", F.lit("{}"))))
    wrong = base.withColumn("wrong_params", corrupt("params", "required", hash_pick(seed, 1 << 20, F.col("traj_id")))).withColumn("negative_type", F.lit("wrong_param")).withColumn("wrong_tool", F.lit(None).cast("string"))
    wrong = wrong.withColumn("rejected_messages", M.swap_final(F.col("messages"), F.col("correct_tool"), F.col("wrong_params")))
    both = tool.withColumnRenamed("messages", "chosen_messages").select(*keep).unionByName(wrong.withColumnRenamed("messages", "chosen_messages").select(*keep))
    return both if target is None else both.orderBy(hash_order(seed, F.col("traj_id")), F.desc("negative_type")).limit(target)
