"""Conversations as arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def assemble(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """turns(conv_id, turn, role, text) as one row for each conversation, its messages in order of turn."""
    items = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(by).agg(F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def role_at(messages: Column, i: int) -> Column:
    return F.get(messages, F.lit(i))["role"] if i >= 0 else F.get(messages, F.size(messages) + i)["role"]


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def last_of_role(messages: Column, role: str = "assistant") -> Column:
    """Content of the last message of a role, null if there is none."""
    found = of_role(messages, role)
    return F.get(found, F.size(found) - 1)["content"]


def last_index(messages: Column, hit) -> Column:
    """Index of the last message for which hit says true, -1 if none."""
    marks = F.transform(messages, lambda m, i: F.when(F.coalesce(hit(m), F.lit(False)), i).otherwise(-1))
    return F.coalesce(F.array_max(marks), F.lit(-1))


def replace_at(messages: Column, at: Column, content: Column) -> Column:
    """The messages with the content at an index replaced; -1 replaces none."""
    return F.transform(messages, lambda m, i: F.when(i == at, F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(m))


def code_turns(messages: Column) -> Column:
    """How many assistant messages hold a code tag."""
    return F.size(F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].contains("<code>")))


def loss_mask(messages: Column) -> Column:
    """1 for messages that a model learns to write, 0 for what it is given."""
    return F.transform(messages, lambda m: F.when(m["role"] == "assistant", 1).otherwise(0))


def swap_final(messages: Column, tool: Column, params: Column) -> Column:
    """Every FINAL({...}) of the last assistant message that has FINAL( names another tool; where none has braces, all
    from FINAL( on goes. Nothing in the new text is read as a pattern."""
    new = F.concat(F.lit('FINAL({"tool": "'), tool, F.lit('", "params": '), params, F.lit("})"))
    at = last_index(messages, lambda m: (m["role"] == "assistant") & m["content"].rlike(r"FINAL\s*\("))
    old = F.get(messages, at)["content"]
    parts = F.split(old, r"(?s)FINAL\s*\(\{.*?\}\)")
    swapped = F.when(F.size(parts) > 1, F.call_function("array_join", parts, new)).otherwise(F.concat(F.regexp_extract(old, r"(?s)^(.*?)FINAL\s*\(", 1), new))
    return F.when(at >= 0, replace_at(messages, at, swapped)).otherwise(messages)


def quick_check(messages: Column, tool: Column) -> Column:
    """Enough messages in the right order, and a last answer that has FINAL( and names the tool."""
    last = last_of_role(messages)
    return F.coalesce((F.size(messages) >= 4) & (role_at(messages, 0) == "system") & (role_at(messages, 1) == "user") & last.contains("FINAL(") & F.contains(last, F.coalesce(tool, F.lit(""))), F.lit(False))


def repl_turns(df: DataFrame, max_turns: int) -> DataFrame:
    """One row for each code block of the assistant messages of df(traj_id, messages), numbered over the trajectory;
    blocks beyond max_turns fail."""
    said = df.select("traj_id", F.posexplode("messages").alias("message", "m")).where("m.role = 'assistant'")
    blocks = said.select("traj_id", "message", F.posexplode(T.code_blocks(F.col("m.content"))).alias("block", "code"))
    from pyspark.sql import Window

    return blocks.withColumn("turn", F.row_number().over(Window.partitionBy("traj_id").orderBy("message", "block"))).withColumn("over", F.col("turn") > max_turns)
