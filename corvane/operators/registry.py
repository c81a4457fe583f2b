"""Registry lookups. Tools are rows (registry, pos, name, description, category, schema); pos is the registry's order, and
of rows with one name in a registry the last is the one that get_schema finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(tools: DataFrame) -> DataFrame:
    """Names in registry order, repeated ones kept: sort by registry and pos to show them so."""
    return tools.select("registry", "pos", "name")


def counts(tools: DataFrame) -> DataFrame:
    return tools.groupBy("registry").agg(F.count("*").alias("n_tools"))


def searchable(name: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))


def search(tools: DataFrame, phrase: str | Column) -> DataFrame:
    """Tools whose name and description, joined by a space, hold the phrase in any case; an empty phrase finds all."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return tools.where(F.contains(searchable(F.col("name"), F.col("description")), F.lower(phrase))).select("registry", "pos", "name", "description")


def annotated(category: Column) -> Column:
    """The text of a tool's annotations that a category filter looks into."""
    return F.when(category.isNull(), F.lit("{}")).otherwise(F.concat(F.lit("{'category': '"), category, F.lit("'}")))


def by_category(tools: DataFrame, word: str | Column) -> DataFrame:
    word = F.lower(F.lit(word) if isinstance(word, str) else word)
    hit = F.contains(F.lower(annotated(F.col("category"))), word) | F.contains(F.lower(F.coalesce("description", F.lit(""))), word)
    return tools.where(hit).select("registry", "pos", "name", "description")


def last_by_name(tools: DataFrame) -> DataFrame:
    """One row for each (registry, name): the last in registry order."""
    rest = [c for c in tools.columns if c not in ("registry", "name")]
    last = F.max_by(F.struct(*rest), "pos").alias("_tool")
    return tools.groupBy("registry", "name").agg(last).select("registry", "name", "_tool.*")


def get_schema(tools: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(registry, name) with the tool's row, nulls where there is none."""
    return wanted.join(last_by_name(tools), ["registry", "name"], "left")


def summary(name: Column, description: Column) -> Column:
    """How a tool prints in the output of a code block."""
    return F.concat(F.lit('{"name": "'), name, F.lit('", "description": "'), F.coalesce(description, F.lit("")), F.lit('"}'))


def in_order(value: Column, pos: Column) -> Column:
    """Values of a group as an array in registry order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"])


def prompt_text(tools: DataFrame) -> DataFrame:
    """The list of all tools that a prompt without lookup carries."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("description", F.lit("")))
    return tools.groupBy("registry").agg(F.array_join(in_order(line, F.col("pos")), "\n").alias("tool_list"))


def by_group(tools: DataFrame) -> DataFrame:
    """Names by category in registry order; a tool without one is "general"."""
    return tools.groupBy("registry", F.coalesce("category", F.lit("general")).alias("category")).agg(F.count("*").alias("n_tools"), F.array_join(in_order(F.col("name"), F.col("pos")), ",").alias("names"))


def token_estimate(tools: DataFrame, text: Column, characters: float = 4.0) -> DataFrame:
    """Tokens that all tools would take in a prompt: characters of their JSON text by four."""
    return tools.groupBy("registry").agg(F.floor(F.sum(F.length(text)) / characters).alias("tokens"))
