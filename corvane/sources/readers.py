"""Readers of registries, cases and trajectories in JSON and JSONL. Order is kept in columns: pos, ord."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from . import schema as S


def tools_from_text(text: Column) -> Column:
    """Tools of a JSON list, or of an object with a list "tools", as texts."""
    return F.when(strip(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.from_json(text, "struct<tools:array<string>>")["tools"])


def tools(texts: DataFrame) -> DataFrame:
    """texts(registry, text) as rows (registry, pos, name, description, category, schema, required, properties)."""
    rows = texts.select("registry", F.posexplode(tools_from_text(F.col("text"))).alias("pos", "schema"))
    rows = rows.withColumn("t", F.from_json("schema", S.TOOL)).withColumn("s", F.from_json("t.inputSchema", "struct<required:array<string>,properties:map<string,string>>"))
    return rows.select("registry", F.col("pos").cast("long").alias("pos"), F.col("t.name").alias("name"), F.col("t.description").alias("description"), F.col("t.annotations.category").alias("category"), "schema", F.coalesce("s.required", F.array().cast("array<string>")).alias("required"), F.col("s.properties").alias("properties"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry files; the file's name without ending names the registry."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return tools(spark.read.text(path, wholetext=True).select(name.alias("registry"), F.col("value").alias("text")))


def read_registry_text(spark: SparkSession, registry: str, text: str) -> DataFrame:
    return tools(spark.createDataFrame([(registry, text)], "registry string, text string"))


def read_jsonl(spark: SparkSession, *paths: str, ddl: str = S.TRAJECTORY, missing_ok: bool = True) -> DataFrame:
    """Rows of JSONL inputs in the order given, blank lines left out, with input and line to order by; a missing input is
    skipped. line is a struct that sorts as the lines stand: by file name, block of the file, and row in it."""
    parts = []
    for i, path in enumerate(paths):
        try:
            lines = spark.read.text(path)
        except AnalysisException as e:
            if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        lines = lines.select(F.lit(i).alias("input"), place.alias("line"), F.col("value"))
        parts.append(lines.where(strip(F.col("value")) != ""))
    if not parts:
        return spark.createDataFrame([], f"input int, line struct<path:string,block:long,row:long>, {ddl}")
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("input", "line", F.from_json("value", ddl).alias("r")).select("input", "line", "r.*")


def _listed(spark: SparkSession, path: str, key: str, ddl: str) -> DataFrame:
    """Objects of a JSON file that is a list, or an object with the list under a key, with ord."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    items = F.when(strip(F.col("value")).startswith("["), F.from_json("value", f"array<struct<{_types(ddl)}>>")).otherwise(F.from_json("value", f"struct<{key}:array<struct<{_types(ddl)}>>>")[key])
    return text.select(F.posexplode(items).alias("ord", "r")).select("ord", "r.*")


def _types(ddl: str) -> str:
    return ",".join(":".join(c.strip().split(" ", 1)) for c in ddl.split(","))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "queries", S.QUERY)


def read_truth(spark: SparkSession, *paths: str) -> DataFrame:
    """(query, expected_tool, expected_params, ord): of equal queries the last, by file and place, is the one that counts."""
    parts = [_listed(spark, p, "selections", S.TRUTH).withColumn("ord", F.col("ord") + F.lit(i << 32)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def load_cases(spark: SparkSession, queries: str, truth: str) -> DataFrame:
    from ..operators.evaluate import with_truth

    cases = with_truth(read_queries(spark, queries).drop("expected_tool"), read_truth(spark, truth))
    return cases.withColumn("category", F.coalesce("category", F.lit("simple"))).withColumn("difficulty", F.coalesce("difficulty", F.lit("easy")))


def sealed_queries(spark: SparkSession, *paths: str) -> DataFrame:
    """Different non-blank queries, stripped, of the files."""
    rows = reduce(DataFrame.unionByName, [read_queries(spark, p).select(strip(F.col("query")).alias("query")) for p in paths])
    return rows.where("query <> ''").distinct()


def seeds(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Seed queries with their own expected tool, else the truth's; without either they are left out."""
    last = truth.groupBy("query").agg(F.max_by("expected_tool", "ord").alias("_t"))
    out = queries.join(last, "query", "left").withColumn("expected_tool", F.coalesce("expected_tool", "_t")).drop("_t")
    return out.where("expected_tool IS NOT NULL")


def prefixes(tools_: DataFrame, sizes: dict[str, int | None]) -> DataFrame:
    """Registries made of the first tools of one full list."""
    return reduce(DataFrame.unionByName, [(tools_ if n is None else tools_.where(F.col("pos") < n)).withColumn("registry", F.lit(name)) for name, n in sizes.items()])


def system_prompt(template: str, num_tools: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{num_tools}"), num_tools.cast("string"))
