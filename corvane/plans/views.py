"""The domain's tables as projections of the driver's tables; SQL has the same under the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tools(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_brand").alias("registry"), F.col("p_partkey").alias("pos"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
            F.concat("p_type", F.lit(" size "), F.col("p_size").cast("string")).alias("description"), F.col("p_type").alias("category"),
        )

    def turns(self) -> DataFrame:
        return self.read("conversations").select("conv_id", "turn", "role", "text")

    def answers(self) -> DataFrame:
        e = self.read("events")
        call = F.concat(F.lit('{"tool": "'), "event_type", F.lit('", "params": '), "props", F.lit("}"))
        kind = F.col("event_id") % 7
        text = (
            F.when(kind == 0, F.concat(F.lit("THOUGHT only "), "event_type"))
            .when(kind == 1, F.concat(F.lit("```python\nprint(1)\n```\nFINAL("), call, F.lit(")")))
            .when(kind == 2, F.concat(F.lit('FINAL({"tool": "'), "event_type", F.lit('", "params": )')))
            .when(kind == 3, F.concat(F.lit("FINAL("), "event_type", F.lit(")")))
            .when(kind == 4, F.concat(F.lit('<code>\nprint(tools_registry.search("'), "event_type", F.lit('"))\n</code>\n<code>\nprint(1)')))
            .otherwise(F.concat(F.lit("THOUGHT: found it.\nFINAL("), call, F.lit(")")))
        )
        expected = F.when(F.col("event_id") % 5 == 0, "purchase").otherwise(F.col("event_type"))
        params = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": 7}')).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("{}"))
        return e.select("event_id", "user_id", "event_type", "props", "value", text.alias("text"), expected.alias("expected_tool"), params.alias("expected_params"), (F.col("event_id") % 3).alias("level"))

    def queries(self) -> DataFrame:
        d = self.read("documents")
        n = F.col("n_chars") % 60
        bucket = F.when(n <= 15, "small").when(n <= 30, "medium").otherwise("large")
        return d.select(F.col("doc_id").alias("ord"), F.col("text").alias("query"), F.concat(bucket, F.lit("_"), F.col("source")).alias("stratum"), "source", "n_chars")


#: The same projections as common table expressions of the SQL texts.
SQL = {
    "v_tools": "SELECT p_brand AS registry, p_partkey AS pos, replace(p_name, ' ', '_') AS name, p_type || ' size ' || CAST(p_size AS VARCHAR) AS description, p_type AS category FROM part",
    "v_answers": """SELECT event_id, user_id, event_type, props, value, event_id % 3 AS level,
  CASE event_id % 7
    WHEN 0 THEN 'THOUGHT only ' || event_type
    WHEN 1 THEN '```python' || chr(10) || 'print(1)' || chr(10) || '```' || chr(10) || 'FINAL({"tool": "' || event_type || '", "params": ' || props || '})'
    WHEN 2 THEN 'FINAL({"tool": "' || event_type || '", "params": )'
    WHEN 3 THEN 'FINAL(' || event_type || ')'
    WHEN 4 THEN '<code>' || chr(10) || 'print(tools_registry.search("' || event_type || '"))' || chr(10) || '</code>' || chr(10) || '<code>' || chr(10) || 'print(1)'
    ELSE 'THOUGHT: found it.' || chr(10) || 'FINAL({"tool": "' || event_type || '", "params": ' || props || '})' END AS text,
  CASE WHEN event_id % 5 = 0 THEN 'purchase' ELSE event_type END AS expected_tool,
  CASE event_id % 3 WHEN 0 THEN '{"k": 7}' WHEN 1 THEN props ELSE '{}' END AS expected_params
FROM events""",
    "v_queries": """SELECT doc_id AS ord, text AS query, source, n_chars,
  CASE WHEN n_chars % 60 <= 15 THEN 'small' WHEN n_chars % 60 <= 30 THEN 'medium' ELSE 'large' END || '_' || source AS stratum FROM documents""",
    "v_msgs": "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id",
}


def with_views(sql: str, *more: str) -> str:
    """The SQL text after the views that it names, and further expressions "name AS (...)"."""
    names = [n for n in SQL if n in sql or any(n in m for m in more)]
    parts = [f"{n} AS ({SQL[n]})" for n in names] + list(more)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql
