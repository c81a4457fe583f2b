"""Writers: verified and rejected rows, splits with manifest, evaluation results, the level by registry summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import hash_order


def write_verified(df: DataFrame, path: str, mode: str = "error") -> None:
    """Below path, status=verified and status=rejected; rejected rows carry stage and reason."""
    status = F.when(F.col("reject_stage").isNull(), "verified").otherwise("rejected")
    df.withColumn("status", status).write.mode(mode).partitionBy("status").json(path)


def write_splits(labelled: DataFrame, manifest: DataFrame, path: str, mode: str = "error", seed: int = 42, files: int | None = None) -> None:
    """split=train, dev and test below path/rows, query to split below path/manifest. A split's rows are shuffled by seed: its files,
    read in the order of their names, give the rows in the order of their hash, however many files there are (`files`; else as
    many as partitions)."""
    order = [F.col("split"), hash_order(seed, F.to_json(F.struct(*labelled.columns)))]
    dealt = labelled.repartitionByRange(files, *order) if files else labelled.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode(mode).partitionBy("split").json(f"{path}/rows")
    manifest.select("query", "split").write.mode(mode).json(f"{path}/manifest")


def write_evaluation(results: DataFrame, metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Results with turns and seconds rounded to two places, and the metrics."""
    rounded = [F.round(c, 2).alias(c) if c in ("turns_used", "elapsed_seconds") else F.col(c) for c in results.columns]
    results.select(*rounded).write.mode(mode).json(f"{path}/results")
    metrics.write.mode(mode).json(f"{path}/metrics")


def evaluation_object(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row with the JSON object {metrics, results} of one run of a model over its test set, whose rows fit in one."""
    rounded = [F.round(c, 2).alias(c) if c in ("turns_used", "elapsed_seconds") else F.col(c) for c in results.columns]
    listed = results.agg(F.collect_list(F.struct(*rounded)).alias("results"))
    return metrics.select(F.struct(*metrics.columns).alias("metrics")).join(listed, how="cross").select(F.to_json(F.struct("metrics", "results")).alias("value"))


def write_matrix(matrix: DataFrame, path: str, mode: str = "error") -> None:
    """The summary object: a key level{L}_{registry} for each cell of evaluate.matrix(), with its metrics."""
    said = F.to_json(F.struct(*[c for c in matrix.columns if c != "cell"]))
    one = matrix.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "cell", F.lit('": '), said))), ", "), F.lit("}")).alias("value"))
    one.coalesce(1).write.mode(mode).text(path)


def matrix_key(level: Column, registry: Column) -> Column:
    return F.concat(F.lit("level"), level.cast("string"), F.lit("_"), registry)


def summary_text(metrics: DataFrame) -> str:
    """A small table for people; metrics has a row for each configuration."""
    lines = ["\t".join(metrics.columns)]
    return "\n".join(lines + ["\t".join(str(v) for v in r) for r in metrics.toLocalIterator()])
