"""Shared plumbing of the llm operators: Arrow maps, shared tables, hashing by doc_id."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1024, "16m"


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that memory doesn't depend on how long the texts are; smaller settings of the session stay.

    The settings count when a plan is run, so they can't be taken back here."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_columns(df: DataFrame, ddl: str, make: Callable[[], Callable]) -> DataFrame:
    """Map Arrow batches: make() runs once a task and returns f(*columns as lists) -> output columns or None."""
    tune(df.sparkSession)
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(*(c.to_pylist() for c in batch.columns))) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)
        if last := getattr(f, "close", None):
            for out in last():
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema_of(ddl))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null read as empty; every other column is left behind, whatever its name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session, as in tests, takes one below
    the warehouse; on a cluster that might be a folder of the driver alone, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return named.rstrip("/")


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the session's end removes it, if drop() hasn't."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, hadoop = _store(spark, path)
    store.deleteOnExit(hadoop)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that nothing will read any more."""
    for t in tables:
        store, hadoop = _store(t.sparkSession, t._shared_path)
        store.delete(hadoop, True)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows for which make()'s f(values of column) says true, with all their columns as they are; no shuffle."""
    tune(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([bool(x) for x in f(batch.column(at).to_pylist())]))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_of_id(column: str = "doc_id"):
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(ids' columns, text) for each id of a bounded table of ids; of texts that share an id, that with the smallest hash. So
    the rows are bounded by the ids, however often an id is repeated."""
    found = texts(docs).join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, where, rows: int) -> DataFrame:
    """(doc_id, y, text) of at most `rows` labelled documents, chosen by hash of the id; where filters the label rows.

    A doc_id labelled twice with different values is left out. The sample is bounded by `rows`, so it is broadcast.
    """
    pick = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & where)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
        .where("y = y2").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return one_text_each(docs, pick)
