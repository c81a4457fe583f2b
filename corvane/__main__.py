"""Command line: python -m corvane <command> ...; files in and out are JSON, JSONL or Parquet folders.

Model and teacher replies are recorded beforehand; `evaluate`, `matrix` and `ground` take them as JSONL.
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import VERIFY_REPL, ReplConfig, settings
from .functions.labels import registry_bucket, source_label, stratum
from .operators import adapter, augment, evaluate, messages, negatives, repl, splits, verify
from .sources import readers, sinks
from .streaming.adapt import adapted

MESSAGES = "array<struct<role:string,content:string>>"
ROWS = f"traj_id string, query string, correct_tool string, predicted_tool string, registry string, registry_size int, source string, query_type string, turns int, params string, messages {MESSAGES}"
ANSWERS = "level int, registry string, query string, predicted_tool string, predicted_params string, code_validity double, turns_used int, success boolean, elapsed_seconds double"
ENTRIES = "uuid string, subset_name string, question string, target_tools string, tools string, messages string"


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Trajectories of JSONL inputs in order, with ord; a row without traj_id is named by its place."""
    rows = readers.read_jsonl(spark, *paths, ddl=ROWS)
    place = F.concat_ws(":", F.col("input").cast("string"), "line.path", F.col("line.block").cast("string"), F.col("line.row").cast("string"))
    return rows.withColumn("ord", F.struct("input", "line")).withColumn("traj_id", F.coalesce("traj_id", place)).drop("input", "line")


def _cases(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.load_cases(spark, a.queries, a.truth)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    tools, answers = readers.read_registry(spark, a.registries), readers.read_jsonl(spark, a.answers, ddl=ANSWERS).drop("input", "line")
    one = answers.where((F.col("level") == a.level) & (F.col("registry") == a.registry))
    cases = evaluate.keep_answerable(_cases(spark, a), tools, a.registry)
    results = evaluate.compare(evaluate.answered(cases, one, "query"))
    if a.rows:
        sinks.write_evaluation(results.drop("level", "registry"), evaluate.metrics(results), a.output)
        return
    sinks.evaluation_object(results.drop("level", "registry"), evaluate.metrics(results)).coalesce(1).write.mode("error").text(a.output)


def _matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    tools, answers = readers.read_registry(spark, a.registries), readers.read_jsonl(spark, a.answers, ddl=ANSWERS).drop("input", "line")
    made = evaluate.matrix(_cases(spark, a), answers, tools)
    sinks.write_matrix(made, a.output)
    print(sinks.summary_text(made.orderBy("level", "registry")))


def _limits(a: argparse.Namespace) -> ReplConfig:
    """The limits of code blocks that --config gives for --level, else those of verification."""
    if not a.config:
        return VERIFY_REPL
    with open(a.config, encoding="utf-8") as f:
        return ReplConfig.of(settings(f.read()), a.level)


def _ground(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = readers.read_jsonl(spark, a.replies, ddl="traj_id string, registry string, query string, raw string").drop("input", "line")
    with open(a.prompt, encoding="utf-8") as f:
        repl.ground(raw, readers.read_registry(spark, a.registries), f.read(), _limits(a)).write.mode("error").json(a.output)


def _adapt(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dataset:
        made = adapted(spark, a.dataset, a.output, a.max_examples, a.min_registry_size, a.max_registry_size, seed=a.seed)
        print(f"{made} examples in {a.output}/data")
        return
    turned = adapter.turns(readers.read_jsonl(spark, *a.input, ddl=ENTRIES).drop("input", "line"), a.min_registry_size, a.max_registry_size)
    chosen = adapter.first_examples(turned, a.max_examples, a.seed)
    adapter.trajectories(adapter.with_call_params(chosen)).write.mode("error").json(a.output)
    print(sinks.summary_text(adapter.skip_reasons(turned).orderBy("rank")))


def _verify(spark: SparkSession, a: argparse.Namespace) -> None:
    tools = readers.read_registry(spark, a.registries)
    run = repl.executed(_rows(spark, a.input), tools, _limits(a))
    expected = readers.read_truth(spark, *a.truth) if a.truth else None
    verdicts = readers.read_jsonl(spark, a.verdicts, ddl="traj_id string, passed boolean") if a.verdicts else None
    out = verify.verify(run, tools, expected, verdicts)
    sinks.write_verified(out, a.output)
    print(sinks.summary_text(verify.funnel(out).orderBy("reject_stage")))


def _augment(spark: SparkSession, a: argparse.Namespace) -> None:
    tools = readers.read_registry(spark, a.registries)
    rows = _rows(spark, a.input).withColumn("turns", F.coalesce("turns", messages.code_turns(F.col("messages"))))
    order = spark.createDataFrame([(n, i) for i, n in enumerate(a.order)], "registry string, ord int")
    given = readers.read_jsonl(spark, a.template_queries, ddl="name string, ord int, query string").drop("input", "line") if a.template_queries else spark.createDataFrame([], "name string, ord int, query string")
    made = augment.pipeline(rows.select("traj_id", "registry", "query", "correct_tool", "turns", "messages"), order, tools, given, a.target, a.seed)
    made.write.mode("error").json(a.output)


def _negatives(spark: SparkSession, a: argparse.Namespace) -> None:
    tools = readers.read_registry(spark, a.registries)
    required = tools.groupBy("registry", F.col("name").alias("correct_tool")).agg(F.max_by("required", "pos").alias("required"))
    rows = negatives.completed(_rows(spark, a.positives)).join(required, ["registry", "correct_tool"], "left")
    negatives.pairs(rows, tools, a.target, a.seed).write.mode("error").json(a.output)


def _split(spark: SparkSession, a: argparse.Namespace) -> None:
    key = stratum(registry_bucket(F.col("registry_size"), F.coalesce("registry", F.lit(""))), source_label(F.col("source"), F.col("query_type"), F.col("registry")))
    rows = _rows(spark, a.inputs).withColumn("stratum", key)
    manifest = splits.assign(rows, readers.sealed_queries(spark, *a.sealed) if a.sealed else None, a.test_ratio, a.dev_ratio, a.seed)
    labelled = splits.label(rows.drop("ord"), manifest)
    sinks.write_splits(labelled, manifest, a.output)
    print(sinks.summary_text(splits.sizes(labelled).orderBy("split")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description=re.sub(r"\s+", " ", __doc__.split("\n\n")[0]))
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.set_defaults(run=run)
        c.add_argument("--output", required=True)
        return c

    def limits(c: argparse.ArgumentParser) -> None:
        c.add_argument("--config", help="a file of settings with the limits of code blocks by level")
        c.add_argument("--level", type=int, default=1)

    for name, run, text in (("evaluate", _evaluate, "score one level on one registry"), ("matrix", _matrix, "score every level and registry that was recorded")):
        c = command(name, run, text)
        for flag in ("--registries", "--queries", "--truth", "--answers"):
            c.add_argument(flag, required=True)
        if name == "evaluate":
            c.add_argument("--level", type=int, default=1)
            c.add_argument("--registry", required=True)
            c.add_argument("--rows", action="store_true", help="results as lines beside the metrics, for more of them than one object holds")
    c = command("ground", _ground, "teacher texts as conversations with the registry's outputs")
    for flag in ("--registries", "--replies", "--prompt"):
        c.add_argument(flag, required=True)
    limits(c)
    c = command("adapt", _adapt, "entries of a dataset as trajectories")
    given = c.add_mutually_exclusive_group(required=True)
    given.add_argument("--input", nargs="+", help="JSONL files, taken as a whole")
    given.add_argument("--dataset", help="a folder of Parquet or JSONL files, read as a shuffled stream until there are enough examples; run again, it goes on")
    c.add_argument("--max-examples", type=int, default=10_000)
    c.add_argument("--min-registry-size", type=int, default=5)
    c.add_argument("--max-registry-size", type=int, default=100)
    c.add_argument("--seed", type=int, default=42)
    c = command("verify", _verify, "three stages, verified and rejected rows apart")
    c.add_argument("--input", nargs="+", required=True)
    c.add_argument("--registries", required=True)
    c.add_argument("--truth", nargs="*")
    c.add_argument("--verdicts")
    limits(c)
    c = command("augment", _augment, "re-grounded, template and paraphrased trajectories")
    c.add_argument("--input", nargs="+", required=True)
    c.add_argument("--registries", required=True)
    c.add_argument("--order", nargs="+", required=True, help="names of the registries, smallest first")
    c.add_argument("--template-queries")
    c.add_argument("--target", type=int, default=400, help="rows up to which paraphrases are made")
    c.add_argument("--seed", type=int, default=42)
    c = command("negatives", _negatives, "preference pairs")
    c.add_argument("--positives", nargs="+", required=True)
    c.add_argument("--registries", required=True)
    c.add_argument("--target", type=int)
    c.add_argument("--seed", type=int, default=42)
    c = command("split", _split, "train, dev and test rows and their manifest")
    c.add_argument("--inputs", nargs="+", required=True)
    c.add_argument("--sealed", nargs="*")
    c.add_argument("--dev-ratio", type=float, default=0.1)
    c.add_argument("--test-ratio", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=42)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.appName(f"corvane {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
