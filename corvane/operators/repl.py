"""Code blocks of trajectories without running them: prints of literals and of the registry's answers to calls with literal
arguments, by way of variables too, are read from the syntax tree and answered by joins; anything else fails as unsupported.
That is a stated limit: no text is ever executed."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..config import VERIFY_REPL, ReplConfig
from ..functions import text as T
from ..sources import store
from . import messages as M
from . import registry as R

METHODS = {"list_names": 0, "count": 0, "get_tool_names_with_descriptions": 0, "search": 1, "get_schema": 1, "filter_by_category": 1}


def _call(node: ast.expr) -> tuple[str, str] | None:
    """(method, argument) of tools_registry.method("literal"), or ("print", text) of a literal."""
    match node:
        case ast.Call(ast.Attribute(ast.Name("tools_registry"), method), args, []) if METHODS.get(method) == len(args) and all(isinstance(a, ast.Constant) and isinstance(a.value, str) for a in args):
            return method, args[0].value if args else ""
        case ast.Constant(value):
            return "print", str(value)
    return None


def calls_of(code: str) -> list[tuple[str, str]] | None:
    """What a block prints, in order: registry calls and literals, themselves or as variables that were given them; None if it
    holds anything else."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out, names = [], {}
    for node in tree.body:
        match node:
            case ast.Expr(ast.Call(ast.Name("print"), [ast.Name(name)], [])) if name in names:
                out.append(names[name])
            case ast.Expr(ast.Call(ast.Name("print"), [value], [])) if (call := _call(value)):
                out.append(call)
            case ast.Assign([ast.Name(name)], value) if (call := _call(value)):
                names[name] = call
            case _:
                return None
    return out


@F.pandas_udf(ArrayType(StructType().add("method", StringType()).add("argument", StringType())))
def registry_calls(code: pd.Series) -> pd.Series:
    return code.map(lambda c: [{"method": m, "argument": a} for m, a in calls] if (calls := calls_of(c or "")) is not None else None)


def run_blocks(trajectories: DataFrame, tools: DataFrame, config: ReplConfig = VERIFY_REPL) -> DataFrame:
    """One row for each code block of trajectories(traj_id, registry, messages): message, block, turn, code, output,
    success, error."""
    blocks = M.repl_turns(trajectories, config.max_turns).join(trajectories.select("traj_id", "registry"), "traj_id")
    blocks = store.table(blocks.withColumn("calls", registry_calls("code")), "blocks")
    asked = blocks.where("NOT over").select("traj_id", "turn", "registry", F.posexplode("calls").alias("call", "c")).select("traj_id", "turn", "call", "registry", "c.method", "c.argument")
    distinct = asked.where("method <> 'print'").select("registry", "method", "argument").distinct()
    most = config.max_output_chars
    answers = asked.join(store.table(_answers(distinct, tools, most), "answers"), ["registry", "method", "argument"], "left")
    answers = answers.withColumn("chars", F.when(F.col("method") == "print", F.length("argument")).otherwise(F.col("chars"))).withColumn("answer", F.when(F.col("method") == "print", F.col("argument")).otherwise(F.col("answer")))
    lines = answers.groupBy("traj_id", "turn").agg(F.array_sort(F.collect_list(F.struct("call", "answer"))).alias("a"), F.coalesce(F.sum("chars") + F.count("chars") - 1, F.lit(0)).alias("chars"))
    printed = F.concat(F.array_join(F.transform("a", lambda x: x["answer"]), "\n"), F.lit("\n"))
    out = blocks.join(lines.select("traj_id", "turn", printed.alias("printed"), (F.col("chars") + 1).alias("chars")), ["traj_id", "turn"], "left")
    error = F.when(F.col("over"), "Maximum REPL turns exceeded").when(F.col("calls").isNull(), "Unsupported: only registry calls with literal arguments")
    plain = T.clipped(F.coalesce("printed", F.lit("")), most, F.coalesce("chars", F.lit(0)))
    return out.select("traj_id", "registry", "message", "block", "turn", "code", F.when(F.col("over"), "").otherwise(T.with_error(plain, error)).alias("output"), error.isNull().alias("success"), error.alias("error"))


#: Parts in which a registry's texts are compared with its calls.
TEXT_PARTS = 16


def _holding(tools: DataFrame, calls: DataFrame, wanted: Column, *texts: str) -> DataFrame:
    """tools with each of calls(registry, method, argument) that wants them, which the columns texts alone decide: what tools
    have in common is compared once. Comparing takes time and few bytes, so its partitions have a number of their own."""
    n = int(tools.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = tools.select("registry", *texts).distinct().withColumn("_part", F.pmod(F.xxhash64(*texts), F.lit(TEXT_PARTS)))
    asked = calls.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TEXT_PARTS - 1).cast("long"))))
    at = ["registry", "_part"]
    pairs = different.repartition(n, *at).join(asked.repartition(n, *at), at).where(wanted)
    return tools.join(store.table(pairs.drop("_part"), "holding"), ["registry", *texts])


def _answers(calls: DataFrame, tools: DataFrame, most: int) -> DataFrame:
    """What each call (registry, method, argument) prints: its first characters, `most` of them or more where there are as
    many, and how long all of it is. Only hits leave the join of calls and tools, and only as many of them are put together
    as an output can show; the others are counted."""
    call = ["registry", "method", "argument"]
    known = store.table(calls.join(R.counts(tools), "registry"), "calls")
    schemas = tools.where("name IS NOT NULL AND schema IS NOT NULL").groupBy("registry", F.col("name").alias("argument")).agg(F.max(F.struct("pos", "schema"))["schema"].alias("_schema"))
    single = known.where("method IN ('count', 'get_schema')").join(schemas, ["registry", "argument"], "left")
    single = single.select(*call, F.when(F.col("method") == "count", F.col("n_tools").cast("string")).otherwise(F.coalesce("_schema", F.lit("None"))).alias("answer"))
    listed = known.where("method NOT IN ('count', 'get_schema')").select(*call)
    name, description, arg = F.col("name"), F.coalesce("description", F.lit("")), F.lower("argument")
    looked = tools.where("name IS NOT NULL").select("registry", "pos", "name", R.summary(name, description).alias("_summary"), R.searchable(name, description).alias("_said"), R.annotated(F.lower("category")).alias("_annotated"), F.lower(description).alias("_described"))
    searched = _holding(looked, listed.where("method = 'search'"), F.contains("_said", arg), "_said")
    filtered = _holding(looked, listed.where("method = 'filter_by_category'"), F.contains("_annotated", arg) | F.contains("_described", arg), "_annotated", "_described")
    every = looked.join(listed.where("method NOT IN ('search', 'filter_by_category')"), "registry")
    item = F.when(F.col("method") == "list_names", F.concat(F.lit("'"), "name", F.lit("'"))).otherwise(F.col("_summary"))
    hits = searched.unionByName(filtered).unionByName(every).select(*call, "pos", item.alias("item"))
    totals = hits.groupBy(*call).agg((F.sum(F.length("item")) + 2 * F.count("*")).alias("chars"))
    # An item has two characters or more, and so has what follows it.
    place = F.row_number().over(Window.partitionBy(*call).orderBy("pos", "item"))
    shown = hits.withColumn("_place", place).where(F.col("_place") <= most // 4 + 1)
    shown = shown.groupBy(*call).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "item"))), lambda x: x["item"]), ", ").alias("_items"))
    found = listed.select(*call).join(shown, call, "left").join(totals, call, "left")
    lists = found.select(*call, F.concat(F.lit("["), F.coalesce("_items", F.lit("")), F.lit("]")).alias("answer"), F.coalesce("chars", F.lit(2)).cast("long").alias("chars"))
    return single.withColumn("chars", F.length("answer").cast("long")).unionByName(lists)


def _numbered(trajectories: DataFrame) -> DataFrame:
    """trajectories with _row, written once: blocks belong to a row, whatever its traj_id, and no retry numbers rows anew."""
    return store.table(trajectories.withColumn("_row", F.monotonically_increasing_id()), "trajectories")


def _outputs(rows: DataFrame, tools: DataFrame, config: ReplConfig) -> DataFrame:
    """By _row: _out, the outputs of each message's blocks by message, and how many blocks there are and failed."""
    blocks = run_blocks(rows.select(F.col("_row").alias("traj_id"), "registry", "messages"), tools, config)
    said = blocks.groupBy("traj_id", "message").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "output"))), lambda x: x["output"]).alias("out"), F.count("*").alias("n"), F.count_if(~F.col("success")).alias("bad"))
    return said.groupBy(F.col("traj_id").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("message", "out"))).alias("_out"), F.sum("n").alias("_n"), F.sum("bad").alias("_bad"))


def executed(trajectories: DataFrame, tools: DataFrame, config: ReplConfig = VERIFY_REPL) -> DataFrame:
    """trajectories with blocks and failed counted, and each message "[REPL OUTPUT]" after an assistant's code replaced by
    what its blocks print; an assistant turn without code leaves the next message as it is."""
    rows = _numbered(trajectories)
    out = rows.join(_outputs(rows, tools, config), "_row", "left")

    def real(i: Column) -> Column:
        said = F.array_join(F.try_element_at("_out", i - 1), "\n---\n")
        return F.when(T.strip(said) == "", "(no output)").otherwise(said)

    messages = F.transform("messages", lambda m, i: F.when((m["role"] == "user") & F.startswith(m["content"], F.lit(T.OUTPUT_MARK)) & real(i).isNotNull(), F.struct(m["role"].alias("role"), F.concat(F.lit(T.OUTPUT_MARK + ":\n"), real(i)).alias("content"))).otherwise(m))
    return out.withColumn("messages", F.when(F.col("_out").isNull(), F.col("messages")).otherwise(messages)).withColumn("blocks", F.coalesce("_n", F.lit(0))).withColumn("failed", F.coalesce("_bad", F.lit(0))).drop("_row", "_out", "_n", "_bad")


def replayed(trajectories: DataFrame, tools: DataFrame, config: ReplConfig = VERIFY_REPL) -> DataFrame:
    """trajectories(traj_id, registry, messages, ...) without their old outputs, and after each assistant message one new
    output for each of its code blocks; code_ok says whether all blocks succeeded (those that fail are kept)."""
    old = lambda m: (m["role"] == "user") & F.startswith(m["content"], F.lit(T.OUTPUT_MARK))
    rows = _numbered(trajectories.withColumn("messages", F.filter("messages", lambda m: ~F.coalesce(old(m), F.lit(False)))))
    out = rows.join(_outputs(rows, tools, config), "_row", "left")
    message = lambda content: F.struct(F.lit("user").alias("role"), F.concat(F.lit(T.OUTPUT_MARK + ":\n"), content).alias("content"))
    outputs = lambda i: F.coalesce(F.transform(F.try_element_at("_out", i), message), F.array().cast("array<struct<role:string,content:string>>"))
    whole = F.flatten(F.transform("messages", lambda m, i: F.concat(F.array(F.struct(m["role"].alias("role"), m["content"].alias("content"))), outputs(i))))
    return out.withColumn("messages", whole).withColumn("code_ok", F.coalesce("_bad", F.lit(0)) == 0).drop("_row", "_out", "_n", "_bad")


def ground(raw: DataFrame, tools: DataFrame, system_prompt: str, config: ReplConfig = VERIFY_REPL) -> DataFrame:
    """A teacher's text raw(traj_id, registry, query, raw) as a conversation with the registry's real outputs; rows
    without a JSON object as final answer are left out."""
    parts = raw.withColumn("messages", _conversation(F.col("raw"), F.col("query"), F.lit(system_prompt)))
    rows = parts.withColumn("_final", T.final_object(F.col("raw"))).where("_final IS NOT NULL")
    named = T.parse_answer(F.col("_final"))
    rows = rows.withColumn("_answer", named).withColumn("predicted_tool", F.coalesce("_answer.tool", T.tool_field(F.col("_final")))).withColumn("predicted_params", F.col("_answer.params"))
    out = executed(rows.where("predicted_tool IS NOT NULL"), tools, config)
    return out.withColumn("turns", F.col("blocks")).drop("_final", "_answer", "raw")


def _conversation(raw: Column, query: Column, prompt: Column) -> Column:
    """Prompt and query, then for each closed code block its thought and the block, with a place for its output, and
    last the text up to the final answer."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    codes = F.regexp_extract_all(raw, F.lit(r"(?s)<code>(.*?)</code>"), F.lit(1))
    prose = F.split(raw, r"(?s)<code>.*?</code>")
    said = F.transform(codes, lambda c, i: T.strip(F.concat(T.strip(F.get(prose, i)), F.lit("\n<code>\n"), T.strip(c), F.lit("\n</code>"))))
    turns = F.flatten(F.transform(said, lambda s: F.array(message("assistant", s), message("user", F.lit(T.OUTPUT_MARK + ":\n")))))
    last = F.get(prose, F.size(prose) - 1)
    end = T.strip(F.regexp_extract(last, r"(?s)^(.*?FINAL\(\{.*?\}\))", 1))
    return F.concat(F.array(message("system", prompt), message("user", query)), turns, F.array(message("assistant", F.when(end == "", T.strip(last)).otherwise(end))))


def fold(replies: DataFrame, max_turns: int = 10) -> DataFrame:
    """Recorded replies(conv_id, turn, text) of a model under the loop's rules: a final answer inside a code block ends
    it, one outside only where the reply has no code; later replies don't count. Gives answer, turns_used, success."""
    blocks = T.code_blocks(F.col("text"))
    inside = F.get(F.filter(F.transform(blocks, lambda b: T.final_answer(b)), lambda x: x.isNotNull()), F.lit(0))
    answer = F.coalesce(inside, F.when(F.size(blocks) == 0, T.final_answer(F.col("text"))))
    ends = replies.where(F.col("turn") < max_turns).withColumn("answer", answer)
    got = ends.groupBy("conv_id").agg(F.min(F.when(F.col("answer").isNotNull(), F.struct("turn", "answer"))).alias("end"))
    out = replies.select("conv_id").distinct().join(got, "conv_id", "left")
    return out.select("conv_id", F.col("end.answer").alias("answer"), F.coalesce((F.col("end.turn") + 1).cast("int"), F.lit(max_turns)).alias("turns_used"), F.col("end").isNotNull().alias("success"))


def zero_shot(replies: DataFrame) -> DataFrame:
    """One reply each: the final answer, or else the whole reply; a success only with a final answer."""
    final = T.final_answer(F.col("text"))
    return replies.select("conv_id", F.coalesce(final, F.col("text")).alias("answer"), F.lit(1).alias("turns_used"), final.isNotNull().alias("success"))
