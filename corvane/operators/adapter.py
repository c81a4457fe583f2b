"""Adapting a public tool-call dataset, whose fields are JSON in strings, to single-turn rows over a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROMPT, VERIFY_REPL
from ..functions import text as T
from ..functions.labels import adapter_registry, bound, category_of, hash_order, search_word
from ..functions.params import call_arguments
from . import registry as R

_TOOL = "struct<type:string,name:string,description:string,inputSchema:string,parameters:string,annotations:struct<category:string>,function:struct<name:string,description:string,parameters:string>>"
EMPTY_SCHEMA = '{"type": "object", "properties": {}}'


def _items(raw: Column) -> Column:
    """Tools of a JSON list in any of three shapes (our own, wrapped as a function, bare with parameters) as they stand; others
    and nameless ones are left out; null where it is no list."""
    return F.filter(F.from_json(raw, f"array<{_TOOL}>"), lambda t: F.coalesce(_name(t), F.lit("")) != "")


def _wrapped(t: Column) -> Column:
    return (t["type"] == "function") & t["function"].isNotNull()


def _named(t: Column) -> Column:
    return t["name"].isNotNull() & (t["inputSchema"].isNotNull() | t["parameters"].isNotNull())


def _name(t: Column) -> Column:
    return F.when(_named(t), t["name"]).when(_wrapped(t), t["function"]["name"])


def _described(items: Column, names: Column) -> Column:
    """(name, description, input_schema, category) of each of _items(), whose names are given."""
    def one(t: Column, i: Column) -> Column:
        own, name = t["name"].isNotNull() & t["inputSchema"].isNotNull(), F.get(names, i)
        return F.struct(
            name.alias("name"),
            F.coalesce(F.when(_named(t), t["description"]).otherwise(t["function"]["description"]), F.lit("")).alias("description"),
            F.coalesce(F.when(own, t["inputSchema"]).when(_wrapped(t), t["function"]["parameters"]).otherwise(t["parameters"]), F.lit(EMPTY_SCHEMA)).alias("input_schema"),
            F.when(own, t["annotations"]["category"]).otherwise(category_of(name)).alias("category"),
        )

    return F.transform(items, one)


def tools_of(raw: Column) -> Column:
    """Tools of a JSON list in any of its shapes as (name, description, input_schema, category)."""
    items = _items(raw)
    return _described(items, F.transform(items, _name))


def questions_of(raw: Column) -> Column:
    """A JSON list of questions, or a single one; blank text is none."""
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))
    return F.when(raw.startswith("["), listed).when(T.strip(raw) != "", F.array(raw)).otherwise(F.array().cast("array<string>"))


def targets_of(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), T.strip), lambda x: x != "")


def zipped(questions: Column, targets: Column) -> Column:
    """Pairs up to the shorter list's end."""
    n = F.least(F.size(questions), F.size(targets))
    return F.arrays_zip(F.slice(questions, 1, n).alias("question"), F.slice(targets, 1, n).alias("target"))


def resolve(target: Column, names: Column, slugs: Column | None = None) -> Column:
    """The registry's name for a target: itself; its part after "::"; else, in registry order, the first name that ends
    in "_" and the slug of that part or equals it. slugs: the names with "_" for "-" in lower case, where they are known."""
    slugs = _slugs(names) if slugs is None else slugs

    def named(part: Column) -> Column:
        own = F.concat(F.lit("_"), F.replace(F.replace(F.lower(part), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
        slugged = bound(own, lambda o: F.filter(names, lambda _, i: F.endswith(F.concat(F.lit("_"), F.get(slugs, i)), o)))
        return F.when(F.array_contains(names, part), part).otherwise(F.get(slugged, F.lit(0)))

    return F.when(F.array_contains(names, target), target).otherwise(bound(T.strip(F.element_at(F.split(target, "::"), -1)), named))


def _slugs(names: Column) -> Column:
    return F.transform(names, lambda n: F.replace(F.lower(n), F.lit("-"), F.lit("_")))


def turns(entries: DataFrame, least: int = 5, most: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Single-tool rows of entries(uuid, subset_name, question, target_tools, tools, messages), with a status for those
    that aren't usable: irrelevant, parse_fail, size_filter, build_fail, else ok. Parameters come from the first call of
    the tool in the entry. keep: further columns of entries to pass on. Tools are described last, so that what only counts
    rows never looks at more than their names."""
    parsed = entries.withColumn("_items", _items(F.col("tools"))).withColumn("_names", F.transform("_items", _name)).withColumn("_slugs", _slugs(F.col("_names")))
    asked = lambda p: F.struct(T.strip(p["question"]).alias("query"), resolve(p["target"], F.col("_names"), F.col("_slugs")).alias("tool"))
    parsed = parsed.withColumn("_pairs", F.transform(zipped(questions_of(F.col("question")), targets_of(F.coalesce("target_tools", F.lit("")))), asked))
    n = F.coalesce(F.size("_names"), F.lit(0))
    status = F.when(F.col("subset_name") == "irrelevant", "irrelevant").when((n <= 0) | (F.coalesce(F.size("_pairs"), F.lit(0)) <= 0), "parse_fail").when(~n.between(least, most), "size_filter").otherwise("ok")
    rows = parsed.withColumn("status", status).withColumn("registry_size", n).select("*", F.posexplode_outer("_pairs").alias("turn", "_pair")).where("turn IS NULL OR turn = 0 OR status = 'ok'")
    rows = rows.withColumn("query", F.col("_pair.query")).withColumn("correct_tool", F.col("_pair.tool"))
    rows = rows.withColumn("status", F.when((F.col("status") == "ok") & (F.col("correct_tool").isNull() | (F.coalesce("query", F.lit("")) == "")), "build_fail").otherwise(F.col("status")))
    out = rows.withColumn("registry", adapter_registry(F.col("registry_size"))).withColumn("source", F.lit("toucan"))
    return out.withColumn("tools", _described(F.col("_items"), F.col("_names"))).select("uuid", "turn", "status", "query", "correct_tool", "registry", "registry_size", "source", "tools", "messages", *keep)


def with_call_params(rows: DataFrame) -> DataFrame:
    """Adds params: the arguments, as JSON, of the first tool_call message whose name is the tool or ends in "-" and it. Each
    row reads its own messages, so it keeps them whatever its uuid."""
    calls = F.filter(F.from_json("messages", "array<struct<role:string,content:string>>"), lambda m: m["role"] == "tool_call")
    return rows.withColumn("params", F.coalesce(call_arguments(F.transform(calls, lambda m: m["content"]), "correct_tool"), F.lit("{}")))


def trajectories(rows: DataFrame) -> DataFrame:
    """Rows of with_call_params() with seven messages: prompt, query, a search for a word of the tool (else its first word,
    else all names) and what it prints, the tool's schema, the answer; the row's own tools are the registry. Rows whose
    tool isn't among them are left out."""
    tools, tool = F.col("tools"), F.col("correct_tool")
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    literal = lambda c: bound(F.to_json(F.array(c)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
    answer = lambda call, found: F.struct(call.alias("call"), found.alias("found"))

    def search(word: Column, texts: Column, otherwise: Column) -> Column:
        """The search for a word and what it prints; otherwise, where it finds nothing."""
        holding = lambda w: F.filter(tools, lambda t, i: F.contains(F.get(texts, i), w))
        said = lambda hits: listed(F.transform(hits, lambda t: R.summary(t["name"], t["description"])))
        call = F.concat(F.lit("print(tools_registry.search("), literal(word), F.lit("))"))
        return bound(bound(F.lower(word), holding), lambda hits: F.when(F.size(hits) > 0, answer(call, said(hits))).otherwise(otherwise))

    names = answer(F.lit("print(tools_registry.list_names())"), listed(F.transform(tools, lambda t: F.concat(F.lit("'"), t["name"], F.lit("'")))))
    second = lambda texts: bound(F.get(F.split(F.replace(tool, F.lit("_"), F.lit(" ")), r"\s+"), F.lit(0)), lambda w: search(w, texts, names))
    first = lambda texts: bound(search_word(F.col("query"), tool), lambda w: search(w, texts, second(texts)))
    asked = bound(F.transform(tools, lambda t: R.searchable(t["name"], t["description"])), first)
    own = F.element_at(F.filter(tools, lambda t: t["name"] == tool), -1)
    shown = lambda t: F.concat(F.lit('{"name": '), literal(tool), F.lit(', "description": '), literal(t["description"]), F.lit(', "inputSchema": '), t["input_schema"], F.lit("}"))
    schema = bound(own, shown)
    message = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("content"))
    output = lambda text: message("user", T.OUTPUT_MARK + ":\n", bound(text, lambda x: T.clipped(x, VERIFY_REPL.max_output_chars)))
    messages = bound(asked, lambda a: F.array(
        message("system", F.replace(F.lit(PROMPT), F.lit("{num_tools}"), F.size(tools).cast("string"))), message("user", F.col("query")),
        message("assistant", "THOUGHT: I search for what is asked.\n<code>\n", a["call"], "\n</code>"), output(a["found"]),
        message("assistant", "THOUGHT: I read what the tool takes.\n<code>\nprint(tools_registry.get_schema(", literal(tool), "))\n</code>"), output(schema),
        message("assistant", 'THOUGHT: This tool fits.\nFINAL({"tool": ', literal(tool), ', "params": ', F.col("params"), "})"),
    ))
    return rows.where(F.exists(tools, lambda t: t["name"] == tool)).withColumn("messages", messages).withColumn("turns", F.lit(2))


def first_examples(rows: DataFrame, most: int, seed: int | None = None) -> DataFrame:
    """At most so many usable rows: the first by entry and turn or, with a seed, by hash of these."""
    order = [F.col("uuid"), F.col("turn")]
    return rows.where("status = 'ok'").orderBy(*([hash_order(seed, *order)] if seed is not None else []), *order).limit(most)


def funnel(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n_turns"), F.count_distinct("uuid").alias("n_entries"))


def skip_reasons(rows: DataFrame) -> DataFrame:
    """Unusable rows by reason, the commonest first."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "status"))
    return rows.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n")).withColumn("rank", rank)
