"""Lineage-preserving augmentation: re-grounding on larger registries, templates, paraphrases, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PREFIXES, PROMPT, SYNONYMS
from ..functions import text as T
from ..functions.labels import hash_order, hash_pick
from ..sources import store
from . import messages as M
from . import registry as R
from . import repl

#: Stages in the order in which the first of equal rows wins.
STAGES = ("original", "reground", "template", "paraphrase")


def reground_pairs(rows: DataFrame, registries: DataFrame, tools: DataFrame) -> DataFrame:
    """Each row with every strictly larger registry that has its correct_tool; registries(registry, ord), an unknown source
    counts as smallest. The table of registries is a short configuration, one row for each name."""
    source = registries.select("registry", F.col("ord").alias("_ord"))
    larger = registries.select(F.col("registry").alias("to_registry"), "ord")
    known = rows.join(source, "registry", "left").withColumn("_ord", F.coalesce("_ord", F.lit(-1)))
    having = tools.select(F.col("registry").alias("to_registry"), F.col("name").alias("correct_tool")).distinct().join(larger, "to_registry")
    return known.join(having, "correct_tool").where(F.col("_ord") < F.col("ord")).withColumn("augmentation", F.concat(F.lit("reground:"), "registry", F.lit("→"), "to_registry")).drop("_ord", "ord")


def _prompted(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """Rows whose tool is in their registry, with the prompt for its number of tools as _prompt."""
    sizes = R.counts(tools).withColumn("_prompt", F.replace(F.lit(PROMPT), F.lit("{num_tools}"), F.col("n_tools").cast("string"))).drop("n_tools")
    have = tools.select("registry", F.col("name").alias("correct_tool")).distinct()
    return rows.join(have, ["registry", "correct_tool"], "left_semi").join(sizes, "registry")


def reground(rows: DataFrame, registries: DataFrame, tools: DataFrame) -> DataFrame:
    """Trajectories rows(traj_id, registry, correct_tool, messages, ...) on each larger registry that has their tool: system
    prompt of that registry, old outputs dropped, each block answered anew."""
    moved = reground_pairs(rows, registries, tools).withColumn("traj_id", F.concat("traj_id", F.lit("→"), "to_registry")).withColumn("registry", F.col("to_registry")).drop("to_registry")
    said = F.transform("messages", lambda m: F.when(m["role"] == "system", F.struct(m["role"].alias("role"), F.col("_prompt").alias("content"))).otherwise(m))
    return repl.replayed(_prompted(moved, tools).withColumn("messages", said).drop("_prompt"), tools)


def _literal(text: Column) -> Column:
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def template(asked: DataFrame, tools: DataFrame, seed: int = 42) -> DataFrame:
    """Trajectories of asked(traj_id, registry, query, correct_tool, category, params): search or, for two in five of those
    with a category, filter by it; then the schema; then the answer. Blocks are answered from the registry."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    code = lambda thought, call, arg: message("assistant", F.concat(F.lit(f"THOUGHT: {thought}\n<code>\nprint(tools_registry.{call}("), _literal(arg), F.lit("))\n</code>")))
    by_category = (F.coalesce("category", F.lit("")) != "") & (hash_pick(seed, 5, F.col("traj_id")) < 2)
    first = F.when(by_category, code("I look through the category first.", "filter_by_category", F.col("category"))).otherwise(code("I search for what is asked.", "search", F.replace("correct_tool", F.lit("_"), F.lit(" "))))
    second = code("I read what the tool takes.", "get_schema", F.col("correct_tool"))
    last = message("assistant", F.concat(F.lit('THOUGHT: This tool fits.\nFINAL({"tool": '), _literal(F.col("correct_tool")), F.lit(', "params": '), F.coalesce("params", F.lit("{}")), F.lit("})")))
    rows = _prompted(asked, tools).withColumn("messages", F.array(message("system", F.col("_prompt")), message("user", F.col("query")), first, second, last)).drop("_prompt")
    made = repl.replayed(rows, tools).withColumn("turns", M.code_turns(F.col("messages")))
    return made.withColumn("augmentation", F.concat(F.lit("template:"), "registry"))


def uncovered(tools: DataFrame, rows: DataFrame, least: int = 3) -> DataFrame:
    """Tools of (registry, name) with fewer than `least` rows."""
    n = rows.groupBy("registry", F.col("correct_tool").alias("name")).agg(F.count("*").alias("_n"))
    return tools.join(n, ["registry", "name"], "left").where(F.coalesce("_n", F.lit(0)) < least).withColumn("n_rows", F.coalesce("_n", F.lit(0))).drop("_n")


def capped(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each (registry, correct_tool), by hash of the query."""
    rank = F.row_number().over(Window.partitionBy("registry", "correct_tool").orderBy(hash_order(seed, F.col("query")), "query"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


#: Hex digits of the hash by which rows are dealt into buckets: 65,536 of them.
BUCKET_DIGITS = 4


def first_by_hash(rows: DataFrame, most: int, key: Column, *then: str) -> DataFrame:
    """The first `most` rows by key, a hash as hex digits, then by further columns, with their rank. Rows are counted by bucket of
    the hash, so that only the buckets up to the last row are ranked, each by itself."""
    keyed = rows.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_k"))  # at most 65,536 rows
    starts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).where(F.col("_before") < most).drop("_k")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", *then))
    ranked = keyed.join(F.broadcast(starts), "_bucket").withColumn("rank", F.col("_before") + place)
    return ranked.where(F.col("rank") <= most).drop("_key", "_bucket", "_before")


def fill_to(rows: DataFrame, have: int, target: int, seed: int = 42) -> DataFrame:
    """The first rows by hash, as many as are missing for the target; none where there are enough already."""
    return first_by_hash(rows, max(0, target - have), hash_order(seed, F.col("query")), "query")


def asked(tools: DataFrame, rows: DataFrame, queries: DataFrame, most: int = 3, enough: int = 4) -> DataFrame:
    """(registry, correct_tool, category, query) for tools with fewer than `most` rows: the first of queries(name, ord, query)
    for their name, where there are none three made from name and description; `most` of them, but not beyond `enough` rows
    of a tool. Of tools of one name the last counts."""
    given = queries.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda q: q["query"]).alias("_given"))
    words, said = F.replace("name", F.lit("_"), F.lit(" ")), F.lower(F.left("description", F.lit(60)))
    made = F.when(F.coalesce("description", F.lit("")) != "", F.array(F.concat(F.lit("Use "), words, F.lit(" for this")), F.concat(F.lit("I want you to "), said), F.concat(F.lit("Would you "), said)))
    made = made.otherwise(F.array(F.concat(F.lit("Use "), words, F.lit(" for this")), F.concat(F.lit("Call "), words), F.concat(F.lit("Start "), words)))
    last = R.last_by_name(tools)
    open_ = uncovered(last, rows, most).join(given, "name", "left")
    all_ = F.when(F.size(F.coalesce("_given", F.array().cast("array<string>"))) > 0, F.col("_given")).otherwise(made)
    return open_.select("registry", F.col("name").alias("correct_tool"), "category", F.explode(F.slice(all_, F.lit(1), F.least(F.lit(most), F.lit(enough) - F.col("n_rows")).cast("int"))).alias("query"))


def param_value(name: Column, kind: Column, query: Column) -> Column:
    """A likely value, as JSON, of a parameter: read from the query by the parameter's type and name, else a default."""
    def has(*words: str) -> Column:
        return F.greatest(*[F.contains(name, F.lit(w)) for w in words])

    text = (
        F.when(has("path", "file", "url", "directory"), F.coalesce(T.path_or_url(query), F.concat(F.lit("/example/"), name)))
        .when(has("message", "content", "text", "body"), F.substring(query, 1, 80))
        .when(has("title", "name", "subject"), F.coalesce(T.quoted(query), F.lit("Task from query")))
        .when(has("email", "to", "recipient"), F.coalesce(T.email_address(query), F.lit("user@example.com")))
        .otherwise(F.concat(name, F.lit("_value")))
    )
    kind = F.coalesce(kind, F.lit("string"))
    return F.when(kind == "string", F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)).when(kind.isin("integer", "number"), F.coalesce(F.regexp_replace(T.first_integer(query), "^0+(?=[0-9])", ""), F.lit("100"))).when(kind == "boolean", F.lit("true"))


def params_from_query(properties: Column, query: Column) -> Column:
    """JSON object of the values of properties (array of (name, type)); types without a rule are left out."""
    items = F.transform(properties, lambda p: F.struct(p["name"].alias("name"), param_value(p["name"], p["type"], query).alias("value")))
    said = F.transform(F.filter(items, lambda p: p["value"].isNotNull()), lambda p: F.concat(_literal(p["name"]), F.lit(": "), p["value"]))
    return F.concat(F.lit("{"), F.array_join(said, ", "), F.lit("}"))


def properties_of(schema: Column) -> Column:
    """(name, type) of each property of a tool's inputSchema, in its order. A property without a type is a string; one whose type
    isn't a single word has none."""
    listed = F.from_json(schema, "struct<inputSchema:struct<properties:map<string,string>>>")["inputSchema"]["properties"]

    def one(p: Column) -> Column:
        said = F.try_variant_get(F.try_parse_json(p["value"]), "$.type", "string")
        typed = F.array_contains(F.coalesce(F.json_object_keys(p["value"]), F.array().cast("array<string>")), "type")
        return F.struct(p["key"].alias("name"), F.when(typed, F.coalesce(said, F.lit(""))).otherwise("string").alias("type"))

    return F.transform(F.map_entries(listed), one)


def filled(asked: DataFrame, tools: DataFrame) -> DataFrame:
    """asked(registry, correct_tool, query, ...) with params: a value, read from the query, for each property of the tool's
    schema; of tools of one name the last counts, and a tool without properties takes none."""
    last = R.last_by_name(tools.select("registry", "name", "pos", "schema")).select("registry", F.col("name").alias("correct_tool"), properties_of(F.col("schema")).alias("_properties"))
    return asked.join(last, ["registry", "correct_tool"], "left").withColumn("params", F.coalesce(params_from_query(F.col("_properties"), F.col("query")), F.lit("{}"))).drop("_properties")


def without_prefix(query: Column) -> Column:
    """The query without a leading request such as "Please "."""
    out = query
    for p in reversed(PREFIXES):
        out = F.when(F.startswith(F.lower(query), F.lit(p.lower())), F.substring(query, len(p) + 1, 1 << 30)).otherwise(out)
    return out


def reworded(query: Column, seed: int = 42) -> Column:
    """Each word with a synonym is replaced by one of them, by a coin and a choice that hash decides; a capital stays."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def word(w: Column, i: Column) -> Column:
        key = F.regexp_replace(F.lower(w), r"^[.,!?]+|[.,!?]+$", "")
        found = F.try_element_at(table, key)
        new = F.get(found, hash_pick(seed + 1, F.greatest(F.size(found), F.lit(1)), query, i))
        new = F.when(F.substring(w, 1, 1).rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, 2, 1 << 30)))).otherwise(new)
        return F.when(found.isNotNull() & (hash_pick(seed, 2, query, i) == 1), new).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != ""), word), " ")


def with_new_prefix(query: Column, seed: int = 42) -> Column:
    """Another request in front of the bare query, whose first letter becomes small; never the one it had."""
    bare = without_prefix(query)
    options = F.filter(F.array(*map(F.lit, PREFIXES)), lambda p: ~F.startswith(F.lower(query), F.lower(p)))
    return F.concat(F.get(options, hash_pick(seed, F.size(options), query)), F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))


def paraphrases(query: Column, seed: int = 42, most: int = 2) -> Column:
    """Up to `most` different variants: two rewordings, then a new prefix; none of an empty query."""
    words = F.filter(F.array(reworded(query, seed), reworded(query, seed + 100)), lambda v: v != F.array_join(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != ""), " "))
    all_ = F.array_distinct(F.concat(words, F.array(with_new_prefix(query, seed))))
    return F.when(F.coalesce(query, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(all_, 1, most))


def expand_paraphrases(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows(query, messages, ...) once for each variant, in the query and in its first user message."""
    return _varied(rows, seed).withColumn("augmentation", F.lit("paraphrase")).drop("_at")


def _varied(rows: DataFrame, seed: int) -> DataFrame:
    """The same with _at, the number of the variant."""
    out = rows.select("*", F.posexplode(paraphrases(F.col("query"), seed)).alias("_at", "_variant"))
    at = F.array_min(F.filter(F.transform("messages", lambda m, i: F.when((m["role"] == "user") & (m["content"] == F.col("query")), i)), lambda i: i.isNotNull()))
    messages = F.transform("messages", lambda m, i: F.when(i == at, F.struct(m["role"].alias("role"), F.col("_variant").alias("content"))).otherwise(m))
    return out.withColumn("messages", messages).withColumn("query", F.col("_variant")).drop("_variant")


def deduplicate(rows: DataFrame, *order: str) -> DataFrame:
    """The first row, by the columns in order, of each (query, correct_tool, registry)."""
    rank = F.row_number().over(Window.partitionBy("query", "correct_tool", "registry").orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def union_stages(**stages: DataFrame) -> DataFrame:
    """All stages with their ordinal, for deduplicate(..., "stage", ...)."""
    out = None
    for i, name in enumerate(STAGES):
        if name in stages:
            part = stages[name].withColumn("stage", F.lit(i))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def augmented(rows: DataFrame, registries: DataFrame, tools: DataFrame, asked: DataFrame, seed: int = 42) -> DataFrame:
    """Originals, then all that reground(), template() (of asked) and expand_paraphrases() (of the originals) make of them, without a
    target; of equal (query, correct_tool, registry) the first stays."""
    made = union_stages(original=rows, reground=reground(rows, registries, tools), template=template(asked, tools, seed), paraphrase=expand_paraphrases(rows, seed))
    return deduplicate(made, "stage", "traj_id")


def pipeline(rows: DataFrame, registries: DataFrame, tools: DataFrame, queries: DataFrame | None = None, target: int = 400, seed: int = 42) -> DataFrame:
    """Stages in order, each over what those before it have made; every made row passes quick_check.

    0: rows(traj_id, registry, query, correct_tool, messages, ...); 1: these on each larger registry that has their tool; 2:
    templates, with parameters from the schema, for tools of the registries with fewer than three rows so far, up to four of a
    tool; 3: paraphrases of any row so far, in seeded order, until there are `target` rows: none where there are. Of equal
    (query, correct_tool, registry) the first stays. What stages 1 and 2 have is written once and counted from there."""
    passed = lambda df: df.where(M.quick_check(F.col("messages"), F.col("correct_tool")))
    given = queries if queries is not None else rows.sparkSession.createDataFrame([], "name string, ord int, query string")
    rows = store.table(rows, "originals")
    grounded = store.table(union_stages(original=rows, reground=passed(reground(rows, registries, tools))), "grounded")
    wanted = filled(asked(tools.join(registries.select("registry").distinct(), "registry", "left_semi"), grounded, given), tools)
    wanted = wanted.withColumn("traj_id", F.concat(F.lit("template:"), F.md5(F.concat_ws("|", "registry", "correct_tool", "query").cast("binary"))))
    made = passed(template(wanted, tools, seed)).withColumn("stage", F.lit(STAGES.index("template")))
    so_far = store.table(grounded.unionByName(made, allowMissingColumns=True), "made")
    missing = target - so_far.count()
    if missing > 0:
        varied = passed(_varied(so_far, seed)).withColumn("stage", F.lit(STAGES.index("paraphrase")))
        varied = varied.withColumn("augmentation", F.concat(F.lit("paraphrase:"), F.coalesce("augmentation", F.lit("original"))))
        chosen = first_by_hash(varied, missing, hash_order(seed, F.col("traj_id"), F.col("registry")), "traj_id", "_at").drop("rank", "_at")
        so_far = so_far.unionByName(chosen.withColumn("traj_id", F.concat("traj_id", F.lit("~"), F.md5(F.col("query").cast("binary")))))
    return deduplicate(so_far, "stage", "traj_id")


def coverage(rows: DataFrame) -> DataFrame:
    """By registry: rows, different tools, and fewest and most rows of a tool."""
    by_tool = rows.groupBy("registry", "correct_tool").agg(F.count("*").alias("n"))
    return by_tool.groupBy("registry").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_tools"), F.min("n").alias("least"), F.max("n").alias("most"))
