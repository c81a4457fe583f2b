"""The registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROMPT, SYNONYMS
from ..functions import labels as L
from ..functions import params as P
from ..functions import text as T
from ..operators import adapter, augment, evaluate, messages, negatives, registry, repl, splits, training, verify
from ..sources import store
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *more: str):
    """Registers a function of Views under its name, with the SQL after the views it names."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *more)
        return f

    return add


# Registry lookups


@query("SELECT registry, pos, name FROM v_tools")
def registry_list_names(v):
    return registry.names(v.tools())


@query("SELECT registry, count(*) AS n_tools FROM v_tools GROUP BY registry")
def registry_count(v):
    return registry.counts(v.tools())


@query("SELECT registry, CAST(floor(sum(length(name) + length(description) + length(category)) / 4.0) AS BIGINT) AS tokens FROM v_tools GROUP BY registry")
def registry_tokens(v):
    return registry.token_estimate(v.tools(), F.concat("name", "description", "category"))


@query("SELECT registry, row_number() OVER (PARTITION BY registry ORDER BY pos) - 1 AS pos, name, description, category FROM v_tools")
def registry_from_json(v):
    """Each registry written as one JSON object and read by the registry reader."""
    from ..sources import readers

    one = F.struct("pos", F.struct("name", "description", F.struct("category").alias("annotations")).alias("t"))
    listed = v.tools().groupBy("registry").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("tools"))
    texts = listed.select("registry", F.to_json(F.struct("tools")).alias("text"))
    return readers.tools(texts).select("registry", "pos", "name", "description", "category")


@query("SELECT registry, pos, name, description FROM v_tools WHERE contains(lower(name || ' ' || description), 'red')")
def registry_search(v):
    return registry.search(v.tools(), "Red")


@query("SELECT registry, pos, name, description FROM v_tools WHERE contains(lower(name || ' ' || description), 'bolt economy')")
def registry_search_straddle(v):
    return registry.search(v.tools(), "bolt ECONOMY")


@query("SELECT registry, pos, name, description FROM v_tools WHERE contains(lower('{''category'': ''' || category || '''}'), 'small') OR contains(lower(description), 'small')")
def registry_category(v):
    return registry.by_category(v.tools(), "Small")


@query("SELECT registry, name, max(pos) AS pos, arg_max(description, pos) AS description, arg_max(category, pos) AS category FROM v_tools GROUP BY registry, name")
def registry_schema_last_wins(v):
    return registry.last_by_name(v.tools())


@query("SELECT registry, category, count(*) AS n_tools, string_agg(name, ',' ORDER BY pos) AS names FROM v_tools GROUP BY registry, category")
def registry_group_category(v):
    return registry.by_group(v.tools())


@query("SELECT registry, string_agg('- ' || name || ': ' || description, chr(10) ORDER BY pos) AS tool_list FROM v_tools GROUP BY registry")
def registry_prompt_text(v):
    return registry.prompt_text(v.tools())


@query("SELECT registry, '[' || string_agg('{\"name\": \"' || name || '\", \"description\": \"' || description || '\"}', ', ' ORDER BY pos) || ']' AS printed FROM v_tools GROUP BY registry")
def registry_summaries(v):
    item = registry.summary(F.col("name"), F.col("description"))
    return v.tools().groupBy("registry").agg(F.concat(F.lit("["), F.array_join(registry.in_order(item, F.col("pos")), ", "), F.lit("]")).alias("printed"))


# Text of answers

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "SELECT event_id, CASE WHEN len(tagged) > 0 THEN array_to_string(list_filter(list_transform(tagged, lambda b: " + _STRIP.format("b") + "), lambda b: b <> ''), '##') ELSE array_to_string(list_filter(list_transform(fenced, lambda b: " + _STRIP.format("b") + "), lambda b: b <> ''), '##') END AS blocks FROM b",
    r"b AS (SELECT event_id, regexp_extract_all(text, '(?s)<code>\s*\n?(.*?)(?:</code>|\z)', 1) AS tagged, regexp_extract_all(text, '(?s)```(?:repl|python)?\n(.*?)(?:```|\z)', 1) AS fenced FROM v_answers)",
)
def extract_code_blocks(v):
    return v.answers().select("event_id", F.array_join(T.code_blocks(F.col("text")), "##").alias("blocks"))


@query(r"SELECT event_id, CASE WHEN regexp_matches(text, '(?sm)FINAL\((.+)\)\s*$') THEN " + _STRIP.format(r"regexp_extract(text, '(?sm)FINAL\((.+)\)\s*$', 1)") + " END AS answer FROM v_answers")
def extract_final(v):
    return v.answers().select("event_id", T.final_answer(F.col("text")).alias("answer"))


@query(r"SELECT event_id, CASE WHEN regexp_matches(text, '(?s)FINAL\((\{.*?\})\)') THEN regexp_extract(text, '(?s)FINAL\((\{.*?\})\)', 1) END AS object FROM v_answers")
def extract_final_lazy(v):
    return v.answers().select("event_id", T.final_object(F.col("text")).alias("object"))


@query("""SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE event_type END AS tool,
  CASE WHEN event_id % 7 IN (1, 5, 6) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM v_answers""")
def answer_tool_params(v):
    said = v.answers().withColumn("p", T.parse_answer(T.final_answer(F.col("text"))))
    return said.select("event_id", F.col("p.tool").alias("tool"), F.get_json_object("p.params", "$.k").cast("long").alias("k"))


@query(r"""SELECT event_id, CASE WHEN regexp_matches(text, '"tool"\s*:\s*"([^"]+)"') THEN regexp_extract(text, '"tool"\s*:\s*"([^"]+)"', 1) END AS tool FROM v_answers""")
def answer_tool_field(v):
    return v.answers().select("event_id", T.tool_field(F.col("text")).alias("tool"))


@query("""SELECT event_id, array_to_string(list_filter(['a', '', event_type, ' '], lambda x: trim(x) <> ''), '|') AS items FROM v_answers""")
def answer_listed_strings(v):
    raw = F.concat(F.lit('Here you are: ["a", "", "'), "event_type", F.lit('", " "] as asked'))
    return v.answers().select("event_id", F.array_join(T.listed_strings(raw), "|").alias("items"))


@query("SELECT ord, CASE WHEN length(query) > 500 THEN left(query, 500) || chr(10) || '... [TRUNCATED, ' || CAST(length(query) AS VARCHAR) || ' total chars]' ELSE query END AS output FROM v_queries")
def truncate_output(v):
    return v.queries().select("ord", T.clipped(F.col("query"), 500).alias("output"))


@query("SELECT ord, CASE WHEN ord % 4 = 0 THEN query || chr(10) || '[ERROR: NameError: x]' ELSE query END AS output FROM v_queries")
def error_suffix(v):
    return v.queries().select("ord", T.with_error(F.col("query"), F.when(F.col("ord") % 4 == 0, "NameError: x")).alias("output"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(html, '(/[\w/.-]+|https?://[\w/.-]+)') THEN regexp_extract(html, '(/[\w/.-]+|https?://[\w/.-]+)', 1) END AS path, CASE WHEN regexp_matches(html, '\b(\d+)\b') THEN regexp_extract(html, '\b(\d+)\b', 1) END AS number FROM pages")
def extract_path_and_number(v):
    return v.read("pages").select("page_id", T.path_or_url(F.col("html")).alias("path"), T.first_integer(F.col("html")).alias("number"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[''"]([^''"]+)[''"]') THEN regexp_extract(text, '[''"]([^''"]+)[''"]', 1) END AS quoted,
  CASE WHEN regexp_matches(text, '[\w.+-]+@[\w.-]+') THEN regexp_extract(text, '[\w.+-]+@[\w.-]+') END AS address FROM documents""")
def extract_quoted_and_address(v):
    return v.read("documents").select("doc_id", T.quoted(F.col("text")).alias("quoted"), T.email_address(F.col("text")).alias("address"))


# Evaluation


@query("""SELECT q.ord, coalesce(t.quality, '') AS expected_tool FROM v_queries q LEFT JOIN t ON q.ord = t.doc_id""", "t AS (SELECT doc_id, CAST(max(quality) AS VARCHAR) AS quality FROM labels GROUP BY doc_id)")
def eval_join_cases(v):
    truth = v.read("labels").select(F.col("doc_id").cast("string").alias("query"), F.col("quality").alias("ord"), F.col("quality").cast("string").alias("expected_tool"), F.lit("{}").alias("expected_params"))
    cases = v.queries().select("ord", F.col("ord").cast("string").alias("query"))
    return evaluate.with_truth(cases, truth).select("ord", "expected_tool")


@query("SELECT event_id, expected_tool FROM v_answers WHERE expected_tool IN ('click', 'view') OR expected_tool = 'DISCOVERY'")
def eval_semi_filter(v):
    tools = v.spark.createDataFrame([("r", "click"), ("r", "view"), ("r", "view")], "registry string, name string")
    return evaluate.keep_answerable(v.answers().select("event_id", "expected_tool"), tools, registry="r", discovery=True)


_COMPARED = """c AS (SELECT *, CASE WHEN event_id % 7 IN (1, 3, 5, 6) THEN event_type END AS predicted_tool,
  CASE WHEN event_id % 7 IN (1, 5, 6) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM v_answers),
r AS (SELECT *, coalesce(predicted_tool = expected_tool, false) AS tool_correct, event_id % 7 IN (1, 3, 5, 6) AS success,
  coalesce(predicted_tool = expected_tool, false) AND (expected_params = '{}' OR coalesce(k = CAST(json_extract(expected_params, '$.k') AS BIGINT), false)) AS params_correct,
  CASE WHEN level = 0 THEN 1.0 WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS code_validity, 1 + event_id % 4 AS turns_used FROM c)"""


def _compared(v):
    said = T.parse_answer(T.final_answer(F.col("text")))
    rows = v.answers().withColumn("p", said).withColumn("predicted_tool", F.col("p.tool")).withColumn("predicted_params", F.col("p.params"))
    rows = evaluate.compare(rows).withColumn("success", T.final_answer(F.col("text")).isNotNull() & (F.col("event_id") % 7 != 2))
    return rows.withColumn("code_validity", F.when(F.col("level") == 0, 1.0).when(F.col("event_id") % 2 == 0, 0.5).otherwise(0.0)).withColumn("turns_used", 1 + F.col("event_id") % 4)


@query("SELECT event_id, tool_correct, params_correct FROM r", _COMPARED)
def eval_params_match(v):
    return _compared(v).select("event_id", "tool_correct", "params_correct")


_RATES = "round(avg(tool_correct::INT), 4) AS tool_selection_accuracy, round(avg(params_correct::INT), 4) AS parameter_correctness, round(avg(code_validity), 4) AS repl_code_validity, round(avg((tool_correct AND params_correct)::INT), 4) AS end_to_end_accuracy, round(avg(turns_used), 2) AS avg_turns, round(avg((NOT success)::INT), 4) AS failure_rate, count(*) AS total_queries"


@query(f"SELECT {_RATES} FROM r", _COMPARED)
def eval_metrics(v):
    return evaluate.metrics(_compared(v))


@query(f"SELECT level, event_type, 'level' || level || '_' || event_type AS cell, {_RATES} FROM r GROUP BY level, event_type", _COMPARED)
def eval_metrics_by_group(v):
    from ..sources.sinks import matrix_key

    return evaluate.metrics(_compared(v), "level", "event_type").withColumn("cell", matrix_key(F.col("level"), F.col("event_type")))


@query(f"SELECT level, 'r' || level AS registry, 'level' || level || '_r' || level AS cell, {_RATES}, round(sum(value), 1) AS total_time FROM (SELECT r.*, e.value FROM r JOIN events e USING (event_id)) WHERE expected_tool IN ('click', 'view', 'purchase') GROUP BY level", _COMPARED)
def eval_matrix(v):
    """Recorded answers of levels on registries, over the cases that each registry can answer."""
    tools = v.spark.createDataFrame([(f"r{level}", n) for level in range(3) for n in ("click", "view", "view", "purchase")], "registry string, name string")
    said = _compared(v).withColumn("query", F.col("event_id").cast("string")).withColumn("registry", F.concat(F.lit("r"), F.col("level").cast("string")))
    answers = said.select("level", "registry", "query", "predicted_tool", "predicted_params", "code_validity", "turns_used", "success", F.col("value").alias("elapsed_seconds"))
    cases = said.select("query", "expected_tool", "expected_params", F.col("registry").alias("_of"))
    # Every case belongs to one registry here, so that the matrix has each answer once.
    cells = [evaluate.matrix(cases.where(F.col("_of") == f"r{i}").drop("_of"), answers.where(F.col("registry") == f"r{i}"), tools) for i in range(3)]
    return cells[0].unionByName(cells[1]).unionByName(cells[2])


@query("SELECT user_id, round(avg((event_type <> 'error')::INT), 6) AS code_validity FROM v_answers GROUP BY user_id")
def eval_code_validity(v):
    return evaluate.validity(v.answers().withColumn("success", F.col("event_type") != "error"), "user_id").withColumn("code_validity", F.round("code_validity", 6))


@query("SELECT registry, round(1 - 50.0 / floor(sum(length(name) + length(description)) / 4.0), 6) AS savings FROM v_tools GROUP BY registry")
def eval_context_savings(v):
    tokens = registry.token_estimate(v.tools(), F.concat("name", "description"))
    return tokens.select("registry", F.round(evaluate.context_savings(F.lit(50.0), F.col("tokens")), 6).alias("savings"))


# Conversations


@query("SELECT conv_id, len(messages) AS n_messages, array_to_string(list_transform(messages, lambda m: m.role), ',') AS roles, md5(array_to_string(list_transform(messages, lambda m: m.content), '|')) AS digest FROM v_msgs")
def messages_assemble(v):
    m = messages.assemble(v.turns())
    return m.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda x: x["content"]), "|").cast("binary")).alias("digest"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id")
def messages_last_assistant(v):
    return messages.assemble(v.turns()).select("conv_id", messages.last_of_role(F.col("messages")).alias("last_answer"))


@query("SELECT c.conv_id, turn, role, CASE WHEN turn = last THEN 'replaced' ELSE text END AS content FROM conversations c JOIN (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id) l ON c.conv_id = l.conv_id")
def messages_replace_last(v):
    m = messages.assemble(v.turns())
    at = messages.last_index(F.col("messages"), lambda x: x["role"] == "assistant")
    new = m.withColumn("messages", messages.replace_at(F.col("messages"), at, F.lit("replaced")))
    return new.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


@query("SELECT conv_id, CAST(count(*) FILTER (role = 'assistant' AND contains(text, 'the')) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def messages_turn_count(v):
    said = F.col("messages")
    return messages.assemble(v.turns()).select("conv_id", F.size(F.filter(messages.of_role(said, "assistant"), lambda m: m["content"].contains("the"))).cast("long").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask FROM conversations")
def loss_mask(v):
    m = messages.assemble(v.turns())
    return m.select("conv_id", F.posexplode(messages.loss_mask(F.col("messages"))).alias("turn", "mask")).withColumn("turn", F.col("turn").cast("long"))


# Verification

_STAGE1 = """s AS (SELECT conv_id, CASE WHEN len(messages) < 4 THEN 'too few messages' WHEN messages[1].role <> 'system' THEN 'first message is not system'
  WHEN messages[2].role <> 'user' THEN 'second message is not user' WHEN messages[-1].role <> 'assistant' THEN 'last message is not assistant' ELSE 'ok' END AS reason FROM v_msgs)"""


@query("SELECT conv_id, reason FROM s", _STAGE1)
def verify_stage1(v):
    return messages.assemble(v.turns()).select("conv_id", F.coalesce(verify.role_reason(F.col("messages")), F.lit("ok")).alias("reason"))


@query("SELECT reason, count(*) AS n FROM s GROUP BY reason", _STAGE1)
def verify_stage1_funnel(v):
    return verify_stage1(v).groupBy("reason").agg(F.count("*").alias("n"))


_FORMAT = """m AS (SELECT event_id, event_type, expected_tool, expected_params, text, 1 + event_id % 14 AS turns, props,
  event_id % 11 = 0 AS headless, event_id % 7 IN (1, 5, 6) AS has_object FROM v_answers),
f AS (SELECT *, CASE WHEN headless THEN 'too few messages' WHEN NOT contains(text, 'FINAL(') THEN 'no final answer' WHEN turns > 12 THEN 'too many turns'
  WHEN NOT has_object THEN 'final answer is no object' END AS r1,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS blocks, event_id % 4 % 3 AS failed FROM m)"""

_TRAJ = _FORMAT + """,
g AS (SELECT *, CASE WHEN blocks = 0 THEN 'no code blocks' WHEN failed * 2 > blocks THEN 'code error rate too high: ' || failed || '/' || blocks END AS r2,
  CASE WHEN event_type <> expected_tool THEN 'wrong tool' WHEN expected_tool = 'signup' THEN 'tool is not in the registry'
       WHEN expected_params = '{"k": 7}' AND json_extract(props, '$.k') IS DISTINCT FROM CAST('7' AS JSON) THEN 'unexpected parameter value' END AS r3 FROM f)"""


def _trajectories(v):
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    head = F.array(m("system", F.lit("Use <code> tags.")), m("user", F.col("event_type")), m("user", F.lit("go on")))
    rows = v.answers().withColumn("messages", F.when(F.col("event_id") % 11 == 0, F.array(m("assistant", F.col("text")))).otherwise(F.concat(head, F.array(m("assistant", F.col("text"))))))
    blocks = F.when(F.col("event_id") % 3 == 0, 0).otherwise(2)
    return rows.select(F.col("event_id").alias("traj_id"), F.lit("main").alias("registry"), F.col("event_type").alias("query"), F.col("expected_tool").alias("correct_tool"), (1 + F.col("event_id") % 14).cast("int").alias("turns"), "messages", blocks.alias("blocks"), (F.col("event_id") % 4 % 3).cast("int").alias("failed"), "expected_params", "props")


def _main_tools(v):
    return v.spark.createDataFrame([("main", i, n, ["k"]) for i, n in enumerate(("click", "view", "purchase", "error"))], "registry string, pos int, name string, required array<string>")


def _reasons(v):
    rows = _trajectories(v).join(F.broadcast(_main_tools(v).select(F.col("name").alias("correct_tool"), "required", F.lit(True).alias("known"))), "correct_tool", "left")
    final = T.final_object(messages.last_of_role(F.col("messages")))
    return verify.staged(
        rows,
        verify.format_reason(F.col("messages"), F.col("turns")),
        verify.execution_reason(F.col("blocks"), F.col("failed")),
        verify.semantic_reason(F.col("correct_tool"), final, F.col("known"), F.col("required"), F.when(F.col("expected_params") == '{"k": 7}', P.as_map(F.col("expected_params")))),
    )


@query("SELECT event_id AS traj_id, CASE WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3 END AS reject_stage, coalesce(r1, r2, r3) AS reject_reason FROM g", _TRAJ)
def verify_final_status(v):
    return _reasons(v).select("traj_id", "reject_stage", "reject_reason")


@query("SELECT coalesce(CASE WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3 END, 0) AS reject_stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM g GROUP BY 1", _TRAJ)
def verify_funnel(v):
    return verify.funnel(_reasons(v))


_WHOLE = _FORMAT + """,
w AS (SELECT *, CASE WHEN blocks = 0 THEN 'no code blocks' WHEN failed * 2 > blocks THEN 'code error rate too high: ' || failed || '/' || blocks END AS r2,
  CASE WHEN event_type <> expected_tool THEN 'wrong tool' WHEN expected_tool = 'signup' THEN 'tool is not in the registry'
       WHEN event_type = 'purchase' AND json_extract(props, '$.k') IS DISTINCT FROM CAST('7' AS JSON) THEN 'unexpected parameter value' WHEN event_id % 13 = 0 THEN 'judged wrong' END AS r3 FROM f)"""


def _recorded(v):
    """Expected parameters by query, and verdicts."""
    expected = v.spark.createDataFrame([("purchase", 0, '{"k": 1}'), ("purchase", 1, '{"k": 7}'), ("view", 0, "{}")], "query string, ord int, expected_params string")
    verdicts = v.read("events").where("event_id % 13 = 0 OR event_id % 13 = 5").select(F.col("event_id").alias("traj_id"), (F.col("event_id") % 13 == 5).alias("passed"))
    return expected, verdicts


@query("SELECT event_id AS traj_id, CASE WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3 END AS reject_stage, coalesce(r1, r2, r3) AS reject_reason FROM w", _WHOLE)
def verify_pipeline(v):
    """verify.verify() itself, with strict JSON, expected parameters by query (the last one counts) and recorded verdicts."""
    return verify.verify(_trajectories(v), _main_tools(v), *_recorded(v)).select("traj_id", "reject_stage", "reject_reason")


@query("SELECT event_id AS traj_id, NOT headless AND contains(text, 'FINAL(') AND contains(text, expected_tool) AS ok FROM m", _FORMAT)
def verify_quick(v):
    return _trajectories(v).select("traj_id", messages.quick_check(F.col("messages"), F.col("correct_tool")).alias("ok"))


@query("SELECT event_id, event_id % 4 <> 1 AND event_id % 4 <> 2 AS ok FROM events")
def verify_required_params(v):
    kind = F.col("event_id") % 4
    given = F.when(kind == 1, F.lit("{}")).when(kind == 2, F.lit('{"k": "  "}')).otherwise(F.col("props"))
    return v.read("events").select("event_id", P.has_required(F.array(F.lit("k")), P.as_map(given)).alias("ok"))


@query("SELECT event_id, event_id % 4 <> 1 OR json_extract(props, '$.k') = CAST('16.0' AS JSON) AS ok FROM events")
def verify_expected_params(v):
    kind = F.col("event_id") % 4
    value = F.get_json_object("props", "$.k")
    expected = F.create_map(F.lit("k"), F.when(kind == 0, F.concat(F.lit("  "), value)).when(kind == 1, F.lit("16.0")).otherwise(value))
    expected = F.when(kind == 3, F.create_map().cast("map<string,string>")).otherwise(expected)
    return v.read("events").select("event_id", P.match(expected, P.as_map(F.col("props")), stripped=True).alias("ok"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') * 5 * 2 > count(*) * 2 THEN 'code error rate too high: ' || count(*) FILTER (event_type = 'error') * 5 || '/' || count(*) * 2 END AS reason FROM events GROUP BY user_id")
def verify_error_rate(v):
    n = v.read("events").groupBy("user_id").agg((F.count("*") * 2).alias("blocks"), (F.count_if(F.col("event_type") == "error") * 5).alias("failed"))
    return n.select("user_id", verify.execution_reason(F.col("blocks"), F.col("failed")).alias("reason"))


@query("""SELECT event_id AS traj_id, CAST(CASE event_id % 7 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS blocks, 0::BIGINT AS failed,
  '[REPL OUTPUT]:' || chr(10) || CASE event_id % 7 WHEN 1 THEN '1' || chr(10) WHEN 4 THEN CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN '[{"name": "' || event_type || '", "description": "does ' || event_type || '"}]' ELSE '[]' END || chr(10) || chr(10) || '---' || chr(10) || '1' || chr(10) ELSE 'old' END AS output FROM events""")
def verify_code_blocks(v):
    """Blocks of recorded answers answered from the registry; SQL knows what these blocks are."""
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = v.answers().select(F.col("event_id").alias("traj_id"), F.lit("main").alias("registry"), F.array(m("user", F.col("event_type")), m("assistant", F.col("text")), m("user", F.lit("[REPL OUTPUT]:\nold"))).alias("messages"))
    tools = _main_tools(v).withColumn("description", F.concat(F.lit("does "), "name")).withColumn("category", F.lit(None).cast("string")).withColumn("schema", F.col("name"))
    return repl.executed(rows, tools).select("traj_id", "blocks", "failed", F.get("messages", F.lit(2))["content"].alias("output"))


@query("""SELECT event_id AS traj_id, CAST(m AS INT) AS message, CAST(b AS INT) AS block, CAST(m / 2 * n + b + 1 AS INT) AS turn, m / 2 * n + b + 1 > 3 AS over
FROM (SELECT event_id, CASE event_id % 7 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS n FROM events), (SELECT unnest([0, 2]) AS m), (SELECT unnest([0, 1]) AS b) WHERE b < n""")
def repl_turn_numbers(v):
    """Blocks of two answers of one conversation, numbered over both; those after the third are over the limit."""
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = v.answers().select(F.col("event_id").alias("traj_id"), F.array(m("assistant", F.col("text")), m("user", F.lit("and?")), m("assistant", F.col("text"))).alias("messages"))
    return messages.repl_turns(rows, 3).select("traj_id", F.col("message").cast("int").alias("message"), F.col("block").cast("int").alias("block"), "turn", "over")


@query("SELECT event_id AS traj_id, event_type AS predicted_tool, CASE WHEN event_id % 7 = 1 THEN 1 ELSE 0 END::BIGINT AS turns, 3 AS n_messages FROM events WHERE event_id % 7 IN (1, 5, 6)")
def ground_replies(v):
    """Teacher texts as conversations; those without a JSON object as answer are left out."""
    raw = v.answers().select(F.col("event_id").alias("traj_id"), F.lit("main").alias("registry"), F.col("event_type").alias("query"), F.col("text").alias("raw"))
    tools = _main_tools(v).withColumn("description", F.lit("d")).withColumn("category", F.lit(None).cast("string")).withColumn("schema", F.col("name"))
    return repl.ground(raw, tools, "Use <code> tags.").select("traj_id", "predicted_tool", "turns", F.size("messages").alias("n_messages"))


@query("SELECT conv_id, CASE WHEN min(turn) FILTER (contains(text, 'the')) IS NOT NULL THEN CAST(min(turn) FILTER (contains(text, 'the')) + 1 AS INT) ELSE 10 END AS turns_used, min(turn) FILTER (contains(text, 'the')) IS NOT NULL AS success FROM conversations GROUP BY conv_id")
def model_loop(v):
    said = F.when(F.contains("text", F.lit("the")), F.lit("FINAL(x)")).otherwise(F.lit("<code>\nprint(1)\n</code> FINAL"))
    return repl.fold(v.turns().withColumn("text", said)).select("conv_id", "turns_used", "success")


@query(r"SELECT event_id AS conv_id, CASE WHEN regexp_matches(text, '(?sm)FINAL\((.+)\)\s*$') THEN " + _STRIP.format(r"regexp_extract(text, '(?sm)FINAL\((.+)\)\s*$', 1)") + r" ELSE text END AS answer, regexp_matches(text, '(?sm)FINAL\((.+)\)\s*$') AS success FROM v_answers")
def zero_shot(v):
    return repl.zero_shot(v.answers().select(F.col("event_id").alias("conv_id"), "text")).select("conv_id", "answer", "success")


# Splits

_FIRST = "fs AS (SELECT query, arg_min(stratum, ord) AS stratum FROM v_queries GROUP BY query)"
# A query is sealed if it holds, or is, the text of an item of the benchmark.
_HELD = "SELECT DISTINCT query FROM v_queries WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(query, b.text))"
_SPLIT = _FIRST + f""", se AS ({_HELD}),
sp AS (SELECT fs.query, stratum, se.query IS NOT NULL AS sealed FROM fs LEFT JOIN se ON fs.query = se.query),
ra AS (SELECT *, count(*) OVER (PARTITION BY stratum, sealed) AS n, row_number() OVER (PARTITION BY stratum, sealed ORDER BY md5('42|' || query), query) AS k FROM sp),
asg AS (SELECT query, stratum, CASE WHEN sealed THEN 'test' WHEN n < 3 THEN 'train' WHEN k <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS INT)) THEN 'test'
  WHEN k <= 2 * greatest(1, CAST(floor(n * 0.1::DOUBLE) AS INT)) THEN 'dev' ELSE 'train' END AS split FROM ra),
lab AS (SELECT q.*, asg.split FROM v_queries q JOIN asg ON q.query = asg.query)"""


def _sealed(v):
    return splits.holding(v.queries(), v.read("benchmark")).select("query")


def _labelled(v):
    rows = v.queries()
    return splits.label(rows, splits.assign(rows, _sealed(v)))


@query("SELECT ord, CASE WHEN n_chars % 60 <= 15 AND n_chars % 60 <> 0 THEN 'small' WHEN n_chars % 60 BETWEEN 16 AND 30 THEN 'medium' WHEN n_chars % 60 > 30 THEN 'large' ELSE CASE ord % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'large' END END AS bucket FROM v_queries")
def split_bucket(v):
    name = F.element_at(F.array(F.lit("small_10"), F.lit("reg_25"), F.lit("xlarge_100"), F.lit("other")), (F.col("ord") % 4 + 1).cast("int"))
    return v.queries().select("ord", L.registry_bucket(F.col("n_chars") % 60, name).alias("bucket"))


@query("SELECT ord, CASE WHEN source = 'src1' OR ord % 7 = 2 THEN 'toucan' WHEN ord % 3 = 0 THEN 'inhouse_discovery' ELSE 'inhouse' END AS label FROM v_queries")
def split_source_label(v):
    return v.queries().select("ord", L.source_label(F.when(F.col("source") == "src1", "toucan"), F.when(F.col("ord") % 3 == 0, "discovery").otherwise("selection"), F.when(F.col("ord") % 7 == 2, "toucan_12").when(F.col("ord") % 7 == 3, "my_toucan")).alias("label"))


@query("SELECT ord, CASE WHEN n_chars % 60 <= 15 THEN 'small' WHEN n_chars % 60 <= 30 THEN 'medium' ELSE 'large' END || '_' || CASE WHEN ord % 2 = 0 THEN 'inhouse' ELSE 'toucan' END AS stratum FROM v_queries WHERE n_chars % 60 > 0")
def split_stratum_key(v):
    made = L.stratum(L.registry_bucket(F.col("n_chars") % 60, F.lit("any")), L.source_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(F.col("ord") % 2 == 1, "toucan_5")))
    return v.queries().where("n_chars % 60 > 0").select("ord", made.alias("stratum"))


@query("SELECT stratum, count(*) AS n_queries FROM fs GROUP BY stratum", _FIRST)
def split_strata_sizes(v):
    return splits.first_stratum(v.queries()).groupBy("stratum").agg(F.count("*").alias("n_queries"))


@query("SELECT md5(query) AS query, stratum FROM fs", _FIRST)
def split_first_seen_stratum(v):
    return splits.first_stratum(v.queries()).withColumn("query", F.md5(F.col("query").cast("binary")))


@query("SELECT md5(query) AS query, stratum, split FROM asg", _SPLIT)
def split_assign(v):
    return splits.assign(v.queries(), _sealed(v)).withColumn("query", F.md5(F.col("query").cast("binary")))


@query("SELECT split, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM lab GROUP BY split", _SPLIT)
def split_sizes(v):
    return splits.sizes(_labelled(v))


@query("SELECT stratum, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM lab GROUP BY stratum", _SPLIT)
def split_stratum_pivot(v):
    return splits.by_stratum(_labelled(v))


@query("SELECT ord FROM v_queries WHERE query IN (SELECT text FROM benchmark)")
def split_sealed_exact(v):
    return v.queries().join(v.read("benchmark").select(F.col("text").alias("query")), "query", "left_semi").select("ord")


@query("SELECT ord FROM v_queries WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(query, b.text))")
def split_sealed_contains(v):
    return splits.holding(v.queries(), v.read("benchmark")).select("ord")


@query("SELECT count(*) AS n FROM (SELECT query FROM asg GROUP BY query HAVING count(DISTINCT split) > 1)", _SPLIT)
def split_leakage_check(v):
    return splits.leaks(splits.assign(v.queries(), _sealed(v))).agg(F.count("*").alias("n"))


@query("SELECT ord FROM v_queries WHERE query NOT IN (" + _HELD + ")")
def split_without_overlap(v):
    return splits.without_overlap(v.queries(), _sealed(v)).select("ord")


# Negatives

_STOPS = "'the','and','for','with','from','that','this','tool','will','can','use','get','set','create','update','delete','returns','list','all','any','one','two','three','given','used'"
_SCORES = f"""kw AS (SELECT registry, pos, name, list_distinct(list_filter(regexp_extract_all(lower(name || ' ' || description), '[a-z]{{3,}}'), lambda w: w NOT IN ({_STOPS}))) AS words FROM v_tools),
rw AS (SELECT registry, name AS correct_tool, arg_min(description, pos) AS said FROM v_tools GROUP BY registry, name),
rq AS (SELECT registry || '|' || correct_tool AS traj_id, registry, correct_tool, 'please find a ' || said AS query FROM rw),
ow AS (SELECT registry, name, arg_min(words, pos) AS own FROM kw GROUP BY registry, name),
sc AS (SELECT q.traj_id, k.name, k.pos, 2 * len(list_intersect(k.words, list_distinct(regexp_extract_all(lower(q.query), '[a-z]{{3,}}')))) - len(list_intersect(k.words, o.own)) AS score
  FROM rq q JOIN kw k ON q.registry = k.registry JOIN ow o ON o.registry = q.registry AND o.name = q.correct_tool WHERE k.name <> q.correct_tool),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY score DESC, pos) AS rank FROM sc) WHERE rank <= 3),
pk AS (SELECT traj_id, list(name ORDER BY rank) AS names FROM tp GROUP BY traj_id),
wt AS (SELECT traj_id, names[1 + ('0x' || substr(md5('42|' || traj_id), 1, 8))::BIGINT % len(names)] AS wrong_tool FROM pk)"""


def _asked(v):
    """A trajectory of every different tool of every registry, asked by its own (first) description."""
    rows = v.tools().groupBy("registry", F.col("name").alias("correct_tool")).agg(F.min_by("description", "pos").alias("_said"))
    return rows.select("registry", "correct_tool", F.concat("registry", F.lit("|"), "correct_tool").alias("traj_id"), F.concat(F.lit("please find a "), "_said").alias("query"))


def _pairs(v, target=None):
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    final = F.concat(F.lit('FINAL({"tool": "'), "correct_tool", F.lit('", "params": {"k": 1}})'))
    rows = _asked(v).withColumn("params", F.lit('{"k": 1}')).withColumn("required", F.array(F.lit("k"))).withColumn("messages", F.array(m("user", F.col("query")), m("assistant", final)))
    return negatives.pairs(rows, v.tools(), target=target)


@query("SELECT registry, pos, array_to_string(list_sort(words), ',') AS words FROM kw", _SCORES)
def neg_keywords(v):
    return v.tools().select("registry", "pos", F.array_join(F.array_sort(T.tool_keywords(F.col("name"), F.col("description"))), ",").alias("words"))


@query("SELECT traj_id, name, pos, CAST(score AS INT) AS score FROM sc", _SCORES)
def neg_candidate_scores(v):
    return negatives.candidate_scores(_asked(v), v.tools())


@query("SELECT traj_id, name, pos, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM tp", _SCORES)
def neg_top3(v):
    best = negatives.best(_asked(v), v.tools())
    return best.withColumn("score", F.col("score").cast("int"))


@query("SELECT traj_id, wrong_tool FROM wt", _SCORES)
def neg_wrong_tool_pairs(v):
    return negatives.wrong_tools(_asked(v), v.tools())


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 * k WHEN 2 THEN 10 * k WHEN 3 THEN -k ELSE 999 * k END AS k,
  CASE WHEN k = 0 OR (event_id % 5 = 1 AND k = 0) THEN 'injected_by_negative_generator' END AS extra FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def neg_wrong_params(v):
    e = v.read("events").withColumn("w", P.corrupt("props", F.array(F.lit("k")), F.col("event_id")))
    return e.select("event_id", F.get_json_object("w", "$.k").cast("long").alias("k"), F.get_json_object("w", "$._extra_wrong_param").alias("extra"))


@query("""SELECT event_id, CASE WHEN NOT contains(text, 'FINAL(') THEN text WHEN event_id % 7 IN (1, 5, 6) THEN regexp_replace(text, '(?s)FINAL\\s*\\(\\{.*?\\}\\)', 'FINAL({"tool": "no$1\\\\\\\\", "params": {}})')
  ELSE 'FINAL({"tool": "no$1\\\\", "params": {}})' END AS content FROM v_answers""")
def neg_swap_final(v):
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.array(m("user", F.lit("q")), m("assistant", F.col("text")), m("user", F.lit("thanks")))
    swapped = messages.swap_final(said, F.lit("no$1\\\\"), F.lit("{}"))
    return v.answers().select("event_id", F.get(swapped, F.lit(1))["content"].alias("content"))


@query("SELECT * FROM (SELECT traj_id, 'wrong_tool' AS negative_type FROM wt UNION ALL SELECT traj_id, 'wrong_param' FROM rq) ORDER BY md5('42|' || traj_id), negative_type DESC LIMIT 9", _SCORES)
def neg_target_limit(v):
    return _pairs(v, target=9).select("traj_id", "negative_type")


@query("SELECT negative_type, count(*) AS n FROM (SELECT 'wrong_tool' AS negative_type FROM wt UNION ALL SELECT 'wrong_param' FROM rq) GROUP BY 1", _SCORES)
def neg_type_counts(v):
    return _pairs(v).groupBy("negative_type").agg(F.count("*").alias("n"))


@query("SELECT traj_id, name, CAST(2 * len(list_intersect(words, list_distinct(regexp_extract_all(lower(query), '[a-z]{3,}')))) - len(list_intersect(words, own)) AS INT) AS score FROM (SELECT 'A' AS name, ['red', 'gear'] AS words UNION ALL SELECT 'B', ['large']) k, (SELECT traj_id, query, ['gear'] AS own FROM rq) q", _SCORES)
def neg_inline_tools(v):
    """Rows with tools of their own meet these only; the tool is the predicted one where there is no correct one."""
    tool = lambda n, d: F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"))
    rows = _asked(v).withColumn("predicted_tool", F.lit("C")).withColumn("correct_tool", F.lit("")).withColumn("params", F.lit("{}")).withColumn("messages", F.array().cast("array<struct<role:string,content:string>>"))
    rows = rows.withColumn("tools", F.array(tool("A", "red gear"), tool("B", "large"), tool("C", "gear")))
    return negatives.candidate_scores(*negatives.own_registries(negatives.completed(rows), v.tools())).select("traj_id", "name", "score")


# Dataset adapter


@query("""SELECT pos, CASE WHEN contains(n, 'read') OR contains(n, 'path') OR contains(n, 'file') OR contains(n, 'fs') THEN 'filesystem' WHEN contains(n, 'get') OR contains(n, 'api') THEN 'web'
  WHEN contains(n, 'pr') THEN 'code' ELSE 'general' END AS category FROM (SELECT pos, CASE pos % 4 WHEN 0 THEN 'thread_' ELSE 'wi' || 'dget_' END || CASE pos % 3 WHEN 0 THEN 'press' ELSE 'bolt' END AS n FROM v_tools)""")
def adapter_category_rules(v):
    name = F.concat(F.when(F.col("pos") % 4 == 0, "Thread_").otherwise("Widget_"), F.when(F.col("pos") % 3 == 0, "press").otherwise("bolt"))
    return v.tools().select("pos", L.category_of(name).alias("category"))


@query("""SELECT pos, coalesce(list_filter(words, lambda w: contains('a Blue bolt or Green gear' , w) OR contains(lower('a Blue bolt or Green gear'), w))[1], words[1]) AS word
FROM (SELECT pos, list_filter(string_split(lower(name), '_'), lambda w: length(w) > 2 AND w NOT IN ('get','set','create','read','write','list','make','run','use','do','a','the','to','from','with')) AS words FROM v_tools)""")
def adapter_keyword(v):
    return v.tools().select("pos", L.search_word(F.lit("a Blue bolt or Green gear"), F.col("name")).alias("word"))


@query("""SELECT pos, CASE pos % 4 WHEN 0 THEN 'blue_bolt' WHEN 1 THEN 'red_widget' WHEN 2 THEN 'srv-green_gear' END AS name FROM v_tools""")
def adapter_resolve_tool(v):
    target = F.element_at(F.array(F.lit("blue_bolt"), F.lit("Server::red_widget"), F.lit("Any Server::Green Gear"), F.lit("missing one")), (F.col("pos") % 4 + 1).cast("int"))
    names = F.array(F.lit("red_widget"), F.lit("srv-green_gear"), F.lit("other-green_gear"), F.lit("blue_bolt"))
    return v.tools().select("pos", adapter.resolve(target, names).alias("name"))


@query("""SELECT o_orderkey, i - 1 AS turn, ['first', 'second', 'third'][i] AS question, ['a', 'b'][i] AS target FROM orders, range(1, 3) t(i) WHERE i <= CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END""")
def adapter_zip_turns(v):
    kind = F.col("o_orderkey") % 3
    questions = adapter.questions_of(F.when(kind == 0, F.lit('["first", "second", "third"]')).when(kind == 1, F.lit("first")).otherwise(F.lit("  ")))
    pairs = adapter.zipped(questions, adapter.targets_of(F.lit(" a, b ,,")))
    return v.read("orders").select("o_orderkey", F.posexplode(pairs).alias("turn", "p")).select("o_orderkey", F.col("turn").cast("long").alias("turn"), "p.question", "p.target")


@query("SELECT ord, CASE WHEN n_chars % 90 <= 15 THEN 'toucan_' || n_chars % 90 WHEN n_chars % 90 <= 30 THEN 'toucan_medium' WHEN n_chars % 90 <= 60 THEN 'toucan_large' ELSE 'toucan_xlarge' END AS registry FROM v_queries")
def adapter_registry_label(v):
    return v.queries().select("ord", L.adapter_registry(F.col("n_chars") % 90).alias("registry"))


def _entries(v):
    tool = lambda n: F.concat(F.lit('{"type": "function", "function": {"name": "'), n, F.lit('", "description": "d", "parameters": {"type": "object"}}}'))
    listed = lambda n: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: tool(F.concat(F.lit("srv-fn_"), i.cast("string")))), ", "), F.lit("]"))
    k = F.col("o_orderkey")
    said = F.concat(F.lit("{'name': 'srv-fn_1', 'arguments': '{\"n\": "), k.cast("string"), F.lit(", \"flag\": true}'}"))
    call = F.to_json(F.array(F.struct(F.lit("tool_call").alias("role"), said.alias("content"))))
    return v.read("orders").select(
        k.cast("string").alias("uuid"), F.when(k % 10 == 0, "irrelevant").otherwise("multi-turn").alias("subset_name"), F.lit('["one", "two"]').alias("question"),
        F.when(k % 7 == 0, "S::nothing").otherwise("S::fn_1, S::fn 2").alias("target_tools"), F.when(k % 9 == 0, F.lit("not json")).otherwise(listed((2 + k % 8).cast("int"))).alias("tools"), call.alias("messages"),
    )


_ENTRY = """en AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'irrelevant' WHEN o_orderkey % 9 = 0 THEN 'parse_fail' WHEN 2 + o_orderkey % 8 < 5 THEN 'size_filter'
  WHEN o_orderkey % 7 = 0 THEN 'build_fail' ELSE 'ok' END AS status FROM orders)"""


@query("SELECT status, CAST(sum(CASE WHEN status = 'ok' THEN 2 ELSE 1 END) AS BIGINT) AS n_turns, count(*) AS n_entries FROM en GROUP BY status", _ENTRY)
def adapter_funnel(v):
    return adapter.funnel(adapter.turns(_entries(v)))


@query("SELECT status, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, status) AS INT) AS rank FROM en WHERE status <> 'ok' GROUP BY status", _ENTRY)
def adapter_skip_reasons(v):
    return adapter.skip_reasons(adapter.turns(_entries(v)))


@query("SELECT CAST(k AS VARCHAR) AS uuid, i AS turn, CASE i WHEN 0 THEN 'one' ELSE 'two' END AS query, CASE i WHEN 0 THEN 'srv-fn_1' ELSE 'srv-fn_2' END AS correct_tool, CASE i WHEN 0 THEN k END AS n FROM en, (SELECT 0 AS i UNION ALL SELECT 1) WHERE status = 'ok'", _ENTRY)
def adapter_call_params(v):
    rows = adapter.with_call_params(adapter.turns(_entries(v)).where("status = 'ok'"))
    return rows.select("uuid", F.col("turn").cast("int").alias("turn"), "query", "correct_tool", F.get_json_object("params", "$.n").cast("long").alias("n"))


@query("SELECT CAST(k AS VARCHAR) AS uuid, i AS turn FROM en, (SELECT 0 AS i UNION ALL SELECT 1) WHERE status = 'ok' ORDER BY md5('42|' || k || '|' || i), uuid, turn LIMIT 25", _ENTRY)
def adapter_first_examples(v):
    return adapter.first_examples(adapter.turns(_entries(v)), 25, seed=42).select("uuid", F.col("turn").cast("int").alias("turn"))


@query()
def adapter_trajectories(v):
    """Every usable entry as a conversation; the tests state its messages."""
    return adapter.trajectories(adapter.with_call_params(adapter.turns(_entries(v)).where("status = 'ok'"))).select("uuid", "turn", "query", "correct_tool", "turns", "messages")


@query(
    """SELECT CAST(k AS VARCHAR) AS uuid, i AS turn, 7 AS n_messages, md5(array_to_string([
  replace('""" + PROMPT + """', '{num_tools}', CAST(n AS VARCHAR)), CASE i WHEN 0 THEN 'one' ELSE 'two' END,
  'THOUGHT: I search for what is asked.' || chr(10) || '<code>' || chr(10) || 'print(tools_registry.search("srv"))' || chr(10) || '</code>',
  '[REPL OUTPUT]:' || chr(10) || '[' || array_to_string(list_transform(range(1, n + 1), lambda j: '{"name": "srv-fn_' || j || '", "description": "d"}'), ', ') || ']',
  'THOUGHT: I read what the tool takes.' || chr(10) || '<code>' || chr(10) || 'print(tools_registry.get_schema("' || tool || '"))' || chr(10) || '</code>',
  '[REPL OUTPUT]:' || chr(10) || '{"name": "' || tool || '", "description": "d", "inputSchema": {"type":"object"}}',
  'THOUGHT: This tool fits.' || chr(10) || 'FINAL({"tool": "' || tool || '", "params": ' || CASE i WHEN 0 THEN '{"n": ' || k || ', "flag": true}' ELSE '{}' END || '})'], '##')) AS digest
FROM (SELECT k, i, 2 + k % 8 AS n, 'srv-fn_' || (i + 1) AS tool FROM en, (SELECT 0 AS i UNION ALL SELECT 1) WHERE status = 'ok')""",
    _ENTRY,
)
def adapter_trajectory_messages(v):
    """All messages of adapter_trajectories, by their digest."""
    made = adapter_trajectories(v)
    said = F.array_join(F.transform("messages", lambda m: m["content"]), "##")
    return made.select("uuid", F.col("turn").cast("int").alias("turn"), F.size("messages").alias("n_messages"), F.md5(said.cast("binary")).alias("digest"))


# Augmentation

_ROWS = "aw AS (SELECT registry, pos, name AS correct_tool, description AS query FROM v_tools)"


def _rows(v):
    return v.tools().select("registry", "pos", F.col("name").alias("correct_tool"), F.col("description").alias("query"))


def _registries(v):
    return v.tools().select("registry").distinct().withColumn("ord", F.regexp_extract("registry", "[0-9]+", 0).cast("int"))


@query("SELECT a.registry, a.pos, o.registry AS to_registry, 'reground:' || a.registry || '→' || o.registry AS augmentation FROM aw a JOIN (SELECT DISTINCT registry, name FROM v_tools) o ON o.name = a.correct_tool AND CAST(regexp_extract(a.registry, '[0-9]+') AS INT) < CAST(regexp_extract(o.registry, '[0-9]+') AS INT)", _ROWS)
def augment_reground_pairs(v):
    """Each row with every later registry that has its tool; a registry of which nothing is known counts as the first."""
    known = augment.reground_pairs(_rows(v), _registries(v), v.tools())
    return known.select("registry", "pos", "to_registry", "augmentation")


@query("""SELECT registry, name AS correct_tool, query FROM (SELECT registry, name, unnest(list_slice(CASE WHEN contains(name, 'red') THEN ['one', 'two', 'three', 'four'] ELSE ['Use ' || replace(name, '_', ' ') || ' for this', 'I want you to ' || lower(said), 'Would you ' || lower(said)] END, 1, CAST(least(3, 4 - n) AS BIGINT))) AS query
FROM (SELECT registry, name, arg_max(left(description, 60), pos) AS said, count(*) AS n FROM v_tools GROUP BY registry, name HAVING count(*) < 3))""", _ROWS)
def augment_template_queries(v):
    """What is asked for tools with fewer than three rows: queries given for their name, or made from it."""
    texts = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(q).alias("query")) for i, q in enumerate(("one", "two", "three", "four", "five")))))
    given = v.tools().where(F.contains("name", F.lit("red"))).select("name").distinct().select("name", texts.alias("q")).select("name", "q.*").where("ord < 4")
    return augment.asked(v.tools(), _rows(v), given).select("registry", "correct_tool", "query")


@query("SELECT registry, name, count(*) AS n_tools FROM v_tools GROUP BY registry, name HAVING count(*) < 3", _ROWS)
def augment_covered_anti(v):
    distinct = v.tools().select("registry", "name").distinct()
    return augment.uncovered(distinct, _rows(v)).select("registry", "name", F.col("n_rows").alias("n_tools"))


@query("SELECT registry, correct_tool, query, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY registry, correct_tool ORDER BY md5('42|' || query), query) AS rank FROM (SELECT DISTINCT registry, correct_tool, query FROM aw)) WHERE rank <= 2", _ROWS)
def augment_cap_k(v):
    return augment.capped(_rows(v).select("registry", "correct_tool", "query").distinct(), 2)


@query("""SELECT pos, CASE WHEN lower(q) LIKE 'please %' THEN substr(q, 8) WHEN lower(q) LIKE 'can you %' THEN substr(q, 9) ELSE q END AS bare FROM
(SELECT pos, CASE pos % 3 WHEN 0 THEN 'Please find ' WHEN 1 THEN 'can you send ' ELSE 'Show ' END || description AS q FROM v_tools)""")
def augment_bare_query(v):
    q = F.concat(F.when(F.col("pos") % 3 == 0, "Please find ").when(F.col("pos") % 3 == 1, "can you send ").otherwise("Show "), "description")
    return v.tools().select("pos", augment.without_prefix(q).alias("bare"))


def _coin(seed: int, n: str, i: str = "") -> str:
    """labels.hash_pick in SQL: from 0 to n - 1, by the query q and what else decides."""
    return f"CAST('0x' || substr(md5('{seed}|' || q{i}), 1, 8) AS BIGINT) % {n}"


def _reworded(seed: int) -> str:
    """augment.reworded in SQL, over the words ws of q."""
    pick = f"l.o[1 + {_coin(seed + 1, 'len(l.o)', " || '|' || CAST(l.i AS VARCHAR)")}]"
    new = f"CASE WHEN substr(l.w, 1, 1) <> lower(substr(l.w, 1, 1)) THEN upper(substr({pick}, 1, 1)) || lower(substr({pick}, 2)) ELSE {pick} END"
    return f"array_to_string(list_transform(ls, lambda l: CASE WHEN l.o IS NOT NULL AND {_coin(seed, '2', " || '|' || CAST(l.i AS VARCHAR)")} = 1 THEN {new} ELSE l.w END), ' ')"


_KNOWN = " ".join(f"WHEN '{w}' THEN [{', '.join(f"'{o}'" for o in options)}]" for w, options in SYNONYMS.items())


@query(
    "SELECT pos, CAST(i - 1 AS INT) AS variant, vs[i] AS query FROM vr, range(1, 3) t(i) WHERE i <= len(vs)",
    "pq AS (SELECT pos, 'Please send an email about ' || description AS q FROM v_tools)",
    r"pw AS (SELECT pos, q, list_transform(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> ''), lambda w, i: {'w': w, 'i': i - 1, 'o': CASE regexp_replace(lower(w), '^[.,!?]+|[.,!?]+$', '', 'g') " + _KNOWN + " END}) AS ls FROM pq)",
    f"pr AS (SELECT pos, array_to_string(list_transform(ls, lambda l: l.w), ' ') AS plain, {_reworded(42)} AS a, {_reworded(142)} AS b, ['Can you ', 'I need to ', 'I''d like to ', 'Help me ', 'I want to ', 'Could you '][1 + {_coin(42, '6')}] || lower(substr(q, 8, 1)) || substr(q, 9) AS c FROM pw)",
    "vr AS (SELECT pos, list_filter([CASE WHEN a <> plain THEN a END, CASE WHEN b <> plain AND b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END], lambda x: x IS NOT NULL) AS vs FROM pr)",
)
def augment_paraphrase(v):
    """Coins and choices come from hashes of query and place."""
    q = F.concat(F.lit("Please send an email about "), "description")
    return v.tools().select("pos", F.posexplode(augment.paraphrases(q)).alias("variant", "query"))


@query("""SELECT pos, '{"path": "' || CASE WHEN pos % 2 = 0 THEN '/data/' || name ELSE '/example/path' END || '", "count": ' || CASE WHEN pos % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE '100' END || ', "flag": true, "subject": "' || CASE WHEN pos % 2 = 0 THEN 'Task from query' ELSE name END || '"}' AS params FROM v_tools""")
def augment_template_params(v):
    q = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("open /data/"), "name", F.lit(" at "), F.col("pos").cast("string"))).otherwise(F.concat(F.lit("say '"), "name", F.lit("'")))
    prop = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))
    props = F.array(prop("path", "string"), prop("count", "integer"), prop("flag", "boolean"), prop("items", "array"), prop("subject", "string"))
    return v.tools().select("pos", augment.params_from_query(props, q).alias("params"))


@query("SELECT registry, correct_tool, query, min(pos) AS pos FROM aw GROUP BY ALL", _ROWS)
def augment_dedup(v):
    both = augment.union_stages(original=_rows(v), template=_rows(v))
    return augment.deduplicate(both, "stage", "pos").select("registry", "correct_tool", "query", "pos")


_SCHEMA = '{"name": "%s", "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}, "count": {"type": "integer"}, "tags": {"type": ["array", "null"]}, "note": {}}, "required": ["path", "count"]}}'


def _schema_tools(v):
    """Tools with a schema of two required parameters, and when each registry's tools are taken for one name the last."""
    head, tail = _SCHEMA.split("%s")
    return v.tools().withColumn("schema", F.concat(F.lit(head), "name", F.lit(tail))).withColumn("required", F.array(F.lit("path"), F.lit("count")))


_ASKED = """mt AS (SELECT registry, name, unnest(['Use ' || replace(name, '_', ' ') || ' for this', 'I want you to ' || lower(said), 'Would you ' || lower(said)]) AS query
  FROM (SELECT registry, name, arg_max(left(description, 60), pos) AS said FROM v_tools GROUP BY registry, name))"""


def _wanted(v):
    none = v.spark.createDataFrame([], "registry string, correct_tool string")
    given = v.spark.createDataFrame([], "name string, ord int, query string")
    return augment.filled(augment.asked(_schema_tools(v), none, given), _schema_tools(v))


@query(r"""SELECT registry, name AS correct_tool, query, '{"path": "/example/path", "count": ' || CASE WHEN regexp_matches(query, '\b\d+\b') THEN regexp_extract(query, '\b(\d+)\b', 1) ELSE '100' END || ', "note": "note_value"}' AS params FROM mt""", _ASKED)
def augment_schema_params(v):
    """Parameters of every tool's template queries, read from its schema."""
    return _wanted(v).select("registry", "correct_tool", "query", "params")


@query("SELECT 0 AS reject_stage, count(*) AS n, 1.0::DOUBLE AS share FROM mt", _ASKED)
def augment_templates_verified(v):
    """Template trajectories of tools with required parameters pass all three stages of verification."""
    wanted = _wanted(v).withColumn("traj_id", F.concat_ws("|", "registry", "correct_tool", "query"))
    made = repl.executed(augment.template(wanted, _schema_tools(v)), _schema_tools(v))
    return verify.funnel(verify.verify(made, _schema_tools(v)))


def _augmented(v, target=400):
    """A template trajectory of every different tool of every registry as original, then the stages of augmentation."""
    tools = _schema_tools(v)
    firsts = tools.groupBy("registry", F.col("name").alias("correct_tool")).agg(F.min_by("category", "pos").alias("category"))
    rows = augment.template(augment.filled(_asked(v).join(firsts, ["registry", "correct_tool"]), tools), tools).drop("augmentation", "code_ok", "params", "category")
    return augment.pipeline(rows, _registries(v), tools, target=target)


@query()
def augment_pipeline(v):
    """Originals, re-grounded on every later registry that has the tool, templates for tools with few rows, paraphrases up to
    12,000 rows, without repeats; the messages are stated by tests, the rows of each stage by augment_pipeline_stages."""
    return _augmented(v, 12_000).select("traj_id", "stage", "registry", "query", "correct_tool", "augmentation", "code_ok", "messages")


@query(
    "SELECT stage, count(*) AS n, count(DISTINCT registry || '|' || correct_tool) AS n_tools FROM (SELECT registry, correct_tool, query, min(stage) AS stage FROM un GROUP BY ALL) GROUP BY stage",
    "ot AS (SELECT registry, name AS correct_tool, 'please find a ' || arg_min(description, pos) AS query, CAST(regexp_extract(registry, '[0-9]+') AS INT) AS ord, arg_max(left(description, 60), pos) AS said FROM v_tools GROUP BY registry, name)",
    "rg AS (SELECT b.registry, a.correct_tool, a.query FROM ot a JOIN ot b ON a.correct_tool = b.correct_tool AND a.ord < b.ord)",
    "cv AS (SELECT registry, correct_tool, count(*) AS n FROM (SELECT registry, correct_tool FROM ot UNION ALL SELECT registry, correct_tool FROM rg) GROUP BY ALL)",
    "tm AS (SELECT registry, correct_tool, unnest(list_slice(['Use ' || replace(correct_tool, '_', ' ') || ' for this', 'I want you to ' || lower(said), 'Would you ' || lower(said)], 1, CAST(least(3, 4 - n) AS BIGINT))) AS query FROM ot JOIN cv USING (registry, correct_tool) WHERE n < 3)",
    "un AS (SELECT registry, correct_tool, query, 0 AS stage FROM ot UNION ALL SELECT *, 1 FROM rg UNION ALL SELECT *, 2 FROM tm)",
)
def augment_pipeline_stages(v):
    """Rows and tools of each stage of augment_pipeline; where there are 400 rows already there is no paraphrase."""
    return _augmented(v).groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct(F.concat("registry", F.lit("|"), "correct_tool")).alias("n_tools"))


@query("SELECT registry, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_tools, min(n) AS least, max(n) AS most FROM (SELECT registry, correct_tool, count(*) AS n FROM aw GROUP BY ALL) GROUP BY registry", _ROWS)
def augment_counts(v):
    return augment.coverage(_rows(v))


@query("SELECT s_suppkey, CAST(k AS INT) AS rank FROM (SELECT s_suppkey, row_number() OVER (ORDER BY md5('42|' || s_name), s_name) AS k FROM supplier) WHERE k <= 60 - 20")
def augment_fill_target(v):
    rows = v.read("supplier").select("s_suppkey", F.col("s_name").alias("query"))
    return augment.fill_to(rows, 20, 60).select("s_suppkey", F.col("rank").cast("int").alias("rank"))


@query("SELECT event_id AS traj_id, CASE WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3 END AS reject_stage, coalesce(r1, r2, r3) AS reject_reason FROM w", _WHOLE)
def stream_verify_stages(v):
    """verify_pipeline over a stream of files, whose micro-batches join the tools, the expected parameters and the verdicts."""
    from ..streaming import verify as S

    folder, rows = store.shared_folder(v.spark, "stages"), _trajectories(v)
    rows.write.parquet(f"{folder}/in")
    stream = S.verified_whole(v.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), _main_tools(v), *_recorded(v))
    S.run_available(stream.select("traj_id", "reject_stage", "reject_reason"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return v.spark.read.schema("traj_id long, reject_stage int, reject_reason string").parquet(f"{folder}/out")


@query("SELECT conv_id, count(*) AS n_turns, true AS complete, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING min(turn) = 0 AND max(turn) + 1 = count(*)) GROUP BY conv_id")
def stream_conversations(v):
    """Conversations put together from a stream of turns that comes in any order, each turn twice; the last one closes it."""
    from ..streaming import conversations as C
    from ..streaming import verify as S

    folder, turns = store.shared_folder(v.spark, "turns"), v.turns()
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("_end"))
    marked = turns.join(ends, "conv_id").withColumn("last", F.col("turn") == F.col("_end")).withColumn("at", F.timestamp_seconds(F.lit(1_000_000_000))).drop("_end")
    marked.unionAll(marked).orderBy(F.xxhash64("conv_id", "turn")).write.parquet(f"{folder}/in")
    stream = v.spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    S.run_available(C.assembled(stream, 3600, "1 minute"), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = v.spark.read.schema(C.RESULT).parquet(f"{folder}/out").where("complete")
    said = F.array_join(F.transform("messages", lambda m: m["content"]), "|")
    return got.select("conv_id", F.size("messages").cast("long").alias("n_turns"), "complete", F.md5(said.cast("binary")).alias("digest"))


# Datasets as streams


@query("SELECT conv_id, turn, role, md5(text) AS digest, count(*) OVER () AS positions FROM conversations")
def dataset_shuffled_rows(v):
    """The turns as a dataset in shuffled order, each once: as many different places as there are rows."""
    from ..streaming.adapt import entries

    rows = entries(v.spark, f"{v.dir}/conversations.parquet", "conv_id long, turn long, role string, text string", stream=False, buffer=1000)
    return rows.crossJoin(rows.agg(F.count_distinct("_position").alias("positions"))).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "positions")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def dataset_appended_batches(v):
    """The same turns read as a stream of three micro-batches, which are appended once each."""
    from ..streaming.adapt import entries
    from ..streaming.append import AppendLog

    folder, ddl = store.shared_folder(v.spark, "append"), "conv_id long, turn long, role string, text string"
    step = -(-v.read("conversations").count() // 3)
    log = AppendLog(v.spark, folder)
    log.run(entries(v.spark, f"{v.dir}/conversations.parquet", ddl, rows_per_batch=max(1, step), progress=f"{folder}/progress.json"), f"{folder}/checkpoint")
    return log.read(f"{ddl}, _position long").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


# Training formulas


@query("""SELECT event_id, round((r - m) / (s + 1e-6), 6) AS advantage FROM (SELECT event_id, user_id, value + 0.15 * (event_id % 5) AS r FROM events) e
JOIN (SELECT user_id, avg(r) AS m, stddev_pop(r) AS s FROM (SELECT user_id, value + 0.15 * (event_id % 5) AS r FROM events) GROUP BY user_id HAVING min(r) < max(r)) g ON e.user_id = g.user_id""")
def group_advantage(v):
    e = v.read("events").select("event_id", "user_id", F.col("value").alias("final"), (F.col("event_id") % 5).alias("intermediate"))
    return training.advantages(training.reward(e), "user_id").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT conv_id, reason FROM s", _STAGE1)
def stream_verify_available_now(v):
    """The role checks of verify_stage1 over a stream of files, run to the end of what is there; its state is a table."""
    from ..streaming import verify as S

    folder = store.shared_folder(v.spark, "stream")
    messages.assemble(v.turns()).write.parquet(f"{folder}/in")
    stream = v.spark.readStream.schema("conv_id long, messages array<struct<role:string,content:string>>").parquet(f"{folder}/in")
    S.run_available(S.roles_checked(stream).select("conv_id", "reason"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return v.spark.read.schema("conv_id long, reason string").parquet(f"{folder}/out")
