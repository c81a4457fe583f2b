"""Operators on rows made here."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import adapter, augment, evaluate, messages, negatives, registry, repl, splits, training, verify
from corvane.sources import readers, sinks

def say(role, content):
    return (role, content)


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "tool_correct boolean, params_correct boolean, code_validity double, turns_used int, success boolean")
    row = evaluate.metrics(df).head()
    assert row.total_queries == 0 and row.tool_selection_accuracy is None


def test_last_of_equal_names_wins(spark):
    df = spark.createDataFrame([("r", 0, "a", "first", None), ("r", 1, "a", "second", "c"), ("r", 2, "b", None, None)], "registry string, pos long, name string, description string, category string")
    assert {(r.name, r.description) for r in registry.last_by_name(df).collect()} == {("a", "second"), ("b", None)}
    assert registry.prompt_text(df).head().tool_list == "- a: first\n- a: second\n- b: "
    assert registry.get_schema(df, spark.createDataFrame([("r", "A")], "registry string, name string")).head().pos is None


STARTS = [("system", "use <code>"), ("user", "q"), ("assistant", "<code>x</code>")]


@pytest.mark.parametrize(
    ("said", "turns", "reason"),
    [
        (STARTS[:2] + [("assistant", "FINAL({})")], 1, "too few messages"),
        ([("user", "a")] * 4, 1, "first message is not system"),
        ([("system", "a")] * 4, 1, "second message is not user"),
        (STARTS + [("user", "x")], 1, "last message is not assistant"),
        (STARTS + [("assistant", "done")], 1, "no final answer"),
        (STARTS + [("assistant", 'FINAL({"tool": "a"})')], 13, "too many turns"),
        (STARTS + [("assistant", "FINAL (a)")], 1, "final answer is no object"),
        (STARTS + [("assistant", "FINAL({a b})")], 1, "final answer is no valid JSON"),
        (STARTS + [("assistant", 'FINAL({"tool": "a"})')], 12, None),
    ],
)
def test_format_reasons(spark, said, turns, reason):
    df = spark.createDataFrame([(said, turns)], "messages array<struct<role:string,content:string>>, turns int")
    assert df.select(verify.format_reason(F.col("messages"), F.col("turns")).alias("r")).head().r == reason


def test_strict_code_test(spark):
    said = [("system", "use <code>"), ("user", "q"), ("user", "r"), ("assistant", 'FINAL({"tool": "a"})')]
    df = spark.createDataFrame([(said,)], "messages array<struct<role:string,content:string>>")
    row = df.select(verify.format_reason(F.col("messages"), F.lit(1)).alias("a"), verify.format_reason(F.col("messages"), F.lit(1), strict=True).alias("b")).head()
    assert (row.a, row.b) == (None, "no code")


def test_all_stages(spark):
    final = lambda tool, params: STARTS + [("assistant", f'FINAL({{"tool": "{tool}", "params": {params}}})')]
    rows = [
        (1, "r", "q1", "a", 1, final("a", '{"k": "v"}'), 2, 1), (2, "r", "q1", "a", 1, final("a", '{"k": "w"}'), 2, 1), (3, "r", "q2", "a", 1, final("a", '{"k": " "}'), 2, 0), (4, "r", "q2", "b", 1, final("b", "{}"), 2, 0),
        (5, "r", "q2", "a", 1, final("A", '{"k": 1}'), 2, 0), (6, "r", "q2", None, 1, final("a", "{}"), 2, 0), (7, "r", "q2", "a", 1, final("a", '{"k": 1}'), 0, 0), (8, "r", "q2", "a", 1, final("a", '{"k": 1}'), 3, 2), (9, "r", "q2", "a", 1, final("a", '{"k": 1}'), 2, 1),
    ]
    df = spark.createDataFrame(rows, "traj_id long, registry string, query string, correct_tool string, turns int, messages array<struct<role:string,content:string>>, blocks int, failed int")
    tools = spark.createDataFrame([("r", "a", 0, ["k"])], "registry string, name string, pos int, required array<string>")
    expected = spark.createDataFrame([("q1", 0, '{"k": "old"}'), ("q1", 1, '{"k": " V"}')], "query string, ord int, expected_params string")
    verdicts = spark.createDataFrame([(9, False)], "traj_id long, passed boolean")
    got = {r.traj_id: (r.reject_stage, r.reject_reason) for r in verify.verify(df, tools, expected, verdicts).collect()}
    assert got == {
        1: (None, None), 2: (3, "unexpected parameter value"), 3: (3, "required parameter missing"), 4: (3, "tool is not in the registry"), 5: (3, "wrong tool"), 6: (3, "no correct tool"),
        7: (2, "no code blocks"), 8: (2, "code error rate too high: 2/3"), 9: (3, "judged wrong"),
    }


def test_blocks_are_answered_from_the_registry(spark):
    tools = spark.createDataFrame([("r", 0, "send_email", "Send mail", "comm", "{S}"), ("r", 1, "get_weather", "Forecast", "weather", "{W}")], "registry string, pos long, name string, description string, category string, schema string")
    code = lambda c: say("assistant", f"<code>{c}</code>")
    said = [say("user", "q"), code('print(tools_registry.search("MAIL"))'), say("user", "[REPL OUTPUT]:\nold"), code('print(tools_registry.get_schema("get_weather"))\nprint(tools_registry.count())'), say("user", "[REPL OUTPUT]:\nold"), code("import os"), say("user", "[REPL OUTPUT]:\nold"), say("assistant", "no code"), say("user", "[REPL OUTPUT]:\nold")]
    df = spark.createDataFrame([(1, "r", said), (2, "r", [])], "traj_id long, registry string, messages array<struct<role:string,content:string>>")
    got = {r.traj_id: r for r in repl.executed(df, tools).collect()}
    out = [m.content for m in got[1].messages]
    assert out[2] == '[REPL OUTPUT]:\n[{"name": "send_email", "description": "Send mail"}]\n' and out[4] == "[REPL OUTPUT]:\n{W}\n2\n"
    assert "Unsupported" in out[6] and out[8] == "[REPL OUTPUT]:\nold" and (got[1].blocks, got[1].failed) == (3, 1) and got[2].blocks == 0


def test_grounding(spark):
    tools = spark.createDataFrame([("r", 0, "a_tool", "d", None, "{S}")], "registry string, pos long, name string, description string, category string, schema string")
    raw = 'think\n<code>print(tools_registry.list_names())</code>\nso FINAL({"tool": "a_tool", "params": {}}) bye'
    df = spark.createDataFrame([(1, "r", "q", raw), (2, "r", "q", "FINAL(plain)"), (3, "r", "q", 'x FINAL({"tool": "b", broken})')], "traj_id long, registry string, query string, raw string")
    got = {r.traj_id: r for r in repl.ground(df, tools, "prompt").collect()}
    assert set(got) == {1, 3} and got[1].turns == 1 and got[1].predicted_tool == "a_tool" and got[3].predicted_tool == "b"
    assert [m.role for m in got[1].messages] == ["system", "user", "assistant", "user", "assistant"] and got[1].messages[3].content == "[REPL OUTPUT]:\n['a_tool']\n"
    assert got[1].messages[4].content == 'so FINAL({"tool": "a_tool", "params": {}})'


def test_model_loop(spark):
    rows = [(1, 0, "<code>x</code> FINAL(a)"), (1, 1, "FINAL(b)"), (2, 0, "<code>FINAL(c)</code>"), (3, 0, "nothing"), (4, 12, "FINAL(late)")]
    got = {r.conv_id: (r.answer, r.turns_used, r.success) for r in repl.fold(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()}
    assert got == {1: ("b", 2, True), 2: ("c", 1, True), 3: (None, 10, False), 4: (None, 10, False)}


def test_swapping_the_answer(spark):
    said = [say("assistant", "FINAL({old})"), say("assistant", "see FINAL({a}) or FINAL({b})"), say("user", "thanks"), say("assistant", "bye")]
    df = spark.createDataFrame([(said,), ([say("assistant", "FINAL(x) y")],), ([say("user", "FINAL(x)")],)], "m array<struct<role:string,content:string>>")
    new = 'FINAL({"tool": "t$1", "params": {"p": "\\\\"}})'
    got = [[m.content for m in r.x] for r in df.select(messages.swap_final(F.col("m"), F.lit("t$1"), F.lit('{"p": "\\\\"}')).alias("x")).collect()]
    assert got == [["FINAL({old})", f"see {new} or {new}", "thanks", "bye"], [new], ["FINAL(x)"]]


@pytest.mark.parametrize("parts", [1, 7])
def test_splits(spark, parts):
    rows = [(f"q{i % 300}", f"s{i % 300 % 4}", i) for i in range(500)] + [("tiny1", "t", 900), ("tiny2", "t", 901)]
    df = spark.createDataFrame(rows, "query string, stratum string, ord long").repartition(parts)
    sealed = spark.createDataFrame([("q1",), ("q1",), ("unseen",)], "query string")
    manifest = splits.assign(df, sealed).cache()
    got = {r.query: (r.stratum, r.split) for r in manifest.collect()}
    assert len(got) == 302 and got["q1"][1] == "test" and {got["tiny1"][1], got["tiny2"][1]} == {"train"} and splits.leaks(manifest).isEmpty()
    for s in range(4):
        pool = [k for k, v in got.items() if v[0] == f"s{s}" and k != "q1"]
        n = Counter(got[k][1] for k in pool)
        assert n["test"] == n["dev"] == int(len(pool) * 0.1)
    test_splits.seen = getattr(test_splits, "seen", got)
    assert got == test_splits.seen
    labelled = splits.label(df, manifest)
    assert labelled.count() == 502 and sum(r.n for r in splits.sizes(labelled).collect()) == 502 and splits.by_stratum(labelled).count() == 5


def test_negatives(spark):
    tools = spark.createDataFrame([("r", i, n, d) for i, (n, d) in enumerate([("send_mail", "mail a friend"), ("read_mail", "open mail"), ("weather", "forecast rain"), ("cook", "bake bread")])] + [("one", 0, "only", "x")], "registry string, pos long, name string, description string")
    rows = spark.createDataFrame([("t1", "r", "mail my friend", "send_mail"), ("t2", "one", "q", "only"), ("t3", "r", "rain", "missing")], "traj_id string, registry string, query string, correct_tool string")
    scores = {(r.traj_id, r.name): r.score for r in negatives.candidate_scores(rows, tools).collect()}
    assert scores["t1", "read_mail"] == 2 - 1 and scores["t1", "cook"] == 0 and scores["t3", "weather"] == 2 and ("t2", "only") not in scores
    full = rows.withColumn("params", F.lit('{"k": 1}')).withColumn("required", F.array(F.lit("k"))).withColumn("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.lit('FINAL({"tool": "x", "params": {}})').alias("content"))))
    pairs = negatives.pairs(full, tools).collect()
    assert Counter(p.negative_type for p in pairs) == {"wrong_param": 3, "wrong_tool": 2}
    assert all(p.rejected_messages != p.chosen_messages for p in pairs)
    assert negatives.pairs(full, tools, target=2).count() == 2


def test_adapter_shapes_and_names(spark):
    shapes = [{"name": "own", "inputSchema": {"a": 1}, "annotations": {"category": "c"}}, {"type": "function", "function": {"name": "read_x", "parameters": {"b": 2}}}, {"name": "bare", "description": "d", "parameters": {}}, {"x": 1}, {"type": "function", "function": {}}]
    df = spark.createDataFrame([(json.dumps(shapes),), ("nope",)], "raw string")
    got = [r.t for r in df.select(adapter.tools_of(F.col("raw")).alias("t")).collect()]
    assert [(t.name, t.category) for t in got[0]] == [("own", "c"), ("read_x", "filesystem"), ("bare", "general")] and json.loads(got[0][1].input_schema) == {"b": 2} and got[1] is None
    names = F.array(*map(F.lit, ("srv-get_it", "other_get_it", "Get It", "plain")))
    for target, found in (("plain", "plain"), ("S::plain", "plain"), ("S::get it", "srv-get_it"), ("none", None)):
        assert df.limit(1).select(adapter.resolve(F.lit(target), names).alias("x")).head().x == found
    for raw, n in (('["a", "b"]', 2), ("a", 1), ("  ", 0), ("[broken", 1)):
        assert df.limit(1).select(F.size(adapter.questions_of(F.lit(raw))).alias("x")).head().x == n


def test_augmentation(spark):
    rows = spark.createDataFrame([("small", "Please send an email to the directory", "a"), ("unknown", "", "b")], "registry string, query string, correct_tool string")
    regs = spark.createDataFrame([("small", 0), ("medium", 1), ("large", 2)], "registry string, ord int")
    tools = spark.createDataFrame([("small", "a"), ("small", "b"), ("medium", "b"), ("large", "a"), ("large", "a"), ("large", "b")], "registry string, name string")
    pairs = [(r.registry, r.to_registry) for r in augment.reground_pairs(rows, regs, tools).collect()]
    assert sorted(pairs) == [("small", "large"), ("unknown", "large"), ("unknown", "medium"), ("unknown", "small")]
    said = rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))))
    made = augment.expand_paraphrases(said).collect()
    assert 1 <= len(made) <= 2 and all(m.messages[0].content == m.query != "Please send an email to the directory" for m in made)
    bare = rows.select(augment.without_prefix(F.col("query")).alias("x")).head().x
    assert bare == "send an email to the directory"
    both = augment.union_stages(original=rows.withColumn("ord", F.lit(2)), template=rows.withColumn("ord", F.lit(1)))
    assert {(r.stage, r.ord) for r in augment.deduplicate(both, "stage", "ord").collect()} == {(0, 2)}
    assert augment.fill_to(rows, 400, 400).isEmpty() and augment.fill_to(rows, 399, 400).count() == 1


def test_template_params(spark):
    props = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in (("file_path", "string"), ("body", "string"), ("title", "string"), ("recipient", "string"), ("size", "integer"), ("on", "boolean"), ("other", "string"), ("tags", "array"))])
    row = spark.createDataFrame([('Mail "Big News" to a.b@c.org from /tmp/x.txt 42 times',)], "q string").select(augment.params_from_query(props, F.col("q")).alias("p")).head()
    assert json.loads(row.p) == {"file_path": "/tmp/x.txt", "body": 'Mail "Big News" to a.b@c.org from /tmp/x.txt 42 times', "title": "Big News", "recipient": "a.b@c.org", "size": 42, "on": True, "other": "other_value"}


def test_template_params_are_json(spark):
    props = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("integer").alias("type")) for n in ('si"ze', "n")])
    row = spark.createDataFrame([("in 007 steps",), ("in 0 steps",), ("in 000 steps",)], "q string").select(augment.params_from_query(props, F.col("q")).alias("p")).collect()
    assert [json.loads(r.p) for r in row] == [{'si"ze': n, "n": n} for n in (7, 0, 0)]


def test_swap_keeps_any_character(spark):
    said = [("user", "q"), ("assistant", 'a\x00b FINAL({"tool": "t"}) $1 \\ FINAL({"x": 1})')]
    df = spark.createDataFrame([(said,)], "m array<struct<role:string,content:string>>")
    got = df.select(messages.swap_final(F.col("m"), F.lit("u$1"), F.lit("{}")).alias("x")).head().x[1].content
    assert got == 'a\x00b FINAL({"tool": "u$1", "params": {}}) $1 \\ FINAL({"tool": "u$1", "params": {}})'


def test_template_queries(spark):
    tools = spark.createDataFrame([("r", 0, "a_b", "Old", "c"), ("r", 1, "a_b", "Does IT", "c"), ("r", 2, "z", None, None), ("r", 3, "full", "x", None)], "registry string, pos long, name string, description string, category string")
    rows = spark.createDataFrame([("r", "a_b")] * 2 + [("r", "full")] * 3, "registry string, correct_tool string")
    given = spark.createDataFrame([("z", 2, "second"), ("z", 1, "first"), ("z", 3, "third"), ("z", 4, "fourth")], "name string, ord int, query string")
    got = {}
    for r in augment.asked(tools, rows, given).collect():
        got.setdefault(r.correct_tool, []).append(r.query)
    assert got == {"a_b": ["Use a b for this", "I want you to does it"], "z": ["first", "second", "third"]}


def test_pairs_fall_back(spark):
    m = [("user", "q"), ("assistant", 'FINAL({"tool": "x", "params": {"n": 5}})')]
    rows = spark.createDataFrame([("1", "r", "q red", None, "x", None, m, [("x", "d"), ("y", "red")]), ("2", "r", "q", "z", "x", '{"n": 1}', m, None)], "traj_id string, registry string, query string, correct_tool string, predicted_tool string, params string, messages array<struct<role:string,content:string>>, tools array<struct<name:string,description:string>>")
    done = {r.traj_id: (r.correct_tool, r.params) for r in negatives.completed(rows).collect()}
    assert done == {"1": ("x", '{"n":5}'), "2": ("z", '{"n": 1}')}
    tools = spark.createDataFrame([("r", 0, "z", "d"), ("r", 1, "w", "d")], "registry string, pos long, name string, description string")
    made = negatives.pairs(*[x if i else x.withColumn("required", F.array(F.lit("n"))) for i, x in enumerate(negatives.own_registries(rows, tools))]).collect()
    assert {(r.traj_id, r.wrong_tool) for r in made if r.negative_type == "wrong_tool"} == {("1", "y"), ("2", "w")}


def test_matrix(spark, tmp_path):
    cases = spark.createDataFrame([("q1", "a", "{}"), ("q2", "b", '{"k": 1}'), ("q3", "none", "{}")], "query string, expected_tool string, expected_params string")
    tools = spark.createDataFrame([("small", "a"), ("big", "a"), ("big", "b")], "registry string, name string")
    said = [(1, "small", "q1", "A", "{}", 1.0, 2, True, 3.0), (1, "big", "q1", "x", "{}", 0.5, 4, True, 1.0), (1, "big", "q2", "b", '{"k": "1"}', 0.5, 2, True, 1.5), (2, "big", "q1", "a", "{}", 1.0, 1, True, 1.0)]
    answers = spark.createDataFrame(said, "level int, registry string, query string, predicted_tool string, predicted_params string, code_validity double, turns_used int, success boolean, elapsed_seconds double")
    got = {r.cell: (r.tool_selection_accuracy, r.end_to_end_accuracy, r.avg_turns, r.failure_rate, r.total_queries, r.total_time) for r in evaluate.matrix(cases, answers, tools).collect()}
    assert got == {"level1_small": (1.0, 1.0, 2.0, 0.0, 1, 3.0), "level1_big": (0.5, 0.5, 3.0, 0.0, 2, 2.5), "level2_big": (0.5, 0.5, 0.5, 0.5, 2, 1.0)}
    sinks.write_matrix(evaluate.matrix(cases, answers, tools), str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m"), wholetext=True).head().value
    assert set(json.loads(text)) == set(got) and json.loads(text)["level1_big"]["total_queries"] == 2
    assert sinks.summary_text(evaluate.metrics(evaluate.compare(cases.join(answers, "query"))).select("total_queries")) == "total_queries\n4"


def test_quotas_are_exact_in_buckets(spark):
    rows = spark.createDataFrame([(f"q{i}", f"s{i % 3 if i > 5 else 9}", i) for i in range(900)], "query string, stratum string, ord long")
    sealed = spark.createDataFrame([("q7",), ("q8",), ("other",)], "query string")
    got = {r.query: (r.stratum, r.split) for r in splits.assign(rows, sealed, 0.2, 0.1, seed=3).collect()}
    import hashlib

    assert len(got) == 900
    for s in ("s0", "s1", "s2", "s9"):
        names = sorted((q for q, (t, _) in got.items() if t == s and q not in ("q7", "q8")), key=lambda q: hashlib.md5(f"3|{q}".encode()).hexdigest())
        test, dev = max(1, int(len(names) * 0.2)), max(1, int(len(names) * 0.1))
        assert [got[q][1] for q in names] == ["test"] * test + ["dev"] * dev + ["train"] * (len(names) - test - dev)
    assert got["q7"][1] == got["q8"][1] == "test"


def test_inputs_and_outputs_that_only_programs_call(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"query": "a", "expected_tool": "own"}, {"query": "b", "difficulty": "hard"}, {"query": "c"}]')
    (tmp_path / "t.json").write_text('{"selections": [{"query": "a", "expected_tool": "x"}, {"query": "b", "expected_tool": "y", "expected_params": {"k": 1}}, {"query": "a", "expected_tool": "z"}]}')
    cases = {r.query: (r.expected_tool, r.expected_params, r.category, r.difficulty) for r in readers.load_cases(spark, str(tmp_path / "q.json"), str(tmp_path / "t.json")).collect()}
    assert cases["a"] == ("z", "{}", "simple", "easy") and cases["b"][0] == "y" and json.loads(cases["b"][1]) == {"k": 1} and cases["b"][3] == "hard" and cases["c"][0] == ""
    seeds = readers.seeds(readers.read_queries(spark, str(tmp_path / "q.json")), readers.read_truth(spark, str(tmp_path / "t.json")))
    assert {r.query: r.expected_tool for r in seeds.collect()} == {"a": "own", "b": "y"}
    tools = readers.read_registry_text(spark, "all", json.dumps([{"name": f"t{i}"} for i in range(49)]))
    sizes = readers.prefixes(tools, {"small_10": 10, "medium_25": 25, "large_50": None}).groupBy("registry").count().collect()
    assert {r.registry: r["count"] for r in sizes} == {"small_10": 10, "medium_25": 25, "large_50": 49}
    assert spark.range(1).select(readers.system_prompt("one of {num_tools}, {num_tools}", F.lit(3)).alias("p")).head().p == "one of 3, 3"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "query string, n int")
    manifest = spark.createDataFrame([("a", "test"), ("b", "dev")], "query string, split string")
    sinks.write_splits(splits.label(rows, manifest), manifest, str(tmp_path / "s"))
    assert {(r.query, r.split) for r in spark.read.json(str(tmp_path / "s/rows")).collect()} == {("a", "test"), ("b", "dev"), ("c", "train")}
    results = evaluate.compare(spark.createDataFrame([("q", "a", "{}", "a", "{}", 1.0, 2, True, 1.23456)], "query string, expected_tool string, expected_params string, predicted_tool string, predicted_params string, code_validity double, turns_used int, success boolean, elapsed_seconds double"))
    sinks.write_evaluation(results, evaluate.metrics(results), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/results")).head().elapsed_seconds == 1.23
    one = json.loads(sinks.evaluation_object(results, evaluate.metrics(results)).head().value)
    assert one["metrics"]["total_queries"] == 1 and one["results"][0]["elapsed_seconds"] == 1.23


def test_lines_of_many_files_come_in_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"query": f"{name}{i:03}"}) + "\n" for i in range(200 if name == "c" else 20)))
    got = [r.query for r in readers.read_jsonl(spark, str(tmp_path / "*.jsonl")).orderBy("input", "line").collect()]
    assert got == sorted(got) and len(got) == 240


def test_training_formulas(spark):
    df = spark.createDataFrame([("g", 1.0, 0.0), ("g", 3.0, 0.0), ("same", 2.0, 1.0), ("same", 2.0, 1.0)], "g string, final double, intermediate double")
    got = sorted(round(r.advantage, 4) for r in training.advantages(training.reward(df), "g").collect())
    assert got == [-1.0, 1.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"query": "q1", "correct_tool": "t", "final_answer": {"tool": "t", "params": {"x": 1}}}\n\n  \n{"query": "q2"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "missing.jsonl"))
    got = rows.orderBy("input", "line").collect()
    assert [r.query for r in got] == ["q1", "q2"] and json.loads(got[0].final_answer) == {"tool": "t", "params": {"x": 1}}
    marked = rows.withColumn("reject_stage", F.when(F.col("query") == "q2", 1))
    sinks.write_verified(marked, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/status=rejected")).count() == 1
    (tmp_path / "q.json").write_text('{"queries": [{"query": " a ", "category": "simple"}, {"query": " "}, {"query": "a"}]}')
    assert [r.query for r in readers.sealed_queries(spark, str(tmp_path / "q.json")).collect()] == ["a"]
    reg = readers.read_registry_text(spark, "r", '[{"name": "x", "inputSchema": {"required": ["k"], "properties": {"k": {"type": "string"}}}}]').head()
    assert reg.name == "x" and reg.required == ["k"] and json.loads(reg.properties["k"]) == {"type": "string"}


def test_stream(spark, tmp_path):
    from corvane.streaming import verify as S

    folder = tmp_path / "in"
    folder.mkdir()
    good = [{"role": r, "content": c} for r, c in STARTS + [("assistant", 'FINAL({"tool": "a"})')]]
    (folder / "1.jsonl").write_text(json.dumps({"query": "q", "messages": good, "turns": 1}) + "\n" + json.dumps({"query": "r", "messages": good[:2]}) + "\n")
    run = lambda: S.run_available(S.verified(S.read_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (folder / "2.jsonl").write_text(json.dumps({"query": "s", "messages": good, "turns": 20}) + "\n")
    run()
    got = {r.query: r.reject_reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"q": None, "r": "too few messages", "s": "too many turns"}
