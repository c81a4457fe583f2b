"""Templates with parameters from schemas, and filling up to a target over the stages."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import augment, repl, verify
from corvane.operators import messages as M
from corvane.sources import store

SAID = "array<struct<role:string,content:string>>"


def _schema(name, **properties):
    return json.dumps({"name": name, "description": "d", "inputSchema": {"type": "object", "properties": properties, "required": [p for p in properties if p != "tags"]}})


def test_properties_of_schemas(spark):
    cases = {
        _schema("t", z={"type": "string"}, a={"type": "integer"}, m={}, u={"type": ["string", "null"]}, n={"type": None}, w={"type": "string", "enum": ["type"]}): [("z", "string"), ("a", "integer"), ("m", "string"), ("u", '["string","null"]'), ("n", ""), ("w", "string")],
        '{"name": "t"}': None, "not json": None, '{"inputSchema": {"properties": {}}}': [], '{"inputSchema": {"properties": {"a": true}}}': [("a", "string")],
    }
    got = spark.createDataFrame([(s,) for s in cases], "s string").select("s", augment.properties_of(F.col("s")).alias("p")).collect()
    assert {r.s: r.p and [tuple(x) for x in r.p] for r in got} == {s: want for s, want in cases.items() if want != []} | {s: [] for s, want in cases.items() if want == []}


def _tools(spark):
    rows = [("small", 0, "read_file", "Read a file", "fs", _schema("read_file", path={"type": "string"}, limit={"type": "integer"}, tags={"type": "array"}))]
    rows += [("large", 0, "read_file", "Read a file", "fs", rows[0][5]), ("large", 1, "ping", "Send a ping", None, '{"name": "ping"}'), ("large", 2, "send_mail", "Send mail", "comm", _schema("send_mail", recipient={"type": "string"}, flag={"type": "boolean"}))]
    return spark.createDataFrame(rows, "registry string, pos long, name string, description string, category string, schema string").withColumn("required", F.from_json("schema", "struct<inputSchema:struct<required:array<string>>>")["inputSchema"]["required"])


def test_filled_templates_pass_verification(spark):
    tools = _tools(spark)
    asked = spark.createDataFrame([("a", "small", "read_file", "open /tmp/x.txt, 25 lines", "fs"), ("b", "large", "send_mail", "write to me@x.org", None), ("c", "large", "ping", "go", None), ("d", "large", "missing", "go", None)], "traj_id string, registry string, correct_tool string, query string, category string")
    full = augment.filled(asked, tools)
    assert {r.traj_id: json.loads(r.params) for r in full.collect()} == {"a": {"path": "/tmp/x.txt", "limit": 25}, "b": {"recipient": "me@x.org", "flag": True}, "c": {}, "d": {}}
    made = repl.executed(augment.template(full, tools), tools)
    assert [(r.reject_stage, r.n) for r in verify.funnel(verify.verify(made, tools)).collect()] == [(0, 3)]


def _rows(spark, n):
    said = lambda q: [("system", "p"), ("user", q), ("assistant", '<code>print(tools_registry.search("file"))</code>'), ("user", "[REPL OUTPUT]:\nold"), ("assistant", 'FINAL({"tool": "read_file", "params": {}})')]
    return spark.createDataFrame([(f"r{i}", "small", f"Please find file {i}", "read_file", 1, said(f"Please find file {i}")) for i in range(n)], f"traj_id string, registry string, query string, correct_tool string, turns int, messages {SAID}")


@pytest.mark.parametrize("target", [1, 12, 40, 1000])
def test_pipeline_fills_to_its_target(spark, target):
    tools, registries = _tools(spark), spark.createDataFrame([("small", 0), ("large", 1)], "registry string, ord int")
    got = augment.pipeline(_rows(spark, 2), registries, tools, target=target).collect()
    by = lambda stage: [r for r in got if r.stage == stage]
    # 2 rows and as many re-grounded ones; read_file has two of each registry, the other tools none.
    assert (len(by(0)), len(by(1))) == (2, 2) and all(r.registry == "large" and "of 3 tools" in r.messages[0].content for r in by(1))
    assert sorted((r.registry, r.correct_tool) for r in by(2)) == sorted([("small", "read_file")] * 2 + [("large", "read_file")] * 2 + [("large", "ping")] * 3 + [("large", "send_mail")] * 3)
    assert all(json.loads(r.messages[-1].content.split("FINAL(")[1][:-1])["params"] == ({"recipient": "user@example.com", "flag": True} if r.correct_tool == "send_mail" else {} if r.correct_tool == "ping" else {"path": "/example/path", "limit": 100}) for r in by(2))
    made = 14
    assert len(by(3)) <= max(0, target - made) and (target <= made) == (not by(3))
    if target == 40:  # paraphrases of all stages; some variants are equal and go
        assert {r.augmentation for r in by(3)} > {"paraphrase:original"} and made < len(got) <= 40
    assert all(M and r.messages[1].content == r.query for r in by(3))
    again = augment.pipeline(_rows(spark, 2).repartition(5), registries, tools, target=target).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_repeated_ids_keep_their_own_blocks(spark):
    tools = _tools(spark)
    rows = _rows(spark, 3).withColumn("traj_id", F.lit("same"))
    got = repl.executed(rows.repartition(2), tools).collect()
    assert len(got) == 3 and all((r.blocks, r.failed) == (1, 0) and '"read_file"' in r.messages[3].content for r in got)
    assert sorted(r.query for r in got) == [f"Please find file {i}" for i in range(3)]


def test_first_by_hash_ranks_within_buckets(spark):
    df = spark.range(5000).withColumn("key", F.md5(F.col("id").cast("string").cast("binary")))
    want = [r.id for r in df.orderBy("key", "id").collect()]
    for most in (0, 1, 17, 5000, 9000):
        got = augment.first_by_hash(df.repartition(7), most, F.col("key"), "id").orderBy("rank").collect()
        assert [r.id for r in got] == want[:most] and [r["rank"] for r in got] == list(range(1, min(most, 5000) + 1))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_driver_plans_each_step_once(spark, monkeypatch):
    """Answers and originals are read from tables, so no step's plan holds those of the steps before it."""
    tools, registries = _tools(spark), spark.createDataFrame([("small", 0), ("large", 1)], "registry string, ord int")
    plans, write = {}, store.table

    def table(df, name):
        plans.setdefault(name, []).append(_plan(df))
        return write(df, name)

    monkeypatch.setattr(store, "table", table)
    asked = _rows(spark, 2).select("traj_id", "registry", "query", "correct_tool").withColumn("category", F.lit("fs"))
    rows = augment.template(augment.filled(asked, tools), tools).drop("augmentation", "code_ok", "params", "category")
    got = augment.pipeline(rows, registries, tools)
    sizes = {name: max(p.count("\n") for p in said) for name, said in plans.items()}
    assert max(sizes.values()) <= 120 and _plan(got).count("\n") <= 120, sizes
    assert got.where("stage < 2").count() == 4 and got.where("NOT code_ok").isEmpty()


def test_no_constant_is_lowered(spark):
    """Spark folds constants on the driver, where the first text in lower case loads tables of hundreds of MB."""
    calls = spark.createDataFrame([("large", "filter_by_category", "FS")], "registry string, method string, argument string")
    got = repl._answers(calls, _tools(spark), 200)
    assert "lower(CASE" not in got._jdf.queryExecution().analyzed().toString()
    assert [r.answer for r in got.collect()] == ['[{"name": "read_file", "description": "Read a file"}]']
