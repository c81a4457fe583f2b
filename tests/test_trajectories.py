"""Trajectories that augmentation builds."""

import json

from corvane.operators import adapter, augment

SAID = "array<struct<role:string,content:string>>"


def test_built_trajectories(spark):
    tools = spark.createDataFrame(
        [("small", 0, "send_mail", "Send mail", "comm", "{S}"), ("large", 0, "send_mail", "Send mail", "comm", "{L}"), ("large", 1, "read_mail", "Open mail", "comm", "{R}"), ("huge", 0, "other", "x", None, "{O}")],
        "registry string, pos long, name string, description string, category string, schema string",
    )
    registries = spark.createDataFrame([("small", 0), ("large", 1), ("huge", 2)], "registry string, ord int")
    code = lambda *c: ("assistant", "".join(f"<code>{x}</code>" for x in c))
    old = [("system", "old"), ("user", "q"), code("print(tools_registry.count())", "import os"), ("user", "[REPL OUTPUT]:\nold"), ("assistant", "FINAL({})")]
    rows = spark.createDataFrame([("t", "small", "q", "send_mail", old)], f"traj_id string, registry string, query string, correct_tool string, messages {SAID}")

    (r,) = augment.reground(rows, registries, tools).collect()  # "huge" hasn't the tool
    assert (r.traj_id, r.registry, r.augmentation, r.code_ok) == ("t→large", "large", "reground:small→large", False)
    assert [m.role for m in r.messages] == ["system", "user", "assistant", "user", "user", "assistant"]
    assert "of 2 tools" in r.messages[0].content and r.messages[3].content == "[REPL OUTPUT]:\n2\n" and "Unsupported" in r.messages[4].content

    asked = spark.createDataFrame([(f"a{i}", "large", f"q{i}", 'send_mail', "comm", '{"k": 1}') for i in range(30)] + [("b", "large", "q", "missing", None, None)], "traj_id string, registry string, query string, correct_tool string, category string, params string")
    made = augment.template(asked, tools).collect()
    assert len(made) == 30 and all(m.code_ok and m.turns == 2 and m.augmentation == "template:large" for m in made)
    kinds = {"filter_by_category" in m.messages[2].content for m in made}
    assert kinds == {True, False}
    for m in made:
        assert [x.role for x in m.messages] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"] and m.messages[5].content == "[REPL OUTPUT]:\n{L}\n"
        assert json.loads(m.messages[-1].content.split("FINAL(")[1][:-1]) == {"tool": "send_mail", "params": {"k": 1}}

    whole = augment.augmented(rows, registries, tools, asked).collect()
    assert {(w.stage, w.registry) for w in whole} >= {(0, "small"), (1, "large"), (2, "large"), (3, "small")} and sum(w.stage == 2 for w in whole) == 30


def test_adapted_trajectories(spark):
    t = "array<struct<name:string,description:string,input_schema:string,category:string>>"
    tools = [("srv-send_mail", "Send mail", '{"a": 1}', "c"), ("zz", "last", "{}", "c")]
    rows = spark.createDataFrame([("u", 0, "please mail me", "srv-send_mail", '{"n": 1}', tools), ("u", 1, "q", "gone", "{}", tools)], f"uuid string, turn int, query string, correct_tool string, params string, tools {t}")
    (r,) = adapter.trajectories(rows).collect()
    said = [m.content for m in r.messages]
    assert [m.role for m in r.messages] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"] and r.turns == 2
    assert 'search("mail")' in said[2] and said[3] == '[REPL OUTPUT]:\n[{"name": "srv-send_mail", "description": "Send mail"}]'
    assert json.loads(said[5].split("\n", 1)[1])["inputSchema"] == {"a": 1} and said[6].endswith('FINAL({"tool": "srv-send_mail", "params": {"n": 1}})')


def test_registered_builders(spark):
    from corvane.plans import catalogue

    made = catalogue.QUERIES["augment_pipeline"](spark, "/root/testdata/sf0.001").groupBy("stage").count().collect()
    assert {r.stage for r in made} == {0, 1, 2, 3}
    assert catalogue.QUERIES["adapter_trajectories"](spark, "/root/testdata/sf0.001").where("size(messages) <> 7").isEmpty()
