"""Rules of text, labels and parameters on cases whose result is known."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import labels as L
from corvane.functions import params as P
from corvane.functions import text as T


def one(spark, column, **values):
    """The column's value over one row of texts."""
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'long' if isinstance(values[n], int) else 'string'}" for n in names))
    return df.select(column.alias("x")).head().x


@pytest.mark.parametrize(
    ("text", "blocks"),
    [
        ("<code>\na = 1\n</code> and <code>b</code>", ["a = 1", "b"]),
        ("<code>open until the end\nx", ["open until the end\nx"]),
        ("<code>  </code> ```python\nprint(1)\n```", []),
        ("```repl\nx\n``` ```\ny\n```", ["x", "y"]),
        ("no code", []),
    ],
)
def test_code_blocks(spark, text, blocks):
    assert one(spark, T.code_blocks(F.col("t")), t=text) == blocks


@pytest.mark.parametrize(
    ("text", "answer"),
    [("FINAL(a)", "a"), ("x\nFINAL( a(b) )  \ny", "a(b)"), ("FINAL(a) then FINAL(b)", "a) then FINAL(b"), ("FINAL(a)\u0085more", None), ("FINAL a", None), ("FINAL(a) more", None), ("FINAL(a\nb)", "a\nb")],
)
def test_final_answer(spark, text, answer):
    assert one(spark, T.final_answer(F.col("t")), t=text) == answer


def test_final_variable(spark):
    names = F.create_map(F.lit("x"), F.lit("42"))
    assert one(spark, T.final_answer(F.col("t"), names), t="FINAL_VAR(x)") == "42"
    assert one(spark, T.final_answer(F.col("t"), names), t="FINAL_VAR(y)") == "[ERROR: Variable 'y' not found]"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"tool": "a", "params": {"k": 1}}', ("a", '{"k": 1}')), ('so {bad} then {"name": "b", "parameters": {}} ok', ("b", "{}")), ('"plain_name"', ("plain_name", None)), ("two words", (None, None)),
        ('{"x": 1}', (None, None)), ('"a string"', (None, None)), ("", (None, None)), (None, (None, None)), ('{"tool": "a", "params": {"k": NaN}}', ("a", '{"k": NaN}')),
    ],
)
def test_answers(text, want):
    assert T.answer_of(text) == want


def test_output_and_lists(spark):
    assert one(spark, T.clipped(F.col("t"), 3), t="abcdef") == "abc\n... [TRUNCATED, 6 total chars]"
    assert one(spark, T.clipped(F.col("t"), 3), t="abc") == "abc"
    assert one(spark, T.with_error(F.col("t"), F.lit("E")), t="a") == "a\n[ERROR: E]"
    assert one(spark, T.listed_strings(F.col("t")), t='Here: ["a", " ", "b"] done') == ["a", "b"]
    assert one(spark, T.strip(F.col("t")), t="  a\n") == "a"
    assert set(one(spark, T.tool_keywords(F.col("n"), F.col("d")), n="send_email", d="Will send the list to all")) == {"send", "email"}


def test_buckets_and_categories(spark):
    for name, bucket in (("small_10", "small"), ("my_25", "medium"), ("xlarge_100", "large"), ("other", "large")):
        assert one(spark, L.registry_bucket(F.lit(0), F.col("n")), n=name) == bucket
    assert one(spark, L.registry_bucket(F.col("n"), F.lit("small")), n=30) == "medium"
    for name, category in (("send_email", "communication"), ("Read_File", "filesystem"), ("widget", "web"), ("thing", "general"), ("translate_it", "utility")):
        assert one(spark, L.category_of(F.col("n")), n=name) == category
    assert one(spark, L.search_word(F.col("q"), F.col("n")), q="Post to Slack", n="send_slack_message") == "slack"
    assert one(spark, L.search_word(F.col("q"), F.col("n")), q="nothing", n="get-do") == "get"


def test_hash_order_is_the_same_everywhere(spark):
    import hashlib

    got = one(spark, L.hash_pick(42, 7, F.col("k")), k="abc")
    assert got == int(hashlib.md5(b"42|abc").hexdigest()[:8], 16) % 7


@pytest.mark.parametrize(
    ("expected", "predicted", "plain", "stripped"),
    [('{"a": "X"}', '{"a": "x", "b": 1}', True, True), ('{"a": " x"}', '{"a": "x"}', False, True), ('{"a": 1}', "{}", False, False), ("{}", None, True, True), ('{"a": 16.0}', '{"a": 16}', False, False), ('{"a": null}', '{"a": "none"}', True, True)],
)
def test_params_match(spark, expected, predicted, plain, stripped):
    df = spark.createDataFrame([(expected, predicted)], "e string, p string")
    row = df.select(P.match(P.as_map(F.col("e")), P.as_map(F.col("p"))).alias("a"), P.match(P.as_map(F.col("e")), P.as_map(F.col("p")), True).alias("b")).head()
    assert (row.a, row.b) == (plain, stripped)


def test_wrong_params_always_differ():
    for params in ({}, {"a": True}, {"a": 0}, {"a": 5}, {"a": "something else"}, {"a": [1]}, {"a": {"b": 1}}, {"a": None}, {"a": 1, "b": "x"}):
        for pick in range(12):
            wrong = P.corrupted(params, ["b"], pick)
            assert json.dumps(wrong) != json.dumps(params)
    assert P.corrupted({"a": 1, "b": "x"}, ["b"], 0) == {"a": 1, "b": "something else"}
    assert P.corrupted({"a": 0}, [], 0) == {"a": 0, "_extra_wrong_param": "injected_by_negative_generator"}


def test_calls_in_python_notation():
    assert P.call_of("{'name': 'srv-f', 'arguments': '{\"a\": true}'}") == ("srv-f", '{"a": true}')
    assert P.call_of("{'name': 'f', 'arguments': {'a': None}}") == ("f", '{"a": null}')
    assert P.call_of("{'name': 'f', 'arguments': 'no json'}") == ("f", "{}")
    assert P.call_of("__import__('os')") == (None, None)


def test_settings():
    from corvane.config import ReplConfig, settings

    text = '# all\n\nmodel:\n  name: "a:b # c"\n  url: http://x:1  # where\n  heat: 0.5\nrepl:\n  level_1:\n    max_turns: 7\n    imports: ["re"]\n  level_3:\n    timeout_seconds: 60\nlast: [1, 2]\n'
    got = settings(text.replace(" # c", ""))
    assert got == {"model": {"name": "a:b", "url": "http://x:1", "heat": 0.5}, "repl": {"level_1": {"max_turns": 7, "imports": ["re"]}, "level_3": {"timeout_seconds": 60}}, "last": [1, 2]}
    assert ReplConfig.of(got, 1) == ReplConfig(max_turns=7) and ReplConfig.of(got, 2) == ReplConfig() and ReplConfig.of(got, 3) == ReplConfig(max_output_chars=4000, timeout_seconds=60)
