"""What registry calls print, in large registries: whole in what an output shows, bounded in what is put together."""

from pyspark.sql import functions as F

from corvane.config import ReplConfig
from corvane.operators import repl

SAID = "array<struct<role:string,content:string>>"
CALLS = ["list_names()", "count()", "get_tool_names_with_descriptions()", 'search("red")', 'search("D T")', 'search("nothing")', 'search("")', 'filter_by_category("ART")', 'filter_by_category("two")', 'get_schema("red_7")', 'get_schema("gone")']


def _tools(n):
    """Repeated names and positions, missing descriptions, categories and schemas."""
    return [("big", i // 2, f"{('red', 'Blue')[i % 2]}_{i % 50}", (None, "Red tool two", "zz")[i % 3], (None, "art")[i % 2], None if i % 4 == 3 else f"{{{i}}}") for i in range(n)] + [("small", 0, "red", None, None, "{}"), ("small", 1, None, "red", "art", "{}")]


def _printed(tools, registry, call):
    """The same by brute force."""
    mine = [t for t in tools if t[0] == registry]
    method, _, arg = call.partition("(")
    arg = arg[:-1].strip('"')
    if not mine:
        return None
    if method == "count":
        return str(len(mine))
    if method == "get_schema":
        return max([(t[1], t[5]) for t in mine if t[2] == arg and t[5] is not None], default=(0, "None"))[1]
    summary = lambda t: f'{{"name": "{t[2]}", "description": "{t[3] or ""}"}}'
    hit = {
        "search": lambda t: arg.lower() in f"{t[2]} {t[3] or ''}".lower(),
        "filter_by_category": lambda t: arg.lower() in ("{}" if t[4] is None else f"{{'category': '{t[4]}'}}").lower() or arg.lower() in (t[3] or "").lower(),
    }.get(method, lambda t: True)
    items = sorted((t[1], f"'{t[2]}'" if method == "list_names" else summary(t)) for t in mine if t[2] is not None and hit(t))
    return "[" + ", ".join(i for _, i in items) + "]"


def test_outputs_of_large_registries(spark):
    tools, config = _tools(3000), ReplConfig(max_output_chars=200, max_turns=50)
    code = [f"print(tools_registry.{c})" for c in CALLS] + ["\n".join(f"print(tools_registry.{c})" for c in CALLS), "print('x')\nprint(tools_registry.list_names())\nprint('y')", ""]
    rows = [(r, r, [("assistant", f"<code>\n{c}\n</code>") for c in code if c]) for r in ("big", "small", "unknown")]
    table = spark.createDataFrame(tools, "registry string, pos long, name string, description string, category string, schema string")
    got = {(r.traj_id, r.code): r.output for r in repl.run_blocks(spark.createDataFrame(rows, f"traj_id string, registry string, messages {SAID}"), table, config).collect()}
    assert len(got) == 3 * (len(code) - 1)
    for (registry, said), output in got.items():
        lines = [_printed(tools, registry, line.removeprefix("print(tools_registry.")[:-1]) if "tools_registry" in line else line[7:-2] for line in said.split("\n")]
        whole = "\n".join(x for x in lines if x is not None) + "\n"
        assert output == (whole if len(whole) <= 200 else f"{whole[:200]}\n... [TRUNCATED, {len(whole)} total chars]"), (registry, said)


def test_answers_hold_what_an_output_shows(spark):
    table = spark.createDataFrame(_tools(3000), "registry string, pos long, name string, description string, category string, schema string")
    calls = spark.createDataFrame([("big", "list_names", ""), ("big", "search", "red"), ("big", "filter_by_category", "art")], "registry string, method string, argument string")
    got = repl._answers(calls, table, 200)
    assert got.where((F.length("answer") < 200) | (F.length("answer") > 200 * 20) | (F.col("chars") < 10_000)).isEmpty() and got.count() == 3
