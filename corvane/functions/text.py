"""Text rules of model answers and tool registries, as Column expressions.

Everything here compiles to built-in expressions, so it stays in generated code; parse_answer alone needs Python, because
it must tell valid JSON objects inside prose by their braces.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ..config import STOP_WORDS

#: Markup that recorded answers carry: fixed values.
CODE_BLOCK = r"(?s)<code>\s*\n?(.*?)(?:</code>|\z)"
FENCED_BLOCK = r"(?s)```(?:repl|python)?\n(.*?)(?:```|\z)"
FINAL_ANSWER = r"(?smd)FINAL\((.+)\)\s*$"
FINAL_VARIABLE = r"FINAL_VAR\((\w+)\)"
FINAL_OBJECT = r"(?s)FINAL\((\{.*?\})\)"
TOOL_FIELD = r'"tool"\s*:\s*"([^"]+)"'
OUTPUT_MARK = "[REPL OUTPUT]"


def strip(s: Column) -> Column:
    """Without white space at both ends, of any kind (trim() takes spaces only)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def first_match(s: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none (regexp_extract gives an empty string)."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def code_blocks(text: Column) -> Column:
    """Blocks between code tags, an unclosed one up to the end; fenced blocks only where there is no code tag at all."""
    tagged = F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(1))
    fenced = F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1))
    return F.filter(F.transform(F.when(F.size(tagged) > 0, tagged).otherwise(fenced), strip), lambda b: b != "")


def final_answer(text: Column, variables: Column | None = None) -> Column:
    """The answer inside FINAL(...), up to the last bracket that ends a line; else the variable that FINAL_VAR names."""
    found = strip(first_match(text, FINAL_ANSWER))
    if variables is None:
        return found
    name = first_match(text, FINAL_VARIABLE)
    value = F.coalesce(variables[name], F.concat(F.lit("[ERROR: Variable '"), name, F.lit("' not found]")))
    return F.coalesce(found, F.when(F.size(variables) > 0, value))


def final_object(text: Column) -> Column:
    """The shortest {...} right inside FINAL( )."""
    return first_match(text, FINAL_OBJECT)


def tool_field(text: Column) -> Column:
    """Tool name in text that isn't valid JSON."""
    return first_match(text, TOOL_FIELD)


def listed_strings(text: Column) -> Column:
    """Strings of the JSON array that spans from the first "[" to the last "]", blank ones left out; null if there is none."""
    items = F.from_json(first_match(text, r"(?s)(\[.*\])"), "array<string>")
    return F.filter(items, lambda x: strip(x) != "")


def clipped(output: Column, most: int, chars: Column | None = None) -> Column:
    """Output of a code block, cut to `most` characters with a note of how long it was; chars: how long, where the output
    is given as its beginning only."""
    chars = F.length(output) if chars is None else chars
    note = F.concat(F.lit("\n... [TRUNCATED, "), chars.cast("string"), F.lit(" total chars]"))
    return F.when(chars > most, F.concat(F.left(output, F.lit(most)), note)).otherwise(output)


def with_error(output: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(output, F.lit("\n[ERROR: "), error, F.lit("]"))).otherwise(output)


def keywords(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Different runs of three or more letters a-z in lower case, stop words left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def tool_keywords(name: Column, description: Column) -> Column:
    return keywords(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))), STOP_WORDS)


def path_or_url(text: Column) -> Column:
    return first_match(text, r"(/[\w/.-]+|https?://[\w/.-]+)")


def quoted(text: Column) -> Column:
    return first_match(text, r"""['"]([^'"]+)['"]""")


def email_address(text: Column) -> Column:
    return first_match(text, r"([\w.+-]+@[\w.-]+)")


def first_integer(text: Column) -> Column:
    return first_match(text, r"\b(\d+)\b")


def slug(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def _objects(text: str):
    """Each outermost {...} of a text, left to right; quotation marks don't hide braces."""
    depth = start = 0
    for i, c in enumerate(text):
        if c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def _load(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def answer_of(text: str | None) -> tuple[str | None, str | None]:
    """(tool, parameters as JSON): of a whole JSON object, else of the first object in the text that parses, else the
    text itself as a tool name if it has no space."""
    if text is None or not text.strip():
        return None, None
    whole = text.strip()
    found = next((o for o in [_load(whole), *map(_load, _objects(whole))] if isinstance(o, dict)), None)
    if found is not None:
        tool = found.get("tool", found.get("name"))
        params = found.get("params", found.get("parameters"))
        return (None if tool is None else str(tool)), (None if params is None else json.dumps(params))
    name = whole.strip("\"'")
    return (name, None) if name and " " not in name else (None, None)


@F.pandas_udf(StructType().add("tool", StringType()).add("params", StringType()))
def parse_answer(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(answer_of, text)), columns=["tool", "params"])


@F.pandas_udf(BooleanType())
def valid_json(text: pd.Series) -> pd.Series:
    """Strictly valid JSON, as Python's parser has it; null text is null."""
    def valid(s):
        if s is None:
            return None
        try:
            json.loads(s)
            return True
        except (ValueError, RecursionError):
            return False

    return text.map(valid)


@F.pandas_udf(StringType())
def spaced_json(text: pd.Series) -> pd.Series:
    """A JSON text with a space after each comma and colon and other than ASCII letters escaped, as token estimates count it; text
    that is no JSON stays."""
    def one(s):
        try:
            return None if s is None else json.dumps(json.loads(s))
        except (ValueError, RecursionError):
            return s

    return text.map(one)
