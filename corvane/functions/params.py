"""Parameters of a tool call: an open JSON object, compared through a map of texts."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import EXTRA_WRONG, SPURIOUS, WRONG_FACTORS, WRONG_STRINGS
from .text import strip


def as_map(params: Column) -> Column:
    """Text of every value by key; null where the text is no JSON object."""
    return F.from_json(params, "map<string,string>")


def _same(a: Column, b: Column, stripped: bool) -> Column:
    a, b = F.lower(F.coalesce(a, F.lit("none"))), F.lower(F.coalesce(b, F.lit("none")))
    return strip(a) == strip(b) if stripped else a == b


def match(expected: Column, predicted: Column, stripped: bool = False) -> Column:
    """Every expected key is there with the same text in any case; more keys may be. Nothing expected always matches."""
    keys = F.map_keys(expected)
    held = F.forall(keys, lambda k: F.map_contains_key(predicted, k) & _same(expected[k], predicted[k], stripped))
    return F.when(F.coalesce(F.size(keys), F.lit(0)) <= 0, F.lit(True)).otherwise(F.coalesce(held, F.lit(False)))


def has_required(required: Column, params: Column) -> Column:
    """Every required key has a value that isn't blank."""
    return F.coalesce(F.forall(F.coalesce(required, F.array().cast("array<string>")), lambda k: F.coalesce(strip(params[k]) != "", F.lit(False))), F.lit(False))


def corrupted(params: dict, required: list[str], pick: int) -> dict:
    """A copy that differs in one value; pick decides the key, and the wrong value."""
    if not params:
        return dict(SPURIOUS)
    keys = [k for k in required if k in params] or list(params)
    key = keys[pick % len(keys)]
    old, turn = params[key], pick // len(keys)
    if isinstance(old, bool):
        new = not old
    elif isinstance(old, int | float):
        new = old * WRONG_FACTORS[turn % len(WRONG_FACTORS)]
    elif isinstance(old, str):
        new = WRONG_STRINGS[turn % len(WRONG_STRINGS)]
        new += "_wrong" if new == old else ""
    else:
        new = [] if isinstance(old, list) else {} if isinstance(old, dict) else None
    out = params | {key: new}
    return out | EXTRA_WRONG if out == params else out


@F.pandas_udf(StringType())
def corrupt(params: pd.Series, required: pd.Series, pick: pd.Series) -> pd.Series:
    """corrupted() over JSON texts; text that is no object counts as empty."""
    def one(text, keys, n):
        try:
            value = json.loads(text or "{}")
        except ValueError:
            value = {}
        return json.dumps(corrupted(value if isinstance(value, dict) else {}, list(keys) if keys is not None else [], int(n)))

    return pd.Series([one(*x) for x in zip(params, required, pick, strict=True)])


def call_of(text: str | None) -> tuple[str | None, str | None]:
    """(name, arguments as JSON) of a call written as a Python or JSON dict; arguments may be JSON in a string."""
    try:
        call = ast.literal_eval(text or "")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None, None
    if not isinstance(call, dict):
        return None, None
    args = call.get("arguments", {})
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except ValueError:
            args = {}
    return str(call.get("name", "")), json.dumps(args if isinstance(args, dict) else {})


@F.pandas_udf(StringType())
def call_arguments(calls: pd.Series, tool: pd.Series) -> pd.Series:
    """Arguments of the first of the calls whose name is the tool, or ends in "-" and it; null where none is."""
    def first(texts, name):
        for said, arguments in map(call_of, texts if texts is not None and name is not None else ()):
            if said is not None and (said == name or said.endswith(f"-{name}")):
                return arguments
        return None

    return pd.Series([first(*x) for x in zip(calls, tool, strict=True)], dtype=object)
