"""Bucketing and labelling rules, and engine-independent order and coins in place of random numbers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CATEGORY_RULES, SEARCH_STOP_WORDS


def hash_order(seed: int, *key: Column) -> Column:
    """A pseudo-random order that any engine with md5 gives: rows sort by it as if shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def hash_pick(seed: int, n: int | Column, *key: Column) -> Column:
    """A number from 0 to n - 1 that the key decides."""
    return F.pmod(F.conv(F.substring(hash_order(seed, *key), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often and inside which lambda it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def registry_bucket(size: Column, name: Column) -> Column:
    """small, medium or large by size; a missing size or 0 is read off the registry's name."""
    named = F.when(name.contains("small") | name.endswith("_10"), 10).when(name.contains("medium") | name.endswith("_25"), 25).when(name.contains("large") | name.endswith("_50"), 50).otherwise(100)
    n = F.when(F.coalesce(size, F.lit(0)) != 0, size).otherwise(named)
    return F.when(n <= 15, "small").when(n <= 30, "medium").otherwise("large")


def source_label(source: Column, query_type: Column, registry: Column) -> Column:
    """toucan by the row's source or by its registry's name, else in-house, discovery apart."""
    return F.when((source == "toucan") | F.startswith(registry, F.lit("toucan")), "toucan").when(query_type == "discovery", "inhouse_discovery").otherwise("inhouse")


def stratum(bucket: Column, source: Column) -> Column:
    return F.concat_ws("_", bucket, source)


def adapter_registry(n: Column) -> Column:
    """Registry label of an adapted row with n tools."""
    return F.when(n <= 15, F.concat(F.lit("toucan_"), n.cast("string"))).when(n <= 30, "toucan_medium").when(n <= 60, "toucan_large").otherwise("toucan_xlarge")


#: Any word of any rule: most names hold none, which one search tells.
_ANY_WORD = "|".join(sorted({re.escape(w) for words, _ in CATEGORY_RULES for w in words}))


def category_of(name: Column) -> Column:
    def by_rule(low: Column) -> Column:
        first, *rest = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), category) for words, category in CATEGORY_RULES]
        return F.when(low.rlike(_ANY_WORD), reduce(lambda chain, rule: chain.when(*rule), rest, F.when(*first))).otherwise("general")

    return bound(F.lower(name), by_rule)


def search_word(query: Column, tool: Column) -> Column:
    """First telling word of the tool's name that the query holds, else its first telling word."""
    words = F.split(F.lower(tool), r"[_\-\s]+")
    telling = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*SEARCH_STOP_WORDS))
    use = F.when(F.size(telling) > 0, telling).otherwise(F.slice(words, 1, 2))
    held = lambda u: bound(F.lower(query), lambda low: F.get(F.filter(u, lambda w: F.contains(low, w)), F.lit(0)))
    return bound(use, lambda u: F.coalesce(held(u), F.get(u, F.lit(0))))
