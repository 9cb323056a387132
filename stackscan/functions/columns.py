"""Small column helpers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def holds_any(text: Column, *literals: str) -> Column:
    """Whether a text holds one of the literals: a cheap guard before an expensive regex."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in literals])


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or null when nothing matched."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


def unquote(col: Column) -> Column:
    return F.regexp_replace(col, "^[\"']|[\"']$", "")


def any_contains(text: Column, words) -> Column:
    """True when ``text`` contains one of the literal ``words`` (one pass over the text)."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def first_of_each(items: Column, key: str, last: bool = False) -> Column:
    """The first item, or the last, of every value of the struct field ``key``, in array order."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(
        x[key].alias("k"), (-i if last else i).alias("i"), x.alias("x"))))
    kept = bind(placed, lambda rows: F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["k"] != r["k"])))
    back = F.sort_array(F.transform(kept, lambda r: F.struct(F.abs(r["i"]).alias("i"), r["x"].alias("x"))))
    return F.transform(back, lambda r: r["x"])


def last_per_key(entries: Column) -> Column:
    """Map from an array of (key, value) structs; the last entry of a key wins."""
    return F.map_from_entries(first_of_each(entries, "key", last=True))


def unnest(frame: DataFrame, keep: list[str], items: str | Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array item. For a plain ``explode`` Spark first filters by the array's size and
    so computes the array several times; the outer form computes it once."""
    rows = F.posexplode_outer(items).alias(pos, name) if pos else F.explode_outer(items).alias(name)
    return frame.select(*keep, rows).filter(F.col(name).isNotNull())


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out

