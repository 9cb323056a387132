"""Category names."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackscan.fixed import CATEGORY_NAMES


def category_map() -> Column:
    """The id -> name table as a constant map."""
    table = {str(k): v for k, v in CATEGORY_NAMES.items()}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def category_name(category: Column) -> Column:
    """Name of one category: an id is looked up, a word is lower-cased."""
    names = category_map()
    is_id = category.rlike("^-?[0-9]+$")
    return F.when(is_id, F.coalesce(F.try_element_at(names, category), F.lit("Unknown"))).otherwise(
        F.lower(category))


def category_names(categories: Column) -> Column:
    """Names of a technology's categories; ``Unknown`` when it has none."""
    return F.coalesce(F.transform(categories, category_name), F.array(F.lit("Unknown")))
