"""Comparing JSON texts regardless of key order and bookkeeping fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that never count as a difference.
IGNORED = ("created_at", "updated_at")


def _normal(value):
    if isinstance(value, dict):
        return {k: _normal(v) for k, v in sorted(value.items()) if k not in IGNORED}
    return [_normal(v) for v in value] if isinstance(value, list) else value


def _canonical(text: str | None) -> str | None:
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    if not isinstance(value, dict | list):
        return None
    return json.dumps(_normal(value), ensure_ascii=False, separators=(",", ":"))


def _canonical_all(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical, na_action="ignore")


def canonical_json(col: Column | str) -> Column:
    """Sorted keys, no bookkeeping fields, array order kept; null unless an object or list."""
    return F.pandas_udf(_canonical_all, "string")(col)


def json_diff(left: DataFrame, right: DataFrame, key: str, text: str = "json") -> DataFrame:
    """H20 over datasets: keys whose documents differ or exist on one side only."""
    a = left.select(key, F.lit(True).alias("_a"), canonical_json(text).alias("left_json"))
    b = right.select(key, F.lit(True).alias("_b"), canonical_json(text).alias("right_json"))
    both = a.join(b, key, "full_outer")
    same = F.coalesce(F.col("left_json") == F.col("right_json"), F.lit(False))
    return both.filter(~same).select(
        key,
        F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").otherwise("differs").alias("change"),
    )
