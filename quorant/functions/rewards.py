"""Registry of reward plugins: scalar ones are Column functions, batch ones see a whole batch at once."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fuzzy_match, format_score, last_boxed, weighted_reward

SCALAR: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str):
    def keep(f: Callable[[Column, Column], Column]):
        SCALAR[name] = f
        return f

    return keep


def load(spec: str) -> Callable:
    """`module:function`"""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _reward(response: Column, truth: Column, tail: str, weight: float) -> Column:
    accuracy = F.coalesce(fuzzy_match(last_boxed(response), truth), F.lit(False)).cast("double")
    form = format_score(response, tail)
    return F.struct(weighted_reward(accuracy, form, weight).alias("overall"), form.alias("format"), accuracy.alias("accuracy"))


@register("math")
def math_reward(response: Column, truth: Column) -> Column:
    return _reward(response, truth, r"\\boxed\{.*\}.*", 0.1)


@register("answer_tag")
def answer_tag_reward(response: Column, truth: Column) -> Column:
    accuracy = (F.trim(F.regexp_extract(response, r"(?s)<answer>(.*?)</answer>", 1)) == F.trim(truth)).cast("double")
    form = format_score(response, "<answer>.*</answer>")
    return F.struct(weighted_reward(accuracy, form, 0.5).alias("overall"), form.alias("format"), accuracy.alias("accuracy"))


def apply_batch(df: DataFrame, batch: str, function, schema: str) -> DataFrame:
    """A cross-row reward: one call per batch."""
    return df.groupBy(batch).applyInPandas(function, schema)
