"""Lookups in sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_in(values: Column, x: Column) -> Column:
    """How many of the sorted ``values`` are at most ``x``, found by halving."""
    halvings = F.sequence(F.lit(0), F.length(F.bin(F.size(values))))  # one more than needed does no harm
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halved(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        open_ = state["low"] < state["high"]
        below = open_ & (F.get(values, middle) <= x)
        return F.struct(F.when(below, middle + 1).otherwise(state["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"))

    return F.aggregate(halvings, start, halved, lambda state: state["low"])
