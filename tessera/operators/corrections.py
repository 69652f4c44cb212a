"""Corrections made by hand: kept apart from what is derived, and laid over it at each run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values


def as_kind(value: Column, kind: str) -> Column:
    """A correction's text in the column's kind."""
    if kind == "integer":
        return F.coalesce(F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    if kind == "currency":
        return values.amount(value)
    if kind == "date":
        return values.date_serial(value)
    return value


def split_composite(corrections: DataFrame, composites: Mapping[str, Sequence[str]]) -> DataFrame:
    """``Adulti · Bambini`` with ``9 · 3`` as a correction of each of its columns."""
    out = corrections.where(~F.col("field").isin(list(composites)))
    for name, fields in composites.items():
        parts = F.split(F.trim("value"), r"(?U)[·,;/\s]+")
        rows = F.array(*[F.struct(F.lit(f).alias("field"), F.get(parts, k).alias("value")) for k, f in enumerate(fields)])
        named = corrections.where(F.col("field") == name).withColumn("_row", F.explode(rows))
        out = out.unionByName(named.withColumns({"field": F.col("_row.field"), "value": F.col("_row.value")}).drop("_row").where("value <> ''"))
    return out


def overlay(df: DataFrame, corrections: DataFrame, key: str, kinds: Mapping[str, str], composites: Mapping[str, Sequence[str]] = {}) -> DataFrame:  # noqa: B006
    """``df`` with the corrections (key, field, value) laid over; blank values change nothing.

    Corrections become one row per key before they meet the table, so the table isn't multiplied.
    """
    usable = split_composite(corrections, composites).where((F.trim("value") != "") & F.col("field").isin(list(kinds)))
    wide = usable.groupBy(F.col("key").alias("_key")).agg(*[F.max(F.when(F.col("field") == f, F.trim("value"))).alias(f"_new_{f}") for f in kinds])
    both = df.join(wide, df[key] == F.col("_key"), "left")
    new = {f: F.coalesce(as_kind(F.col(f"_new_{f}"), kind), F.col(f)) for f, kind in kinds.items()}
    new = {f: F.when(F.col(f"_new_{f}").isNull(), F.col(f)).otherwise(c) for f, c in new.items()}
    return both.select(*[new[c].alias(c) if c in new else df[c] for c in df.columns])


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """The latest of current and changed rows per key; a blank value that isn't skipped deletes."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (*keys, "_new")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("_new", at)).alias("_row"))
    return latest.select(*keys, "_row.*").where((F.trim("value") != "") | F.coalesce(F.col("skipped"), F.lit(False)))
