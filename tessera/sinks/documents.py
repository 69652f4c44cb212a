"""Documents from blocks: Markdown files, HTML previews, and results kept by version."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.texts import escaped
from tessera.operators import blocks as ops
from tessera.sinks import folders


def _inline(runs: Column) -> Column:
    """Runs with their looks; a link's target is shown, not followed, as it comes from somebody else's file."""

    def run(r):
        out = escaped(r["text"])
        for look, tag in (("code", "code"), ("bold", "strong"), ("italic", "em")):
            out = F.when(r[look], F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
        return F.when(r["link"] != "", F.concat(F.lit('<span title="'), escaped(r["link"]), F.lit('">'), out, F.lit("</span>"))).otherwise(out)

    return F.array_join(F.transform(runs, run), "")


def _table(rows: Column) -> Column:
    def line(cells, tag):
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: line(r, "td"))
    return F.concat(F.lit("<table><thead>"), line(rows[0], "th"), F.lit("</thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table>"))


def html_preview(blocks: DataFrame, n: int = ops.PREVIEW_BLOCKS) -> DataFrame:
    """doc_id, html and partial: the first blocks with all text escaped, items in lists, runs, tables and images where blocks have them."""
    shown = ops.tagged_lists(ops.preview(blocks, n=n))
    text = escaped(F.coalesce("text", F.lit("")))
    if "runs" in blocks.columns:
        text = F.when((F.col("kind") != "code") & (F.size("runs") > 0), _inline(F.col("runs"))).otherwise(text)
    tag = (
        F.when(F.col("kind") == "title", F.concat(F.lit("h"), F.least(F.greatest("level", F.lit(1)), F.lit(6)).cast("string")))
        .when(F.col("kind") == "list", "li").when(F.col("kind") == "quote", "blockquote").when(F.col("kind") == "code", "pre").otherwise("p")
    )
    if "extra" in blocks.columns:  # an image without words shows its file's name
        text = F.when((F.col("kind") == "image") & (F.coalesce("text", F.lit("")) == ""), escaped(F.substring_index("extra", "/", -1))).otherwise(text)
    body = F.when(F.col("kind") == "rule", "<hr>")
    if "rows" in blocks.columns:
        body = body.when((F.col("kind") == "table") & (F.size("rows") > 0), _table(F.col("rows")))
    body = body.otherwise(F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    wrap = lambda c, end: F.coalesce(F.concat(F.lit("</" if end else "<"), F.col(c), F.lit(">")), F.lit(""))
    parts = shown.withColumn("_part", F.concat(wrap("opens", False), body, wrap("closes", True)))
    listed = F.array_sort(F.collect_list(F.struct("block_no", "_part")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["_part"]), "").alias("html"), F.bool_or("partial").alias("partial"))


def write_markdown(blocks: DataFrame, path: str) -> None:
    """Documents as Markdown texts, one row each."""
    ops.markdown(ops.list_numbers(blocks)).write.parquet(path)


_VERSION = re.compile(r"version=(\d+)")
_ATTEMPT = re.compile(r"attempt=(\d+)")


def _numbered(spark: SparkSession, path: str, name: re.Pattern) -> list[int]:
    return sorted(int(m[1]) for x in folders.names(spark, path) if (m := name.fullmatch(x)))


def _whole(spark: SparkSession, path: str, version: int) -> str | None:
    """The newest whole attempt at a version."""
    attempts = _numbered(spark, f"{path}/version={version}", _ATTEMPT)
    return f"{path}/version={version}/attempt={attempts[-1]}" if attempts else None


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A result as one version. It is written under another name and takes its place when it is whole.

    Who reads meanwhile has the version before; so has everybody if the write dies. A version that is there is replaced by
    another attempt beside it, which counts from then on.
    """
    spark, draft = df.sparkSession, f"{path}/{folders.UNFINISHED}/{uuid.uuid4().hex}"
    try:
        df.write.parquet(draft)
        attempt = max(_numbered(spark, f"{path}/version={version}", _ATTEMPT), default=0) + 1
        folders.rename(spark, draft, f"{path}/version={version}/attempt={attempt}")
    finally:
        folders.remove(spark, draft)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole, oldest first."""
    return [v for v in _numbered(spark, path, _VERSION) if _whole(spark, path, v)]


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows, the latest one's if none is named; no other version's files are looked at."""
    found = versions(spark, path)
    if not found or version not in (None, *found):
        raise ValueError(f"{path} has no version" + (f" {version}" if version is not None else ""))
    return spark.read.parquet(_whole(spark, path, found[-1] if version is None else version))


def publish(spark: SparkSession, path: str, view: str) -> int:
    """Switches a view to the latest version; queries that began on another one end on it. Returns the version."""
    read_version(spark, path).createOrReplaceTempView(view)
    return versions(spark, path)[-1]


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Takes away all versions but the latest ``keep``, and older attempts at those, and returns the versions' numbers."""
    found = versions(spark, path)[::-1]
    for version in found[keep:]:
        folders.remove(spark, f"{path}/version={version}")
    for version in found[:keep]:
        for attempt in _numbered(spark, f"{path}/version={version}", _ATTEMPT)[:-1]:
            folders.remove(spark, f"{path}/version={version}/attempt={attempt}")
    return found[keep:]


def evolved(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: columns (name and type) that older rows lack are there as nulls; those that exist stay."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
