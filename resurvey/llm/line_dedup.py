"""Operator 4: lines that spread over many sites are boilerplate and go; DataFrame operations only.

Every distinct line has a HyperLogLog sketch of the sites it stands on; the sketches merge in the
partial aggregation, so a line that a third of all documents hold costs one row per task.  A
sketch decides where its estimate is clear of the threshold; near it the sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import mixed, written

# Log2 of the registers of a sketch; the relative standard error is 1.04 / sqrt(4096) = 1.6 %.
LOG_K = 12
# Estimates within this share of the threshold, and one site more, are counted exactly.
NEAR = 0.1
# A line on this many sites is boilerplate.
MIN_SITES = 5


def _lines(rows: DataFrame, *more: str) -> DataFrame:
    """One row per line that is not blank: row, pos, h, g (two hashes of the line), site, ``more``."""
    parts = rows.select("_row", "site", *more, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = parts.withColumn("line", F.trim("line")).where("line <> ''")
    return line.select("_row", "site", "pos", mixed("line").alias("h"), F.hash("line").alias("g"), *more)


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines (h, g) on at least ``min_sites`` distinct sites, with ``n_sites`` (exact or estimated).

    A NULL site is no site.
    """
    sketches = (
        lines.groupBy("h", "g")
        .agg(F.hll_sketch_agg(mixed("site"), LOG_K).alias("sketch"), F.count("site").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("h", "g", F.hll_sketch_estimate("sketch").alias("n_sites"))
    )
    sketches = written(sketches.where(F.col("n_sites") >= min_sites * (1 - NEAR) - 1), "line-spread")
    near = sketches.where(F.col("n_sites") <= min_sites * (1 + NEAR) + 1).select("h", "g")
    exact = (
        lines.where(F.col("site").isNotNull()).join(near, ["h", "g"], "left_semi")
        .select("h", "g", "site").distinct()
        .groupBy("h", "g").agg(F.count("*").alias("n_sites"))
        .where(F.col("n_sites") >= min_sites)
    )
    clear = sketches.where(F.col("n_sites") > min_sites * (1 + NEAR) + 1)
    return clear.unionByName(exact)


def remove_boilerplate(
    docs: DataFrame, site: str = "source", key: str = "doc_id", text: str = "text",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """All rows and columns of ``docs``, with boilerplate lines gone from ``text``, and three counts.

    Lines are split at ``\\n`` and compared without spaces at their ends; blank lines stay.  Added:
    ``n_lines`` (lines of the text, blank ones included; 0 for NULL), ``n_boilerplate`` (its lines
    found to be boilerplate), ``n_removed`` (those taken out: all, or none in a copy).  A document is
    a copy, which the document dedup is left to deal with, if all its lines are boilerplate and a
    document with another key or text has the same lines in the same order, blank ones aside.  A NULL or empty text and a row with NULL
    site keep their place; repeated rows are treated alike; a NULL key is a key like others.  An
    input column with one of the added names is replaced.
    """
    taken = docs.drop("n_lines", "n_boilerplate", "n_removed")
    # rows are told apart by key and text, so that rows that share a key but not a text stay apart
    rows = taken.select(
        F.struct(*[F.col(f"`{c}`") for c in taken.columns]).alias("doc"),
        F.col(site).alias("site"), F.col(text).alias("text"), mixed(F.col(key), F.col(text)).alias("_row"),
    )
    # two hashes of the lines that are not blank, in their order
    own = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("_s", mixed(own)).withColumn("_t", F.hash(own)).withColumn("_w", F.size(own))
    same = ["_s", "_t", "_w"]
    lines = _lines(rows, *same)
    flagged = spread_lines(lines, min_sites).select("h", "g")
    found = (
        lines.select("_row", "pos", "h", "g", *same)
        .join(flagged, ["h", "g"], "left_semi")
        .groupBy("_row")  # a document's own lines
        .agg(F.collect_set("pos").alias("at"), *[F.first(c).alias(c) for c in same])
    )
    found = written(found, "line-found")
    alike = found.where("size(at) = _w").groupBy(*same).agg(F.min("_row").alias("_a"), F.max("_row").alias("_b")).where("_a <> _b")
    found = found.join(alike.select(*same, F.lit(True).alias("shown")), same, "left").drop(*same)
    copy = F.col("shown").isNotNull()
    joined = rows.join(found, "_row", "left")
    split = F.split("text", "\n")
    n_flagged = F.coalesce(F.size("at"), F.lit(0)).cast("long")
    n_flagged = F.when(F.col("at").isNull(), F.lit(0).cast("long")).otherwise(n_flagged)
    removes = F.col("at").isNotNull() & ~copy
    marks = F.transform(F.sequence(F.lit(0), F.size(split) - 1), lambda i: F.array_contains("at", i))
    kept = F.filter(F.arrays_zip(split.alias("line"), marks.alias("gone")), lambda x: ~x["gone"])
    clean = F.when(removes, F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).otherwise(F.col("text"))
    return joined.select(
        *[clean.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in taken.columns],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        n_flagged.alias("n_boilerplate"),
        F.when(removes, n_flagged).otherwise(F.lit(0).cast("long")).alias("n_removed"),
    )


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with ``length`` set to the characters of the text; NULL without a text."""
    kind = docs.schema[length].dataType
    return docs.withColumn(length, F.length(text).cast(kind))
