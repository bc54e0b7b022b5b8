"""References to records that do not exist (problem 6).

Parent keys and child keys are unioned in long form, tagged, and grouped by
(parent table, key). A group without the parent flag is an orphan key; its
child counts are summed by table and period for the report. The grouping is a
aggregation with map-side combine, so a key named by a third of all
children is reduced before the shuffle.

The row-level list keeps only the groups that can hold a problem (no parent, a
deleted parent, or a parent first loaded after the earliest child) and joins
the child rows to those; AQE splits what is still skewed.

Defined results: a null or blank reference refers to nothing and is never
listed; child rows that repeat an id count once, with the first time any of
them was loaded; keys compare trimmed and in lower case; a parent with a null
key is no parent; a null load time is unknown and never late; empty tables
give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import ref_key


@dataclass(frozen=True)
class Parent:
    """A table that is referred to; ``deleted`` is null for tables without soft deletes."""

    df: DataFrame
    name: str
    key: str
    loaded: str
    deleted: str | None = None


@dataclass(frozen=True)
class Child:
    """A table with references: field -> name of the parent table."""

    df: DataFrame
    name: str
    row_id: str
    created: str
    loaded: str
    refs: dict[str, str]


def child_references(children: list[Child]) -> DataFrame:
    """(table_name, row_id, field_name, parent, key, created, loaded), a row per child id and field."""
    parts = []
    for c in children:
        pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(p).alias("parent"), ref_key(f).alias("key")) for f, p in c.refs.items()])
        rows = c.df.select(F.col(c.row_id).alias("row_id"), F.col(c.created).alias("created"), F.col(c.loaded).alias("loaded"), pairs.alias("refs"))
        first = rows.groupBy("row_id").agg(F.min_by(F.struct("created", "refs"), F.struct(F.col("loaded").isNull(), "loaded", "created", "refs")).alias("r"), F.min("loaded").alias("loaded"))
        exploded = first.select("row_id", F.col("r.created").alias("created"), "loaded", F.inline("r.refs"))
        parts.append(exploded.where(F.col("key").isNotNull()).select(F.lit(c.name).alias("table_name"), "row_id", "field_name", "parent", "key", "created", "loaded"))
    return reduce(DataFrame.unionByName, parts)


def reference_groups(refs: DataFrame, parents: list[Parent]) -> DataFrame:
    """(parent, key, is_parent, n_refs, parent_loaded, parent_deleted, child_loaded) per key."""
    long = [refs.select("parent", "key", F.lit(False).alias("is_parent"), F.lit(None).cast("timestamp").alias("p_loaded"), F.lit(None).cast("timestamp").alias("p_deleted"), F.col("loaded").alias("c_loaded"))]
    for p in parents:
        gone = F.col(p.deleted) if p.deleted else F.lit(None)
        long.append(p.df.select(F.lit(p.name).alias("parent"), ref_key(p.key).alias("key"), F.lit(True).alias("is_parent"), F.col(p.loaded).alias("p_loaded"), gone.cast("timestamp").alias("p_deleted"), F.lit(None).cast("timestamp").alias("c_loaded")).where(F.col("key").isNotNull()))
    tagged = reduce(DataFrame.unionByName, long)
    return tagged.groupBy("parent", "key").agg(
        F.max("is_parent").alias("is_parent"),
        F.count_if(~F.col("is_parent")).alias("n_refs"),
        F.min("p_loaded").alias("parent_loaded"),
        F.min("p_deleted").alias("parent_deleted"),
        F.min("c_loaded").alias("child_loaded"),
    )


def broken_references(children: list[Child], parents: list[Parent]) -> DataFrame:
    """(table_name, row_id, field_name, problem, created_month), the first problem that holds.

    ``missing``: no parent row; ``deleted``: the parent's earliest deletion is
    not after the child's creation; ``late``: the parent was first loaded after
    the child.
    """
    refs = child_references(children)
    groups = reference_groups(refs, parents).where(F.col("n_refs") > 0)
    suspects = groups.where(~F.col("is_parent") | F.col("parent_deleted").isNotNull() | (F.col("parent_loaded") > F.col("child_loaded")))
    joined = refs.join(suspects.select("parent", "key", "is_parent", "parent_loaded", "parent_deleted"), ["parent", "key"])
    problem = F.when(~F.col("is_parent"), "missing").when(F.col("parent_deleted") <= F.col("created"), "deleted").when(F.col("parent_loaded") > F.col("loaded"), "late")
    listed = joined.select("table_name", "row_id", "field_name", problem.alias("problem"), F.date_format("created", "yyyy-MM").alias("created_month"))
    return listed.where(F.col("problem").isNotNull())


def broken_reference_counts(children: list[Child], parents: list[Parent]) -> DataFrame:
    """(table_name, field_name, problem, created_month, n).

    Missing parents are counted from the groups: children are summed by period
    before the shuffle, and of the groups without the parent flag the sums are
    added up, no row being joined. What depends on the child's own time
    (deleted, late) is counted from the rows of the groups it can be in.
    """
    refs = child_references(children)
    month = F.date_format("created", "yyyy-MM").alias("created_month")
    by_period = refs.groupBy("parent", "key", "table_name", "field_name", month).agg(F.count(F.lit(1)).alias("n"))
    cell = F.struct("table_name", "field_name", "created_month", "n")
    tagged = [by_period.select("parent", "key", F.lit(False).alias("is_parent"), cell.alias("cell"))]
    for p in parents:
        own = p.df.select(F.lit(p.name).alias("parent"), ref_key(p.key).alias("key")).where(F.col("key").isNotNull())
        tagged.append(own.select("parent", "key", F.lit(True).alias("is_parent"), F.lit(None).cast(by_period.select(cell.alias("c")).schema["c"].dataType).alias("cell")))
    # A group has a cell for each table, field and month.
    groups = reduce(DataFrame.unionByName, tagged).groupBy("parent", "key").agg(F.max("is_parent").alias("is_parent"), F.collect_list("cell").alias("cells"))
    missing = groups.where(~F.col("is_parent")).select(F.inline("cells")).groupBy("table_name", "field_name", F.lit("missing").alias("problem"), "created_month").agg(F.sum("n").alias("n"))
    timed = broken_references(children, parents).where(F.col("problem") != "missing").groupBy("table_name", "field_name", "problem", "created_month").agg(F.count(F.lit(1)).alias("n"))
    return missing.unionByName(timed)
