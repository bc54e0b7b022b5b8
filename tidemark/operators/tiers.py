"""Tiles over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize


def _order(value: str, key: str) -> list:
    return [F.col(value).asc_nulls_last(), F.col(key).asc_nulls_last()]


def tile_borders(df: DataFrame, value: str, key: str, tiles: int) -> list[tuple]:
    """The last (value, key) of each tile but the last; exact order statistics.

    Only the two columns are range-sorted; the driver sees one count per range
    and one row per border.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.col(value).alias("v"), F.col(key).alias("k")).repartitionByRange(parts, *_order("v", "k"))
    narrow = materialize(ranged.withColumn("range", F.spark_partition_id()), "ranks")
    counts = sorted((r[0], r[1]) for r in narrow.groupBy("range").count().collect())
    total = sum(n for _, n in counts)
    size, extra = divmod(total, tiles)
    ends, at = [], 0
    for t in range(tiles - 1):
        at += size + (t < extra)
        ends.append(at)
    wanted, seen = [], 0
    for number, n in counts:
        wanted += [(number, e - seen) for e in ends if seen < e <= seen + n]
        seen += n
    if not wanted:
        return []
    ranked = narrow.where(F.col("range").isin([r for r, _ in wanted])).withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy(*_order("v", "k"))))
    chosen = ranked.where(F.struct("range", "n").isin([F.struct(F.lit(r), F.lit(n)) for r, n in wanted]))
    return [(r["v"], r["k"]) for r in chosen.orderBy("range", "n").collect()]


def ntile(df: DataFrame, value: str, key: str, tiles: int, name: str) -> DataFrame:
    """Adds the tile 1..``tiles`` by ``value`` ascending, nulls last, ties by ``key`` (unique).

    Sizes differ by at most one, larger tiles first, like SQL's NTILE. Rows
    are not moved: the tile is a comparison with the borders.
    """
    borders = tile_borders(df, value, key, tiles)
    # Fewer rows than tiles leave borders of empty tiles out.
    tile = F.lit(1).cast("bigint")
    kind_v, kind_k = df.schema[value].dataType, df.schema[key].dataType
    rank = F.struct(F.col(value).isNull(), F.col(value), F.col(key))
    for v, k in borders:
        border = F.struct(F.lit(v is None), F.lit(v).cast(kind_v), F.lit(k).cast(kind_k))
        tile = tile + (rank > border).cast("bigint")
    return df.withColumn(name, tile)
