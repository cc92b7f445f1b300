"""Positions and neighbours of long series without a whole series in one task.

Numbers come from a range partitioning: each partition counts its rows of each
group, and the running sums of these counts, one row for each group and
partition, tell where its numbers start. Neighbours come from blocks of positions with halo
rows: a row near a block's border is a member of the next block as well, so that
window functions over one block see all they need.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lookup import sent_if_small

#: Positions of a block.
BLOCK = 1 << 16
#: Working columns.
_ID, _PART, _BLOCK = "_row_id", "_part", "_block"


def shared_folder(spark: SparkSession) -> None:
    """Have Spark checkpoint into the folder of ``spark.checkpoint.dir``; into a temporary one if all runs in one process.

    Executors must be able to read what other executors wrote, so on a cluster
    without that setting this is an error.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str = "frame") -> DataFrame:
    """``name``: position of each row in its group from 0, in the given order.

    Rows are told apart by the order; the positions of equal ones are arbitrary.
    The result is written to the shared folder, as all of it must be numbered by
    one partitioning. No partition has to hold a whole group; without ``by`` the
    whole table is numbered.
    """
    # rows that are equal in all keys could not be split: a last key spreads them
    spread = df.withColumn(_ID, F.monotonically_increasing_id())
    keys = [*by, *order, _ID]
    dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_ID, F.monotonically_increasing_id())
    kept = cut(dealt.withColumn(_PART, F.shiftright(_ID, 33)))
    counts = kept.groupBy(*by, _PART).agg(F.min(_ID).alias("_first"), F.count("*").alias("_n"))
    # one row for each group and partition that holds some of it
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = running.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(_PART).alias("_at"), "_first", "_before")
    on = F.col(_PART) == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = kept.join(sent_if_small(starts), on)
    return joined.select(*df.columns, (F.col(_ID) - F.col("_first") + F.col("_before")).cast("long").alias(name))


def in_blocks(df: DataFrame, position: str, halo: int, block: int = BLOCK) -> DataFrame:
    """Rows with their block, and again for each block whose rows lie within ``halo`` positions of them."""
    at = lambda shift: F.floor((F.col(position) + shift) / block)
    return df.withColumn(_BLOCK, F.explode(F.sequence(at(-halo), at(halo))))


def block_window(by: list[str], position: str) -> Window:
    """Window over one block in order of position."""
    return Window.partitionBy(*by, _BLOCK).orderBy(position)


def own_rows(df: DataFrame, position: str, block: int = BLOCK) -> DataFrame:
    """Rows in the block they belong to; those that were only halo go."""
    return df.where(F.col(_BLOCK) == F.floor(F.col(position) / block)).drop(_BLOCK)


def block_groups(by: list[str]) -> list[str]:
    """Columns that group rows by block."""
    return [*by, _BLOCK]
