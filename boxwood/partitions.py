"""How rows are dealt to tasks before work that costs far more than moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes a core below which a table is dealt out: so small a table often lies in one row group, and
#: then one task would do all the work. Larger ones have row groups for every core.
SMALL_SHARE = 8 << 20


#: Bytes of a table, as the planner estimates them, that a task gets of rows that are dealt at any size.
TASK_SHARE = 2 << 20
#: The planner's estimate for rows that it knows nothing of is this or more.
UNKNOWN = 1 << 50


def deal(df: DataFrame) -> DataFrame:
    """The rows over several tasks a core at any size, for work that costs seconds a megabyte: row
    groups and the splits of files may be few and large, and the longest task is as long as they are.
    Costs a shuffle of the rows. A task that is run again gets the same ones."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = 4 if size >= UNKNOWN else max(1, -(-size // (cores * TASK_SHARE)))
    return df.repartition(cores * each, *df.columns)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores if the table is small for them, else as they lie, with no shuffle.
    Rows are dealt by a hash of all their columns, so a task that is run again gets the same ones."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores, *df.columns) if size < cores * SMALL_SHARE else df
