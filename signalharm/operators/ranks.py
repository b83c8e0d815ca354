"""Row numbers inside keys of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_cells


def ordered_rank(df: DataFrame, keys: list[str], order: str, cells: int = 128) -> DataFrame:
    """1-based ``rank`` of a numeric ``order`` column inside each key.

    The key's rows are cut into cells of about equal size; a count per cell
    gives the offset and a window inside the cell the rest, so a key that holds
    a third of all rows is sorted by many tasks.
    """
    df = with_cells(df, keys, order, cells)
    sizes = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*keys, "_cell", F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(order))
    return (
        df.join(offsets, [*keys, "_cell"])
        .withColumn("rank", F.col("_off") + inside)
        .drop("_cell", "_off")
    )
