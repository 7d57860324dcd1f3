"""Lines from loose glyphs: glyphs with a box and no line number become lines in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def polygon_box(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1): the frame of a polygon, an array of struct(x, y); null of an empty one."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(polygon) > 0, box)


def text_lines(glyphs: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """(page columns, line, x0, y0, x1, y1, font_size, text) from glyphs (page columns, x0, y0, x1, y1, char).

    From top to bottom, a glyph opens a line if the part of it above its ``share`` reaches below all glyphs before it; lines count
    from 0, and their glyphs are read from left to right, ties by height, then sign. Windows are of one page; glyphs without a
    box or sign take no part. Size: the median height.
    """
    from_top = Window.partitionBy(*page).orderBy("y0", "x0", "char")
    lowest = F.max("y1").over(from_top.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("y0") + (F.col("y1") - F.col("y0")) * share > F.coalesce(lowest, F.lit(float("-inf"))), 1).otherwise(0)
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("char").isNotNull()
    numbered = glyphs.where(whole).withColumn("opens", opens).withColumn("line", F.sum("opens").over(from_top) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "char"))), lambda g: g["char"]), "")
    return numbered.groupBy(*page, "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median(F.col("y1") - F.col("y0")).alias("font_size"), text.alias("text"))
