"""Page layout: spatial and interval joins, repeated lines, block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import overlap_area

#: Height of the bands that boxes are matched in.
BAND = 32.0


def _banded(df: DataFrame, top: str, bottom: str) -> DataFrame:
    """df once for each band that a vertical extent touches, with band."""
    band = lambda c: F.floor(F.col(c) / BAND).cast("bigint")
    return df.where(F.col(top) <= F.col(bottom)).withColumn("__band", F.explode(F.sequence(band(top), band(bottom))))


def best_overlap(rects: DataFrame, spans: DataFrame, keys: list[str], rect_id: str, span_id: str, least: float = 0.1) -> DataFrame:
    """(keys, rect, span, share): for each rectangle the span of which it covers most, at least a tenth. Both: x0, y0, x1, y1."""
    r = rects.select(*keys, rect_id, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    s = spans.select(*keys, span_id, "x0", "y0", "x1", "y1")
    # Two boxes that overlap meet in a band, and count in the first they share.
    near = _banded(r, "r_y0", "r_y1").join(_banded(s, "y0", "y1"), [*keys, "__band"]).where("x0 < r_x1 and x1 > r_x0 and y0 < r_y1 and y1 > r_y0")
    near = near.where(F.col("__band") == F.greatest(F.floor(F.col("r_y0") / BAND), F.floor(F.col("y0") / BAND)))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    shared = overlap_area(tuple(map(F.col, ("r_x0", "r_y0", "r_x1", "r_y1"))), tuple(map(F.col, ("x0", "y0", "x1", "y1"))))
    rated = near.withColumn("share", F.when(area > 0, shared / area).otherwise(0.0)).where(F.col("share") >= least)
    best = rated.groupBy(*keys, rect_id).agg(F.max(F.struct("share", (-F.col(span_id)).alias("s"))).alias("b"))
    return best.select(*keys, rect_id, (-F.col("b.s")).alias(span_id), F.col("b.share").alias("share"))


def outside_ranges(blocks: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks whose vertical extent touches none of the ranges of their page."""
    extents = _banded(blocks.select(*keys, "y0", "y1").distinct(), "y0", "y1")
    r = _banded(ranges.select(*keys, F.col("y0").alias("__y0"), F.col("y1").alias("__y1")), "__y0", "__y1")
    touched = extents.join(r, [*keys, "__band"]).where("y0 <= __y1 and y1 >= __y0").select(*keys, "y0", "y1").distinct()
    return blocks.join(touched, [*keys, "y0", "y1"], "left_anti").select(*blocks.columns)


def repeated_lines(blocks: DataFrame, keys: list[str], bucket: float = 10.0, pages: int = 3) -> DataFrame:
    """(keys, y_bucket, text, pages) of texts at the same height on at least three pages: headers and footers."""
    rows = blocks.withColumn("y_bucket", F.floor(F.col("y0") / bucket).cast("bigint"))
    return rows.groupBy(*keys, "y_bucket", "text").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages)


def block_fonts(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(F.avg("size").alias("size"), F.bool_or("bold").alias("bold"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


def heading_level(size: str = "size", bold: str = "bold", text: str = "text"):
    """Level of a heading by font size, or 0."""
    short = F.length(text) <= 80
    return F.when(~short, 0).when(F.col(size) >= 18, 1).when(F.col(size) >= 16, 2).when(F.col(size) >= 14, 3).when(F.col(bold) & F.col(size).between(12, 13), 3).otherwise(0)
