"""Layout of pages from blocks (page, x0, y0, x1, y1, text): columns, reading order, quality of a file, and who reads it.

Blocks are what a reader of the format gives; the operators here order and judge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITAL, COMPLEX, SCANNED, MIXED = "digital_native", "complex_layout", "scanned", "mixed"


def column_of(blocks: DataFrame, keys: list[str], width: str, threshold: float = 0.3) -> DataFrame:
    """blocks with column (from 0) and columns (1 to 3): centres in order, a gap of over threshold x width between neighbours begins a new column.

    Blocks without a place are in column 0. A page is one group: its blocks are bounded by what fits a page.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy(*keys).orderBy("__c", "y0")
    b = blocks.withColumn("__c", centre)
    gap = F.col("__c") - F.lag("__c").over(w)
    b = b.withColumn("__new", F.coalesce((gap > threshold * F.col(width)).cast("int"), F.lit(0)))
    b = b.withColumn("column", F.least(F.lit(2), F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    return b.withColumn("columns", F.max("column").over(Window.partitionBy(*keys)) + 1).drop("__c", "__new")


def reading_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (with column) with position from 1: column after column, from the top, ties from the left."""
    return blocks.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("column", "y0", "x0", "text")))


def page_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the blocks of a page in reading order, parted by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))  # the blocks of one page
    return blocks.groupBy(*keys).agg(parts.alias("__p")).select(*keys, F.array_join(F.transform("__p", lambda x: x["text"]), "\n\n").alias("text"))


def file_quality(pages: DataFrame, key: str, first: int = 10) -> DataFrame:
    """(key, coverage, image_ratio, scan_probability, class, confidence) from pages (page, characters, images, image_share, fonts, tables, columns).

    Of the first pages: the share with more than 50 characters, the mean share of image area, and the share of the five signs of a
    scan (little text, images over most of the page, no fonts, one image a page, few characters).
    """
    p = pages.where(F.col("page") <= first)
    agg = p.groupBy(key).agg(
        F.avg((F.col("characters") > 50).cast("double")).alias("coverage"),
        F.avg("image_share").alias("image_ratio"),
        F.avg("images").alias("__images"),
        F.sum("fonts").alias("__fonts"),
        F.avg("characters").alias("__chars"),
        F.max(F.col("tables") > 0).alias("tables"),
        F.max(F.col("columns") > 1).alias("multi"),
    )
    signs = (F.col("coverage") < 0.3, F.col("image_ratio") > 0.8, F.col("__fonts") == 0, F.col("__images") == 1, F.col("__chars") < 100)
    scan = sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signs), F.lit(0)) / 5.0
    out = agg.withColumn("scan_probability", scan)
    verdict = pdf_class(F.col("coverage"), F.col("scan_probability"), F.col("tables"), F.col("multi"), F.col("image_ratio"))
    return out.withColumn("v", verdict).select(key, "coverage", "image_ratio", "scan_probability", F.col("v.class").alias("class"), F.col("v.confidence").alias("confidence"))


def pdf_class(coverage: Column, scan: Column, tables: Column, multi: Column, images: Column) -> Column:
    """(class, confidence): a scan from 0.7 on; a complex layout with tables, columns or images over half; digital from a coverage of 0.8 on; else mixed."""
    out = lambda name, sure: F.struct(F.lit(name).alias("class"), F.round(sure, 4).alias("confidence"))
    return F.when(scan >= 0.7, out(SCANNED, scan)).when(F.coalesce(tables, F.lit(False)) | F.coalesce(multi, F.lit(False)) | (images > 0.5), out(COMPLEX, F.lit(0.8))).when(coverage >= 0.8, out(DIGITAL, coverage)).otherwise(out(MIXED, F.lit(0.5)))


def processor(quality: Column) -> Column:
    """Which reader a class of files goes to: fast, structure or ocr."""
    return F.when(quality == SCANNED, "ocr").when(quality.isin(COMPLEX, MIXED), "structure").otherwise("fast")


def image_rows(images: DataFrame, least_width: int, least_height: int) -> DataFrame:
    """Images (width, height, ...) large enough to keep; null sizes are too small."""
    return images.where((F.col("width") >= least_width) & (F.col("height") >= least_height))


def ocr_document_confidence(lines: DataFrame, document: str, page: str, confidence: str = "confidence") -> DataFrame:
    """(document, confidence, band): the mean of the means of the pages that have a result; high from 0.9, good from 0.7, fair from 0.5, else poor."""
    pages = lines.where(F.col(confidence).isNotNull()).groupBy(document, page).agg(F.avg(confidence).alias("m"))
    c = pages.groupBy(document).agg(F.round(F.avg("m"), 6).alias("confidence"))
    return c.withColumn("band", F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "good").when(F.col("confidence") >= 0.5, "fair").otherwise("poor"))
