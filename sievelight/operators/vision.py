"""The relational half of photo analysis: boxes, regions, OCR choice, homographies, the visual card check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Labels of a card or ID document and of its number, and default regions as fractions (x0, x1, y0, y1).
CARD_LABELS, NUMBER_LABELS = ("card", "id_card"), ("id_number", "id")
DEFAULT_ROIS = {"expiry": (0.55, 0.95, 0.60, 0.92), "mrz": (0.05, 0.95, 0.75, 1.0), "id_number": (0.20, 0.80, 0.20, 0.55)}
CARD_MARGINS, PAD = (0.05, 0.07), 0.08


def best_box(boxes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """The surest box of each page among the labels; of equals the first by place, then by label, so that the order of rows is nothing."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.col("conf").desc(), "x1", "y1", "x2", "y2", "label")
    return boxes.where(F.col("label").isin(*labels)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def default_roi(kind: str, width: Column, height: Column) -> Column:
    """A region where nothing was detected, in whole pixels."""
    if kind == "pan":
        band = F.floor(height * 0.3)
        top = F.floor(height / 2) - F.floor(band / 2)
        x0, x1, y0, y1 = F.floor(width * 0.08), F.floor(width * 0.92), top, top + band
    else:
        a, b, c, d = DEFAULT_ROIS[kind]
        x0, x1, y0, y1 = F.floor(width * a), F.floor(width * b), F.floor(height * c), F.floor(height * d)
    return F.struct(*[v.cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def rois(pages: DataFrame, boxes: DataFrame, kind: str, labels: tuple[str, ...]) -> DataFrame:
    """The region of each page: of the best labelled box, or else the default."""
    best = best_box(boxes, labels).select("doc_id", "page", F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1")).alias("b"))
    out = pages.join(best, ["doc_id", "page"], "left")
    return out.select("doc_id", "page", F.lit(kind).alias("kind"), F.col("b").isNotNull().alias("detected"), F.coalesce("b", default_roi(kind, F.col("width"), F.col("height"))).alias("roi"))


def card_candidate(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """The card of each page: the surest box, or the page less its margins."""
    best = best_box(boxes, CARD_LABELS).select("doc_id", "page", "x1", "y1", "x2", "y2")
    w, h = F.col("width"), F.col("height")
    mx, my = F.floor(w * CARD_MARGINS[0]), F.floor(h * CARD_MARGINS[1])
    out = pages.join(best, ["doc_id", "page"], "left")
    box = F.struct(F.coalesce("x1", mx.cast("double")).alias("x0"), F.coalesce("y1", my.cast("double")).alias("y0"), F.coalesce("x2", (w - mx).cast("double")).alias("x1"), F.coalesce("y2", (h - my).cast("double")).alias("y1"))
    return out.select("doc_id", "page", F.when(F.col("x1").isNull(), "fallback").otherwise("detector").alias("origin"), box.alias("bbox"))


def best_ocr(results: DataFrame, prefer_digits: bool) -> DataFrame:
    """The best result of each region: digits if preferred, confidence, length; of equals the earlier engine."""
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    keys = ([digits.desc()] if prefer_digits else []) + [F.col("avg_conf").desc(), F.length("text").desc(), F.col("backend_order").asc()]
    w = Window.partitionBy("doc_id", "page", "roi").orderBy(*keys)
    return results.where("success").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def engines_used(results: DataFrame) -> DataFrame:
    return results.where("success and engine <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("engine")).alias("engines"))


def attempts_preview(results: DataFrame, width: int = 40) -> DataFrame:
    """Attempts with a masked preview of what each engine read."""
    return results.select("doc_id", "page", "roi", "backend_order", "engine", "success", T.mask_preview(F.substring("text", 1, width)).alias("preview"))


def map_point(m: Column, x: Column, y: Column) -> Column:
    """A point under a 3x3 homography given by rows; null: the same point."""
    z = m[6] * x + m[7] * y + m[8]
    return F.when(m.isNull(), F.struct(x.alias("x"), y.alias("y"))).otherwise(F.struct(((m[0] * x + m[1] * y + m[2]) / z).alias("x"), ((m[3] * x + m[4] * y + m[5]) / z).alias("y")))


def map_box(box: Column, matrix: Column, dx: Column, dy: Column, back: bool = False) -> Column:
    """The bounding box of a box's corners under a homography: from page to normalised space (less the offset first), or back."""
    d = (F.lit(0.0), F.lit(0.0)) if back else (dx, dy)
    corners = [map_point(matrix, box[a] - d[0], box[b] - d[1]) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    add = (dx, dy) if back else (F.lit(0.0), F.lit(0.0))
    xs, ys = [c["x"] + add[0] for c in corners], [c["y"] + add[1] for c in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def padded(box: Column, width: Column, height: Column, share: float = PAD) -> Column:
    """A box grown by a share of its sides, inside the page."""
    px, py = (box["x1"] - box["x0"]) * share, (box["y1"] - box["y0"]) * share
    return F.struct(F.greatest(box["x0"] - px, F.lit(0.0)).alias("x0"), F.greatest(box["y0"] - py, F.lit(0.0)).alias("y0"), F.least(box["x1"] + px, width).alias("x1"), F.least(box["y1"] + py, height).alias("y1"))


def visual_card(contours: DataFrame) -> DataFrame:
    """Pages that look like a card with a number, from contour boxes: digit-like boxes (by size, aspect and area), 10 to 32 of them,
    level and evenly spaced. Returns (doc_id, page, digit_like_count, spacing_cv, x0, y0, x1, y1) in band coordinates."""
    c = contours.where("card_h > 0").where((F.col("card_w") / F.col("card_h")).between(1.4, 1.9))
    aspect = F.col("pw") / F.col("ph").cast("double")
    c = c.where(F.col("pw").between(F.col("card_w") * 0.01, F.col("card_w") * 0.06) & F.col("ph").between(F.col("card_h") * 0.03, F.col("card_h") * 0.10))
    c = c.where(aspect.between(0.2, 1.0) & (F.col("contour_area") >= F.col("card_area") * 0.0002))
    page = Window.partitionBy("doc_id", "page")
    c = c.withColumn("cx", F.col("px") + F.col("pw") / 2.0).withColumn("cy", F.col("py") + F.col("ph") / 2.0)
    c = c.withColumn("gap", F.col("cx") - F.lag("cx").over(page.orderBy("px", "cx", "py"))).withColumn("level", F.median("cy").over(page))
    out = c.groupBy("doc_id", "page").agg(
        F.count("*").alias("digit_like_count"), F.max(F.abs(F.col("cy") - F.col("level"))).alias("dev"), F.avg("ph").alias("height"), F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("spread"),
        F.min("px").alias("x0"), F.min("py").alias("y0"), F.max(F.col("px") + F.col("pw")).alias("x1"), F.max(F.col("py") + F.col("ph")).alias("y1"),
    )
    out = out.where(F.col("digit_like_count").between(10, 32) & (F.col("dev") <= 0.25 * F.col("height")) & (F.col("spread") / F.col("gap") < 0.6))
    return out.select("doc_id", "page", "digit_like_count", (F.col("spread") / F.col("gap")).alias("spacing_cv"), "x0", "y0", "x1", "y1")


def occluded(skin: Column, dark: Column) -> Column:
    """Whether skin or darkness covers too much of a photo."""
    return F.greatest(skin, dark) > 0.12


def skew(lines: DataFrame, most: int = 20) -> DataFrame:
    """Median angle in degrees of the first detected lines (doc_id, page, line_no, x0, y0, x1, y1) within 45 degrees; 0 without."""
    angle = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    used = F.when((F.col("line_no") < most) & angle.between(-45, 45), angle)
    return lines.groupBy("doc_id", "page").agg(F.coalesce(F.median(used), F.lit(0.0)).alias("skew"))
