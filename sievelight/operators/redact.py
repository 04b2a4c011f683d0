"""Redaction of text and boxes, and the check that nothing is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pan
from . import detectors


def blank_out(text: Column, found: Column, sign: str = "█") -> Column:
    """The text with the given (start, length) ranges replaced by as many signs."""
    step = lambda t, m: F.concat(F.substring(t, F.lit(1), m["start"]), F.repeat(F.lit(sign), m["length"]), F.substr(t, m["start"] + m["length"] + 1))
    return F.aggregate(found, text, step)


def redact_text(spans: DataFrame, found: DataFrame, sign: str = "█") -> DataFrame:
    """Spans with their detections blanked out, and the number of those. A detection with ``span_ids`` (a stitched number) blanks
    those spans whole."""
    ranges = found.where("start is not null").select("doc_id", "span_id", F.struct(F.col("start"), F.col("length")).alias("m")) if "start" in found.columns else None
    if "span_ids" in found.columns:
        whole = found.where("span_ids is not null").select("doc_id", F.explode("span_ids").alias("span_id"), F.lit(None).cast("struct<start:int,length:int>").alias("m"))
        ranges = whole if ranges is None else ranges.unionByName(whole)
    per = ranges.groupBy("doc_id", "span_id").agg(F.collect_list("m").alias("_r"), F.count("*").alias("_n"), F.count_if(F.col("m").isNull()).alias("_w"))
    out = spans.join(per, ["doc_id", "span_id"], "left")
    text = F.when(F.col("_w") > 0, F.repeat(F.lit(sign), F.length("text"))).when(F.col("_n") > 0, blank_out(F.col("text"), F.col("_r"), sign)).otherwise(F.col("text"))
    return out.withColumn("redactions", F.coalesce(F.col("_n"), F.lit(0)).cast("int")).withColumn("text", text).drop("_r", "_n", "_w")


def remaining(redacted: DataFrame, detector: str = "card_pan", **options) -> DataFrame:
    """(doc_id, hits_remaining, remaining) of what the detector still finds in single spans."""
    found = detectors.get(detector)(redacted, **options)
    return found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "hit").alias("hits_remaining"), F.count("*").alias("remaining"))


def blanked_numbers(spans: DataFrame, sign: str = "█") -> DataFrame:
    """(doc_id, hits, hits_remaining) of the documents with a valid card number: each number is blanked wherever its text stands in
    the cleaned span, one after the other, and what is left is searched again. A blank parts the digits around it."""
    rows = spans.where(F.col("text").rlike(pan.SOME_DIGITS)).select("doc_id", pan.cleaned(F.col("text")).alias("_c")).withColumn("_m", pan.valid_numbers(F.col("_c"))).where(F.size("_m") > 0)
    left = F.aggregate("_m", F.col("_c"), lambda t, m: F.replace(t, m, F.repeat(F.lit(sign), F.length(m))))
    return rows.groupBy("doc_id").agg(F.sum(F.size("_m")).cast("long").alias("hits"), F.sum(F.size(pan.valid_numbers(left))).cast("long").alias("hits_remaining"))


def render_boxes(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes to paint: detections with geometry on a page that exists, in page units, clamped to the page."""
    p = pages.select("doc_id", "page", "width", "height", "scale")
    b = F.col("bbox")
    some = found.where(b.isNotNull() & ~((b["x0"] == 0) & (b["y0"] == 0) & (b["x1"] == 0) & (b["y1"] == 0))).join(p, ["doc_id", "page"])
    clamp = lambda v, most: F.least(F.greatest(v / F.col("scale"), F.lit(0.0)), most / F.col("scale"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return some.select("doc_id", "page", F.col("field_id").alias("label"), "severity", clamp(b["x0"], w).alias("x0"), clamp(b["y0"], h).alias("y0"), clamp(b["x1"], w).alias("x1"), clamp(b["y1"], h).alias("y1"))
