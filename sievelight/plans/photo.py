"""Photo runs over provider rows: pages, detector boxes, OCR attempts of regions, contour boxes and what is read after redaction.

The pixel work (rasters, detection, OCR) is a provider's; a run is relational. Regions are the best box or a default, each region
is read by the best attempt, readings become detections, and one row per document is decided. Pages without boxes, attempts or
contours are decided as well.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, redact, vision
from . import packs, policy

#: Region kinds with the labels of their boxes.
REGIONS = {"pan": ("pan",), "expiry": ("expiry",), "mrz": ("mrz",), "id_number": vision.NUMBER_LABELS}
#: What is painted over on an ID beside its numbers.
HIDDEN_LABELS = ("face", "dob")


def readings(pages: DataFrame, boxes: DataFrame, ocr: DataFrame, kind: str) -> DataFrame:
    """What was read in the region of each page, as spans: the best attempt, or nothing by engine "none"."""
    best = vision.best_ocr(ocr.where(F.col("roi") == kind), kind == "pan").select("doc_id", "page", "engine", "text", "avg_conf")
    out = vision.rois(pages, boxes, kind, REGIONS[kind]).join(best, ["doc_id", "page"], "left")
    return out.select("doc_id", F.col("page").cast("long").alias("span_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("roi").alias("bbox"), "page", F.lit("roi_ocr").alias("source"), F.round(F.coalesce("avg_conf", F.lit(0.0)), 4).alias("ocr_conf"), F.lit("line").alias("span_kind"), F.coalesce("engine", F.lit("none")).alias("engine"), F.lit(kind).alias("kind"))


def looks(pages: DataFrame, boxes: DataFrame, contours: DataFrame) -> DataFrame:
    """Detections of pages that look like a card with a number; contours are in the card's coordinates."""
    at = vision.card_candidate(pages, boxes).select("doc_id", "page", F.col("bbox.x0").alias("dx"), F.col("bbox.y0").alias("dy"))
    found = vision.visual_card(contours).join(at, ["doc_id", "page"])
    box = F.struct((F.col("x0") + F.col("dx")).alias("x0"), (F.col("y0") + F.col("dy")).alias("y0"), (F.col("x1") + F.col("dx")).alias("x1"), (F.col("y1") + F.col("dy")).alias("y1"))
    name = F.lit("PAN_SUSPECT_VISUAL")
    return found.select("doc_id", F.lit("card_pan").alias("field_id"), name.alias("text"), name.alias("raw"), box.alias("bbox"), "page", F.lit("visual").alias("source"), F.lit("suspicion").alias("severity"), F.array(name).alias("validators"))


def per_document(pages: DataFrame, remaining: DataFrame | None) -> DataFrame:
    """Quality of each document's pages, and the regions where something is still read after redaction."""
    hidden = F.max(F.coalesce("occlusion_suspected", F.lit(False)))
    docs = pages.groupBy("doc_id").agg(F.min(F.coalesce("blur_score", F.lit(0.0))).alias("blur_score"), hidden.alias("occlusion_suspected"), F.max(F.coalesce("force_band_redact", F.lit(False)) if "force_band_redact" in pages.columns else F.lit(False)).alias("force_band_redact"))
    docs = docs.withColumn("card_candidate_present", F.lit(True))  # the page less its margins, if nothing else
    if remaining is None:
        return docs.withColumn("hits_remaining", F.lit(0).cast("long"))
    return docs.join(remaining.where("severity = 'hit'").groupBy("doc_id").agg(F.count("*").alias("hits_remaining")), "doc_id", "left").fillna(0, ["hits_remaining"])


def _traced(decided: DataFrame, read: DataFrame) -> DataFrame:
    engines = read.where("engine <> 'none' and engine <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("engine")).alias("ocr_backends_used"))
    return decided.join(engines, "doc_id", "left").withColumn("trace", F.struct(F.coalesce("ocr_backends_used", F.array().cast("array<string>")).alias("ocr_backends_used"), F.col("hits_remaining")))


FOUND = ["doc_id", "field_id", "text", "raw", "bbox", "page", "source", "severity", "validators"]


def card_run(pages: DataFrame, boxes: DataFrame, ocr: DataFrame, as_of: date, contours: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Reports of card photos. ``after`` has spans read in the redacted regions, if there are any."""
    pan, expiry = readings(pages, boxes, ocr, "pan"), readings(pages, boxes, ocr, "expiry")
    found = detectors.card_pan_roi(pan).select(*FOUND).unionByName(detectors.card_expiry(expiry, as_of, raw=False).select(*FOUND))
    if contours is not None:
        found = found.unionByName(looks(pages, boxes, contours))
    left = detectors.card_pan_roi(after) if after is not None else None
    decided = policy.decide_card(policy.flags(per_document(pages, left), found))
    return packs.report("global.card_photo.v1", _traced(decided, pan.unionByName(expiry)), found)


def id_run(pages: DataFrame, boxes: DataFrame, ocr: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Reports of ID photos."""
    zone, number = readings(pages, boxes, ocr, "mrz"), readings(pages, boxes, ocr, "id_number")
    found = detectors.mrz(zone).select(*FOUND).unionByName(detectors.id_number(number).select(*FOUND))
    left = detectors.mrz(after) if after is not None else None
    decided = policy.decide_id(policy.flags(per_document(pages, left), found))
    return packs.report("global.id_photo.v1", _traced(decided, zone.unionByName(number)), found)


def paint(reports: DataFrame, pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes to paint over, in page units: hits of confirmed documents (on IDs all fields, faces and dates of birth too), and what is
    suggested where redaction is forced."""
    one = F.explode("detections").alias("d")
    on_id = F.col("pack_id") == "global.id_photo.v1"
    sure = reports.where("decision = 'CONFIRMED'").select("doc_id", "pack_id", one).where((F.col("d.severity") == "hit") & (F.col("d.field_id") == "card_pan") | on_id).select("doc_id", F.col("d.page").alias("page"), F.col("d.field_id").alias("field_id"), F.col("d.severity").alias("severity"), F.col("d.bbox").alias("bbox"))
    forced = reports.where("action = 'FORCED_REDACT_REVIEW'").select("doc_id", F.explode("suggested_redactions").alias("s")).select("doc_id", "s.page", F.lit("card_pan").alias("field_id"), F.lit("suspicion").alias("severity"), F.col("s.bbox").alias("bbox"))
    hidden = None
    for label in HIDDEN_LABELS:
        best = vision.best_box(boxes, (label,)).join(reports.where(on_id & (F.col("decision") == "CONFIRMED")).select("doc_id"), "doc_id", "left_semi")
        rows = best.select("doc_id", "page", F.lit(label).alias("field_id"), F.lit("hit").alias("severity"), F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1")).alias("bbox"))
        hidden = rows if hidden is None else hidden.unionByName(rows)
    return redact.render_boxes(sure.unionByName(forced).unionByName(hidden), pages)


def suggested() -> Column:
    """Number of a report's suggested redactions."""
    return F.coalesce(F.size("suggested_redactions"), F.lit(0))
