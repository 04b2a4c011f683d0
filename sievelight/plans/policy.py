"""Decisions of documents.

Each policy takes one row per document with the flags it needs (``flags`` makes them with one aggregate and a left join, so that
documents without detections are decided as well) and adds decision, reasons (codes in order) and, for the card policy, action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRMED, REVIEW, REJECTED = "CONFIRMED", "REVIEW", "REJECTED"
#: Characters below which a document counts as empty.
LEAST_CHARS = 30


@dataclass(frozen=True)
class PolicyConfig:
    blur_max: float = 20.0
    id_blur_max: float = 18.0
    #: Kept for the configuration's sake; no rule reads it.
    ocr_conf_strict: float = 0.70


#: Codes are fixed values; the descriptions are ours.
REASONS = {
    "PAN_CONFIRMED": "A card number passed its checksum.",
    "PAN_SUSPECT": "Something reads like a card number but its checksum fails.",
    "PAN_SUSPECT_VISUAL": "The picture looks like a card number that could not be read.",
    "EXPIRY_ONLY": "An expiry date was read, but no valid card number.",
    "QUALITY_LOW": "The picture or the extraction is too poor to decide.",
    "OCCLUSION": "Something seems to cover part of the picture.",
    "PAN_REMAINS": "A card number can still be read after redaction.",
    "MRZ_CONFIRMED": "A machine-readable zone was read.",
    "ID_SUSPECT": "An identity number was read but cannot be checked.",
    "MRZ_REMAINS": "A machine-readable zone can still be read after redaction.",
    "EXTRACTION_EMPTY": "Too little text was extracted to inspect.",
    "EXTRACTION_QUALITY_LOW": "The quality of the extracted text is below the threshold.",
    "PAN_SUSPECT_OCR_LOW_CONF": "A badly read number fails the card checksum.",
    "PAN_REMAINS_AFTER_REDACTION": "A card number is still found after redaction.",
    "NO_PII_FOUND": "No field of the profile was found.",
}


def described(codes: Column) -> Column:
    """Codes with their descriptions, array of (code, description)."""
    lookup = F.create_map(*[x for kv in REASONS.items() for x in map(F.lit, kv)])
    return F.transform(codes, lambda c: F.struct(c.alias("code"), F.element_at(lookup, c).alias("description")))


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), code) for cond, code in pairs]), lambda c: c.isNotNull())


def flags(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with counts of its detections by field, severity and source."""
    of = lambda field, *more: F.count_if((F.col("field_id") == field) & (more[0] if more else F.lit(True)))
    visual = F.col("source") == "visual"
    per = found.groupBy("doc_id").agg(
        of("card_pan", (F.col("severity") == "hit") & ~visual).alias("pan_hits"), of("card_pan", (F.col("severity") == "suspicion") & ~visual).alias("pan_suspicions"), of("card_pan", visual).alias("pan_visual"),
        of("card_pan", F.col("source") == "roi_ocr").alias("pan_roi"), of("card_expiry").alias("expiries"), of("mrz").alias("mrzs"), of("id_number").alias("ids"),
        F.count_if(F.col("severity") == "hit").alias("hits"), F.count_if(F.col("severity") == "suspicion").alias("suspicions"),
    )
    names = [c for c in per.columns if c != "doc_id"]
    return docs.join(per, "doc_id", "left").fillna(0, names)


def decide_pci(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Text documents: char_count, hits, suspicions, remaining (detections after redaction)."""
    empty, suspect = F.coalesce("char_count", F.lit(0)) < least_chars, F.col("suspicions") > 0
    left = (F.col("hits") > 0) & (F.coalesce("remaining", F.lit(0)) > 0)
    decision = F.when(empty, REJECTED).when(suspect | left, REVIEW).otherwise(CONFIRMED)
    reasons = codes((empty, "EXTRACTION_EMPTY"), (~empty & suspect, "PAN_SUSPECT_OCR_LOW_CONF"), (~empty & ~suspect & left, "PAN_REMAINS_AFTER_REDACTION"))
    return rows.withColumn("decision", decision).withColumn("reasons", reasons).withColumn("redacted", ~empty & ~suspect & (F.col("hits") > 0))


def decide_card(rows: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Card photos: detection counts, card_candidate_present, blur_score, occlusion_suspected, hits_remaining (after redaction),
    force_band_redact. Adds suggestions (whether redactions are only suggested) and keeps_redacted."""
    candidate, blurred = F.col("card_candidate_present"), F.coalesce("blur_score", F.lit(0.0)) < config.blur_max
    confirmed = (F.col("pan_hits") > 0) & candidate
    visual = (F.col("pan_visual") > 0) & (F.col("pan_roi") == 0)
    listed = codes((visual, "PAN_SUSPECT_VISUAL"), (F.col("pan_suspicions") > 0, "PAN_SUSPECT"), (F.col("expiries") > 0, "EXPIRY_ONLY"), (F.col("occlusion_suspected"), "OCCLUSION"), (blurred, "QUALITY_LOW"))
    none = F.size(listed) == 0
    remains = confirmed & (F.coalesce("hits_remaining", F.lit(0)) > 0)
    decision = F.when(remains, REVIEW).when(confirmed, CONFIRMED).otherwise(REVIEW)
    reasons = F.when(remains, F.array(F.lit("PAN_REMAINS"))).when(confirmed, F.array(F.lit("PAN_CONFIRMED"))).when(none, F.array(F.lit("QUALITY_LOW"))).otherwise(listed)
    suggest = ~confirmed & visual
    action = F.when(suggest & F.coalesce("force_band_redact", F.lit(False)), "FORCED_REDACT_REVIEW")
    return rows.withColumn("decision", decision).withColumn("reasons", reasons).withColumn("suggestions", suggest).withColumn("keeps_redacted", confirmed & ~remains).withColumn("action", action)


def decide_id(rows: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """ID photos: mrzs, ids, blur_score, occlusion_suspected, hits_remaining."""
    mrz, hidden = F.col("mrzs") > 0, F.coalesce("occlusion_suspected", F.lit(False))
    poor = hidden | (F.coalesce("blur_score", F.lit(0.0)) < config.id_blur_max)
    listed = codes((F.col("ids") > 0, "ID_SUSPECT"), (poor, "QUALITY_LOW"), (hidden, "OCCLUSION"))
    remains = mrz & (F.coalesce("hits_remaining", F.lit(0)) > 0)
    decision = F.when(remains, REVIEW).when(mrz, CONFIRMED).when(F.size(listed) > 0, REVIEW).otherwise(REJECTED)
    reasons = F.when(remains, F.array(F.lit("MRZ_REMAINS"))).when(mrz, F.array(F.lit("MRZ_CONFIRMED"))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("QUALITY_LOW")))
    return rows.withColumn("decision", decision).withColumn("reasons", reasons)


def decide_uk(rows: DataFrame, threshold: float = 0.5, least_chars: int = LEAST_CHARS) -> DataFrame:
    """UK bank statements: quality_score, char_count, hits (strict detections)."""
    poor, empty, none = F.coalesce("quality_score", F.lit(0.0)) < threshold, F.coalesce("char_count", F.lit(0)) < least_chars, F.col("hits") == 0
    decision = F.when(poor | empty, REJECTED).when(none, REVIEW).otherwise(CONFIRMED)
    return rows.withColumn("decision", decision).withColumn("reasons", codes((poor, "EXTRACTION_QUALITY_LOW"), (~poor & empty, "EXTRACTION_EMPTY"), (~poor & ~empty & none, "NO_PII_FOUND")))


def decide_pci_legacy(rows: DataFrame, threshold: float = 0.5, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The older card policy: quality first, and only remaining hits, or a missing redaction, force a review."""
    poor, empty, suspect = F.coalesce("quality_score", F.lit(0.0)) < threshold, F.coalesce("char_count", F.lit(0)) < least_chars, F.col("suspicions") > 0
    present = F.coalesce("redacted_present", F.lit(True)) if "redacted_present" in rows.columns else F.lit(True)
    left = (F.col("hits") > 0) & ((F.coalesce("hits_remaining", F.lit(0)) > 0) | ~present)
    decision = F.when(poor | empty, REJECTED).when(suspect | left, REVIEW).otherwise(CONFIRMED)
    return rows.withColumn("decision", decision).withColumn("reasons", codes((poor, "EXTRACTION_QUALITY_LOW"), (~poor & empty, "EXTRACTION_EMPTY"), (~poor & ~empty & suspect, "PAN_SUSPECT_OCR_LOW_CONF"), (~poor & ~empty & ~suspect & left, "PAN_REMAINS_AFTER_REDACTION")))
