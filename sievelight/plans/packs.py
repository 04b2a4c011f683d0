"""Packs: whole plans from spans to decisions and reports, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors, geometry, redact
from ..operators.detectors import PanConfig
from ..sources import sinks
from . import policy

PCI_CONFIG = PanConfig(b_as_6=True)


def char_counts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    total = spans.groupBy("doc_id").agg(F.sum(F.length(T.strip(F.col("text")))).alias("char_count"), F.count("*").alias("span_count"), F.count_if(F.col("source") == "ocr").alias("ocr_span_count"))
    return docs.select("doc_id").join(total, "doc_id", "left").fillna(0, ["char_count", "span_count", "ocr_span_count"])


def pan_detections(spans: DataFrame, config: PanConfig = PCI_CONFIG, raw: bool = False) -> DataFrame:
    """Card numbers in single spans and, from OCR words, stitched ones."""
    single = detectors.card_pan(spans, config, raw)
    return single.unionByName(geometry.stitch_detections(spans, config).drop("avg_conf", "window_size"), allowMissingColumns=True)


def _count(entries: Column, severity: str) -> Column:
    return F.coalesce(F.size(F.filter(entries, lambda m: m["severity"] == severity)), F.lit(0))


SHOWN = "array<struct<field_id:string,text:string,raw:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,page:int,source:string,validators:array<string>,severity:string>>"


def pan_rows(docs: DataFrame, spans: DataFrame, config: PanConfig = PCI_CONFIG) -> DataFrame:
    """One row per document for ``policy.decide_pci``: counts of characters, spans, hits, suspicions, of what is found again once the
    hits are blanked out, and the detections. A span is searched, blanked and searched again in one projection; only OCR words, whose
    numbers may be spread over several, are stitched, and again without those that were blanked."""
    hit = lambda m: m["severity"] == "hit"
    once = spans.withColumn("_f", detectors.pan_found(F.col("text"), config))
    hits = F.filter("_f", hit)
    clean = redact.blank_out(F.col("text"), F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))))
    once = once.withColumn("_t", F.when(F.size(hits) > 0, clean)).withColumn("_l", F.when(F.col("_t").isNotNull(), detectors.pan_found(F.col("_t"), config)).otherwise(F.filter("_f", lambda m: ~hit(m))))
    shown = F.transform("_f", lambda m: F.struct(F.lit("card_pan").alias("field_id"), m["text"].alias("text"), F.sha2(m["raw"], 256).alias("raw"), F.col("bbox"), F.col("page"), F.col("source"), m["validators"].alias("validators"), m["severity"].alias("severity")))
    per = once.groupBy("doc_id").agg(
        F.sum(F.length(T.strip(F.col("text")))).alias("char_count"), F.count("*").alias("span_count"), F.count_if(F.lower("source") == "ocr").alias("ocr_span_count"),
        F.sum(_count(F.col("_f"), "hit")).alias("h"), F.sum(_count(F.col("_f"), "suspicion")).alias("s"), F.sum(_count(F.col("_l"), "hit")).alias("lh"), F.sum(_count(F.col("_l"), "suspicion")).alias("ls"),
        F.flatten(F.collect_list(F.when(F.size("_f") > 0, shown))).alias("d"),
    )
    words = spans.where(F.lower("source") == "ocr")
    found = geometry.stitch_detections(words, config)
    left = geometry.stitch_best(geometry.stitch_windows(redact.redact_text(words, found.where("severity = 'hit'")), config))
    counts = lambda h, s: (F.count_if(F.col("severity") == "hit").alias(h), F.count_if(F.col("severity") == "suspicion").alias(s))
    one = F.struct("field_id", "text", "raw", "bbox", "page", "source", "validators", "severity")
    stitched = found.groupBy("doc_id").agg(*counts("h2", "s2"), F.collect_list(one).alias("d2")).join(left.groupBy("doc_id").agg(*counts("lh2", "ls2")), "doc_id", "left")
    rows = docs.select("doc_id").join(per, "doc_id", "left").join(stitched, "doc_id", "left")
    rows = rows.fillna(0, ["char_count", "span_count", "ocr_span_count", "h", "s", "lh", "ls", "h2", "s2", "lh2", "ls2"])
    none = F.array().cast(SHOWN)
    out = rows.select("doc_id", "char_count", "span_count", "ocr_span_count", (F.col("h") + F.col("h2")).alias("hits"), (F.col("s") + F.col("s2")).alias("suspicions"), (F.col("lh") + F.col("lh2")).alias("hits_remaining"), (F.col("ls") + F.col("ls2")).alias("suspicions_remaining"), F.array_sort(F.concat(F.coalesce(F.col("d").cast(SHOWN), none), F.coalesce(F.col("d2").cast(SHOWN), none))).alias("detections"))
    return out.withColumn("remaining", F.col("hits_remaining") + F.col("suspicions_remaining"))


def _pci_trace(rows: DataFrame) -> DataFrame:
    searched = (F.col("hits") > 0) & (F.col("suspicions") == 0) & (F.col("char_count") >= policy.LEAST_CHARS)
    of = lambda c: F.when(searched, F.col(c)).otherwise(F.lit(0)).alias(c)
    extraction = F.struct("span_count", (F.col("span_count") - F.col("ocr_span_count")).alias("text_span_count"), "ocr_span_count", (F.col("ocr_span_count") > 0).alias("used_ocr"))
    return rows.withColumn("trace", F.struct(extraction.alias("extraction"), F.struct("hits", "suspicions").alias("card_pan"), F.struct(of("hits_remaining"), of("suspicions_remaining")).alias("post_redaction")))


def pci_lite(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Decide text documents on their card numbers; what redaction leaves is searched again, stitched numbers too."""
    return report("global.pci_lite.v1", _pci_trace(policy.decide_pci(pan_rows(docs, spans))))


def pci_legacy(docs: DataFrame, spans: DataFrame, quality: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The older card pack: quality first (doc_id, quality_score); numbers by the older rule in single spans."""
    found = detectors.card_pan_strict(spans)
    left = redact.remaining(redact.redact_text(spans, found.where("severity = 'hit'")), "card_pan_strict").select("doc_id", "hits_remaining")
    rows = policy.flags(char_counts(docs, spans), found).join(left, "doc_id", "left").join(quality, "doc_id", "left")
    return report("pci.lite.legacy", policy.decide_pci_legacy(rows, threshold), found)


def uk_bank_statement(docs: DataFrame, spans: DataFrame, quality: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Decide bank statements on the profile's fields; ``quality`` has (doc_id, quality_score)."""
    found = detectors.strict(detectors.profile(spans, "uk.bank_statement.v1"))
    rows = policy.flags(char_counts(docs, spans), found).join(quality, "doc_id", "left")
    return report("uk.bank_statement.v1", policy.decide_uk(rows, threshold), found)


def card_photo(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Decide card photos; ``docs`` has candidate, blur, occlusion, remaining hits and force flag of each. Boxes that only looks tell of
    are suggested for redaction."""
    return report("global.card_photo.v1", policy.decide_card(policy.flags(docs, found)), found)


def id_photo(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Decide ID photos."""
    return report("global.id_photo.v1", policy.decide_id(policy.flags(docs, found)), found)


def report(pack_id: str, decided: DataFrame, found: DataFrame | None = None, version: str = "1") -> DataFrame:
    """One row per document: pack_id, decision, reasons, detections (masked), artifacts, engine_version, suggested_redactions (page,
    bbox, label), action, trace. Detections come from ``found`` or are a column already."""
    if found is not None:
        one = F.struct("field_id", "text", "raw", "bbox", "page", "source", "validators", "severity")
        decided = decided.join(found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("detections")), "doc_id", "left")
    has = lambda c, kind: F.col(c) if c in decided.columns else F.lit(None).cast(kind)
    looks = F.transform(F.filter("detections", lambda d: d["source"] == "visual"), lambda d: F.struct(d["page"].alias("page"), d["bbox"].alias("bbox"), F.lit("PAN VISUAL").alias("label")))
    suggested = F.when(F.coalesce(has("suggestions", "boolean"), F.lit(False)) & (F.col("decision") == policy.REVIEW), looks)
    names = sinks.artifact_names(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return decided.select("doc_id", F.lit(pack_id).alias("pack_id"), "decision", policy.described(F.col("reasons")).alias("reasons"), "detections", names.alias("artifacts"), F.lit(version).alias("engine_version"), suggested.alias("suggested_redactions"), has("action", "string").alias("action"), has("trace", "string").alias("trace"))


def report_json(reports: DataFrame) -> DataFrame:
    """(doc_id, pack_id, decision, report): the report as JSON."""
    body = F.struct(*[c for c in reports.columns if c != "doc_id"])
    return reports.select("doc_id", "pack_id", "decision", F.to_json(body).alias("report"))


PACKS: dict[str, Callable[..., DataFrame]] = {"global.pci_lite.v1": pci_lite, "pci.lite.legacy": pci_legacy, "uk.bank_statement.v1": uk_bank_statement, "global.card_photo.v1": card_photo, "global.id_photo.v1": id_photo}


def list_packs() -> list[str]:
    return sorted(PACKS)


def run_pack(pack_id: str, *args: DataFrame, **options) -> DataFrame:
    if pack_id not in PACKS:
        raise ValueError(f"unknown pack {pack_id!r}; there are {', '.join(list_packs())}")
    return PACKS[pack_id](*args, **options)
