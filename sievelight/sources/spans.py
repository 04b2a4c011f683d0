"""Spans from text tables. Boxes are synthetic where a table has none: x counts characters, y counts lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def line_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One span for each line that isn't blank. span_id is the line's number, page is 0; ``keep`` names columns to carry along."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.posexplode(T.pieces(F.col(text_col))).alias("no", "line"))
    rows = rows.where(T.some(F.col("line"))).withColumn("text", T.strip(F.col("line")))
    y = F.col("no").cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.length("text").cast("double").alias("x1"), (y + 1).alias("y1"))
    return rows.select("doc_id", F.col("no").cast("long").alias("span_id"), "text", box.alias("bbox"), F.lit(0).alias("page"), F.lit(source).alias("source"), F.lit(None).cast("double").alias("ocr_conf"), F.lit("line").alias("span_kind"), *keep)


def word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "text") -> DataFrame:
    """One span for each word of each line; span_id has the line in its upper 32 bits and the place below."""
    lines = line_spans(docs, id_col, text_col, source)
    words = lines.select("doc_id", "page", "source", "ocr_conf", F.col("bbox.y0").alias("y"), F.posexplode(F.split("text", r"\s+")).alias("k", "text"))
    x = F.col("k").cast("double")
    box = F.struct((x * 10).alias("x0"), F.col("y").alias("y0"), (x * 10 + F.length("text")).alias("x1"), (F.col("y") + 1).alias("y1"))
    return words.select("doc_id", F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("k").cast("long")).alias("span_id"), "text", box.alias("bbox"), "page", "source", "ocr_conf", F.lit("word").alias("span_kind"))


def page_spans(doc_text: DataFrame) -> DataFrame:
    """Line spans of extracted texts (doc_id, pages array, source, quality_score): no geometry, and OCR lines carry the quality as
    their confidence, others 1."""
    rows = doc_text.select("doc_id", "source", "quality_score", F.posexplode("pages").alias("page", "p")).where("p is not null")
    rows = rows.select("doc_id", "source", "quality_score", "page", F.posexplode(T.pieces(F.col("p"))).alias("no", "line")).where(T.some(F.col("line"))).withColumn("text", T.strip(F.col("line")))
    conf = F.when(F.col("source") == "ocr", F.col("quality_score")).otherwise(F.lit(1.0))
    return rows.select("doc_id", F.shiftleft(F.col("page").cast("long"), 32).bitwiseOR(F.col("no").cast("long")).alias("span_id"), "text", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"), "page", "source", conf.alias("ocr_conf"), F.lit("line").alias("span_kind"))


def html_text(html_col: str = "html"):
    """Text of raw HTML: scripts, styles, comments and tags become spaces, the commonest entities characters."""
    t = F.regexp_replace(F.col(html_col), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def needs_ocr(spans: DataFrame, docs: DataFrame, least: int = 20) -> DataFrame:
    """Documents whose text layer has fewer than ``least`` characters, those without any span included."""
    total = spans.groupBy("doc_id").agg(F.sum(F.length(T.strip(F.col("text")))).alias("chars"))
    return docs.select("doc_id").join(total, "doc_id", "left").where(F.coalesce("chars", F.lit(0)) < least).select("doc_id")


def with_ocr(text_spans: DataFrame, ocr_spans: DataFrame, docs: DataFrame, least: int = 20) -> DataFrame:
    """The text layer, and for documents where it is too thin the OCR spans as well."""
    return text_spans.unionByName(ocr_spans.join(needs_ocr(text_spans, docs, least), "doc_id", "left_semi"))


def normalised_ocr(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """OCR words (doc_id, span_id, text, page, x, y, w, h, conf in per cent) to spans in page units."""
    rows = words.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    box = F.struct((F.col("x") * scale).alias("x0"), (F.col("y") * scale).alias("y0"), ((F.col("x") + F.col("w")) * scale).alias("x1"), ((F.col("y") + F.col("h")) * scale).alias("y1"))
    return rows.select("doc_id", "span_id", "text", box.alias("bbox"), "page", F.lit("ocr").alias("source"), (F.col("conf") / 100).alias("ocr_conf"), F.lit("word").alias("span_kind"))


def chosen_text(text: DataFrame, ocr: DataFrame, mode: str = "auto", threshold: float = 0.5) -> DataFrame:
    """Extracted texts (doc_id, pages, source, quality_score) by mode: text, ocr, or auto, which takes OCR where the text layer is below
    the threshold. ``reason`` is null where the quality suffices."""
    if mode not in ("text", "ocr", "auto"):
        mode = "auto"
    names = ["pages", "source", "quality_score"]
    a = text.select("doc_id", F.struct(*names).alias("a")) if mode != "ocr" else None
    b = ocr.select("doc_id", F.struct(*names).alias("b")) if mode != "text" else None
    rows = a.join(b, "doc_id", "full") if mode == "auto" else a.withColumn("b", F.lit(None).cast(a.schema["a"].dataType)) if b is None else b.withColumn("a", F.lit(None).cast(b.schema["b"].dataType))
    good = F.coalesce(F.col("a.quality_score") >= threshold, F.lit(False))
    picked = rows.withColumn("p", F.when(good | F.col("b").isNull(), F.col("a")).otherwise(F.col("b")))
    fine = F.coalesce(F.col("p.quality_score") >= threshold, F.lit(False))
    return picked.select("doc_id", "p.pages", "p.source", "p.quality_score", F.when(~fine, "quality_too_low" if mode == "text" else "ocr_quality_too_low").alias("reason"))
