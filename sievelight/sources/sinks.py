"""Sinks: reports, span payloads and text artifacts as columns or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ARTIFACTS


def artifact_names(stem: Column) -> Column:
    return F.create_map(*[x for k, suffix in ARTIFACTS.items() for x in (F.lit(k), F.concat(stem, F.lit(suffix)))])


def ocr_text(spans: DataFrame) -> DataFrame:
    """(doc_id, text): the document's spans, a line each, in order."""
    order = F.array_sort(F.collect_list(F.struct("page", "span_id", "text")))
    return spans.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda s: s["text"]), "\n").alias("text"))


def spans_json(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): the document's spans as a JSON array."""
    order = F.array_sort(F.collect_list(F.struct("page", "span_id", "text", "bbox", "source", "ocr_conf")))
    return spans.groupBy("doc_id").agg(F.to_json(order).alias("spans"))


def write_reports(reports: DataFrame, path: str, form: str = "json") -> None:
    """Report rows, in folders by pack and decision."""
    reports.write.mode("overwrite").partitionBy("pack_id", "decision").format(form).save(path)
