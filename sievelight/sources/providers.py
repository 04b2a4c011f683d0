"""Byte-level work (PDF text, page images, OCR, object detection) behind providers.

A provider turns one file's bytes into rows. Files come from Spark's binaryFile source, so any store works; each partition builds
its provider once. Nothing here imports a PDF, OCR or vision library: those belong to the provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import ATTEMPTS, SPANS


class Provider(Protocol):
    def rows(self, path: str, content: bytes) -> Iterator[dict]: ...


class PlainText:
    """Text files as one span a line; the provider that needs no library."""

    def rows(self, path: str, content: bytes) -> Iterator[dict]:
        for k, line in enumerate(content.decode("utf-8", "replace").splitlines()):
            if line.strip():
                yield {"span_id": k, "text": line.strip(), "bbox": None, "page": 0, "source": "text", "ocr_conf": None, "span_kind": "line"}


#: Modes of OCR, and the engines each tries in order.
MODES = {"auto": ("apple", "paddle", "tesseract"), "combo": ("apple", "paddle", "tesseract"), "apple": ("apple",), "paddle": ("paddle",), "easy": ("easy",), "tesseract": ("tesseract",)}


def ocr_mode(given: str | None, environment: str | None = None) -> str:
    """The given mode, else the environment's, else auto; an unknown one is auto."""
    mode = (given or environment or "auto").lower()
    return mode if mode in MODES else "auto"


def engines(mode: str, available: set[str]) -> list[str]:
    """Engines of a mode that are available, or else the last resort."""
    return [e for e in MODES[mode] if e in available] or ["tesseract"]


def scan(spark: SparkSession, path: str, provider: Callable[[], Provider], schema: str = SPANS, glob: str = "*") -> DataFrame:
    """Rows of all files of a folder; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = provider()
        for batch in batches:
            for d, p, c in zip(*(batch[k].to_pylist() for k in ("doc_id", "path", "content"))):
                if rows := [{"doc_id": d, **r} for r in reader.rows(p, c)]:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, kind)


class Guarded:
    """A provider whose errors become rows: an engine that fails on a file is an attempt without success."""

    def __init__(self, inner: Callable[[], Provider]):
        try:
            self.inner, self.error = inner(), None
        except Exception as e:  # the engine itself is not to be had
            self.inner, self.error = None, str(e)

    def rows(self, path: str, content: bytes) -> Iterator[dict]:
        began = time.perf_counter()
        try:
            if self.inner is None:
                raise RuntimeError(self.error)
            made = [{"success": True, "error": None, **r} for r in self.inner.rows(path, content)]
        except Exception as e:
            made = [{"page": 0, "roi": None, "text": "", "avg_conf": 0.0, "success": False, "error": str(e)}]
        took = round((time.perf_counter() - began) * 1000, 2)
        yield from ({"elapsed_ms": took, **r} for r in made)


def ocr_attempts(spark: SparkSession, path: str, backends: dict[str, Callable[[], Provider]], mode: str = "auto") -> DataFrame:
    """Attempts of all engines of the mode, in order, as rows of ATTEMPTS; a failure is a row with its error, and a file that no engine
    read gets an empty result of engine "none"."""
    out = None
    for k, name in enumerate(e for e in engines(mode, set(backends)) if e in backends):
        rows = scan(spark, path, partial(Guarded, backends[name]), ATTEMPTS).withColumn("engine", F.lit(name)).withColumn("backend_order", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], ATTEMPTS)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id")).distinct()
    none = files.join(out.where("success"), "doc_id", "left_anti")
    empty = {"page": F.lit(0), "roi": F.lit(None).cast("string"), "backend_order": F.lit(len(backends)), "engine": F.lit("none"), "text": F.lit(""), "avg_conf": F.lit(0.0), "success": F.lit(True), "error": F.lit(None).cast("string"), "elapsed_ms": F.lit(0.0)}
    return out.unionByName(none.withColumns(empty))
