"""Order-dependent operators: grouping into lines, stitching of number fragments, word sequences.

A page's spans are folded inside the JVM over a sorted array. Folds need the spans of one page together: the shuffle key is
(doc_id, page), of bounded size, never a document or a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pan
from .detectors import PanConfig

SPAN = "span_id long, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def _page_arrays(spans: DataFrame, first: list[str]) -> DataFrame:
    b = F.col("bbox")
    span = F.struct(*[F.expr(e) for e in first], F.col("span_id"), F.col("text"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.col("ocr_conf").alias("conf"))
    return spans.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def running_lines(spans: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """(doc_id, page, span_id, line_no): spans in order of (vertical centre, left edge) join the line while they are within the
    tolerance of its running mean centre. A mean of exactly 0 counts as none, so the next span always joins."""
    pages = _page_arrays(spans, ["(bbox.y0 + bbox.y1) / 2.0 AS yc", "bbox.x0 AS left"])
    start = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        near = F.abs(s["yc"] - F.when(a["mean"] == 0, s["yc"]).otherwise(a["mean"])) <= tolerance
        joins = (a["n"] > 0) & near
        line = F.when(joins, a["line"]).otherwise(a["line"] + 1)
        n = F.when(joins, a["n"] + 1).otherwise(F.lit(1))
        mean = F.when(joins, (a["mean"] * a["n"] + s["yc"]) / (a["n"] + 1)).otherwise(s["yc"])
        return F.struct(line.alias("line"), n.alias("n"), mean.alias("mean"), F.array_append(a["out"], line).alias("out"))

    return _numbered(pages, start, step)


def anchored_lines(spans: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, span_id, line_no): spans in order of (top, left edge) join the line while their top is within the tolerance
    of the line's first."""
    pages = _page_arrays(spans, ["bbox.y0 AS top", "bbox.x0 AS left"])
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        joins = (a["line"] >= 0) & (F.abs(s["top"] - a["top"]) <= tolerance)
        line = F.when(joins, a["line"]).otherwise(a["line"] + 1)
        return F.struct(line.alias("line"), F.when(joins, a["top"]).otherwise(s["top"]).alias("top"), F.array_append(a["out"], line).alias("out"))

    return _numbered(pages, start, step)


def _numbered(pages: DataFrame, start: Column, step) -> DataFrame:
    out = pages.withColumn("lines", F.aggregate("spans", start, step)["out"])
    return out.select("doc_id", "page", F.explode(F.arrays_zip("spans", "lines")).alias("z")).select("doc_id", "page", F.col("z.spans.span_id").alias("span_id"), F.col("z.lines").alias("line_no"))


def line_spans(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Line spans of word spans: text joined by spaces in (top, left) order, and the union of the boxes."""
    b = F.col("bbox")
    of = words.join(anchored_lines(words, tolerance), ["doc_id", "page", "span_id"])
    lines = of.groupBy("doc_id", "page", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(b["y0"].alias("top"), b["x0"].alias("left"), "span_id", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1")).alias("bbox"),
    )
    return lines


def stitch_windows(spans: DataFrame, config: PanConfig = PanConfig()) -> DataFrame:
    """All windows of neighbouring OCR spans of a line that read as a card number: doc_id, page, line_no, start, size, text, digits,
    avg_conf, min_conf, passed, b6, severity (null: rejected), bbox, span_ids."""
    ocr = spans.where(F.lower("source") == "ocr")
    b = F.col("bbox")
    span = F.struct(b["x0"].alias("x0"), "yc", "span_id", "text", b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.coalesce("ocr_conf", F.lit(0.0)).alias("conf"))
    lines = ocr.join(running_lines(ocr, config.line_height), ["doc_id", "page", "span_id"]).withColumn("yc", (b["y0"] + b["y1"]) / 2.0)
    lines = lines.groupBy("doc_id", "page", "line_no").agg(F.array_sort(F.collect_list(span)).alias("s"))
    low = max(2, config.words[0])
    high = max(low, config.words[1])
    windows = lines.where(F.size("s") >= low).select("*", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.size("s")))).alias("size"))
    windows = windows.select("doc_id", "page", "line_no", "size", "s", F.explode(F.sequence(F.lit(0), F.size("s") - F.col("size"))).alias("start"))
    windows = windows.select("doc_id", "page", "line_no", "start", "size", F.slice("s", F.col("start") + 1, F.col("size")).alias("w"))
    w = F.col("w")
    gap = lambda a, z: z["x0"] - a["x1"]

    def fits(a: Column, z: Column) -> Column:
        height = (F.greatest(a["y1"] - a["y0"], F.lit(0.0)) + F.greatest(z["y1"] - z["y0"], F.lit(0.0))) / 2
        height = F.when(height == 0, F.lit(1.0)).otherwise(height)
        return ~((gap(a, z) > 0) & (gap(a, z) > config.gap[0]) & (gap(a, z) > config.gap[1] * height))

    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), fits)
    windows = windows.where(F.forall(w, lambda s: pan.digitish(s["text"], config.digit_share, config.repair_signs)) & F.forall(pairs, lambda ok: ok))
    joined = F.array_join(F.transform(w, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    windows = windows.withColumn("text", joined).withColumn("d1", pan.stitched_digits(F.col("text"), False, config.repair_signs)).where(F.length("d1").between(13, 19))
    d6 = pan.stitched_digits(F.col("text"), True, config.repair_signs)
    b6 = ~pan.luhn(F.col("d1")) & F.lit(config.b_as_6) & F.lower("text").contains("b") & F.length(d6).between(13, 19) & pan.luhn(d6)
    total = F.aggregate(w, F.lit(0.0), lambda a, s: a + s["conf"])
    windows = windows.withColumn("b6", b6).withColumn("avg_conf", total / F.size(w)).withColumn("min_conf", F.array_min(F.transform(w, lambda s: s["conf"])))
    windows = windows.withColumn("digits", F.when(F.col("b6"), d6).otherwise(F.col("d1"))).withColumn("passed", F.col("b6") | pan.luhn(F.col("d1")))
    weak = (F.col("avg_conf") < config.threshold) | (F.col("min_conf") < config.weak_word)
    windows = windows.withColumn("severity", F.when(F.col("passed"), "hit").when(weak, "suspicion"))
    edge = lambda f, n: f(F.transform(w, lambda s: s[n]))
    box = F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"))
    return windows.select("doc_id", "page", "line_no", "start", "size", "text", "digits", "avg_conf", "min_conf", "passed", "b6", "severity", box.alias("bbox"), F.transform(w, lambda s: s["span_id"]).alias("span_ids"))


def stitch_best(windows: DataFrame) -> DataFrame:
    """The best window of each (doc_id, page, digits): hit before suspicion, then confidence, size, and the left edge."""
    order = Window.partitionBy("doc_id", "page", "digits").orderBy((F.col("severity") == "hit").desc(), F.col("avg_conf").desc(), F.col("size").desc(), F.col("bbox.x0"), "line_no", "size", "start")
    return windows.where("severity is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def stitch_detections(spans: DataFrame, config: PanConfig = PanConfig()) -> DataFrame:
    """Detections of stitched card numbers."""
    best = stitch_best(stitch_windows(spans, config))
    v = F.filter(F.array(F.lit("regex"), F.lit("stitch"), F.when(F.col("passed"), "luhn"), F.when(F.col("b6"), "confusable:b->6"), F.when(~F.col("passed"), "near_pan")), lambda x: x.isNotNull())
    return best.select("doc_id", "page", F.lit("card_pan").alias("field_id"), pan.mask(F.col("digits")).alias("text"), F.sha2("digits", 256).alias("raw"), "bbox", F.lit("ocr").alias("source"), "severity", v.alias("validators"), "avg_conf", F.col("size").alias("window_size"), "span_ids")


def stitch_trace(windows: DataFrame) -> DataFrame:
    """Counters of each document: windows, hits, suspicions and the digits of the window read best."""
    best = F.max_by("digits", F.struct("avg_conf", -F.col("page"), -F.col("line_no"), -F.col("size"), -F.col("start")))
    return windows.groupBy("doc_id").agg(F.count("*").alias("windows_evaluated"), F.count_if(F.col("severity") == "hit").alias("hits"), F.count_if(F.col("severity") == "suspicion").alias("suspicions"), best.alias("best_digits"))


def word_sequences(words: DataFrame, targets: DataFrame) -> DataFrame:
    """Places where the words of a target stand in sequence: targets (doc_id, target_id, text) to (doc_id, target_id, page,
    first_word, bbox). Word n-grams of the lengths that the targets have meet them in an equi-join on document and text."""
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    wanted = targets.select("doc_id", "target_id", F.array_join(tokens, " ").alias("gram"), F.size(tokens).alias("n")).where("n > 0")
    lengths = wanted.select("doc_id", "n").distinct().groupBy("doc_id").agg(F.collect_list("n").alias("lengths"))
    b = F.col("bbox")
    page = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("span_id", "text", b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")))).alias("w"))
    grams = page.join(lengths, "doc_id").select("doc_id", "page", "w", F.explode("lengths").alias("n")).where(F.size("w") >= F.col("n"))
    grams = grams.select("doc_id", "page", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("first_word")).select("doc_id", "page", "n", "first_word", F.slice("w", F.col("first_word") + 1, F.col("n")).alias("g"))
    g = F.col("g")
    edge = lambda f, k: f(F.transform(g, lambda s: s[k]))
    grams = grams.select("doc_id", "page", "n", "first_word", F.array_join(F.transform(g, lambda s: s["text"]), " ").alias("gram"), F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1")).alias("bbox"))
    return grams.join(wanted, ["doc_id", "gram", "n"]).select("doc_id", "target_id", "page", "first_word", "bbox")
