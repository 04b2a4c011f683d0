"""Decisions, packs, redaction, vision relations, sources and streams."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sievelight.operators import detectors as D
from sievelight.operators import redact as R
from sievelight.operators import vision as V
from sievelight.operators.detectors import card_pan
from sievelight.plans import packs, policy
from sievelight.plans import photo as photos
from sievelight.schema import BOXES, CONTOURS, OCR_RESULTS, SPANS
from sievelight.sources import providers, sinks
from sievelight.sources import spans as S
from sievelight.streaming import detect as ST

BOX = (10.0, 20.0, 200.0, 40.0)
FOUND = "doc_id long, field_id string, text string, raw string, bbox struct<x0:double,y0:double,x1:double,y1:double>, page int, source string, validators array<string>, severity string"


def photo(spark, found, blur=80.0, hidden=False, candidate=True, remains=0, force=False):
    docs = spark.createDataFrame([(1, candidate, blur, hidden, remains, force)], "doc_id long, card_candidate_present boolean, blur_score double, occlusion_suspected boolean, hits_remaining int, force_band_redact boolean")
    return docs, spark.createDataFrame([(1, f, "x", "x", BOX, 0, s, [], v) for f, v, s in found], FOUND)


def decided(df):
    r = df.first()
    return r["decision"], [x["code"] for x in r["reasons"]], r["action"]


@pytest.mark.parametrize(
    ("found", "options", "expected"),
    [
        ([("card_pan", "hit", "roi_ocr"), ("card_expiry", "hit", "roi_ocr")], {}, ("CONFIRMED", ["PAN_CONFIRMED"], None)),
        ([("card_pan", "suspicion", "roi_ocr")], {}, ("REVIEW", ["PAN_SUSPECT"], None)),
        ([("card_pan", "hit", "roi_ocr")], {"remains": 1}, ("REVIEW", ["PAN_REMAINS"], None)),
        ([("card_pan", "suspicion", "visual")], {}, ("REVIEW", ["PAN_SUSPECT_VISUAL"], None)),
        ([("card_pan", "suspicion", "visual")], {"force": True}, ("REVIEW", ["PAN_SUSPECT_VISUAL"], "FORCED_REDACT_REVIEW")),
        ([("card_expiry", "hit", "roi_ocr")], {"blur": 5.0, "hidden": True}, ("REVIEW", ["EXPIRY_ONLY", "OCCLUSION", "QUALITY_LOW"], None)),
        ([], {}, ("REVIEW", ["QUALITY_LOW"], None)),
    ],
)
def test_card_decisions(spark, found, options, expected):
    assert decided(packs.run_pack("global.card_photo.v1", *photo(spark, found, **options))) == expected


@pytest.mark.parametrize(
    ("found", "options", "expected"),
    [
        ([("mrz", "hit", "roi_ocr"), ("id_number", "suspicion", "roi_ocr")], {}, ("CONFIRMED", ["MRZ_CONFIRMED"], None)),
        ([("id_number", "suspicion", "roi_ocr")], {"blur": 5.0, "hidden": True}, ("REVIEW", ["ID_SUSPECT", "QUALITY_LOW", "OCCLUSION"], None)),
        ([("mrz", "hit", "roi_ocr")], {"remains": 2}, ("REVIEW", ["MRZ_REMAINS"], None)),
        ([], {}, ("REJECTED", ["QUALITY_LOW"], None)),
    ],
)
def test_id_decisions(spark, found, options, expected):
    assert decided(packs.run_pack("global.id_photo.v1", *photo(spark, found, **options))) == expected


def text_spans(spark, *rows):
    return spark.createDataFrame([(d, k, t, BOX, 0, s, c, "line") for k, (d, t, s, c) in enumerate(rows)], SPANS)


def test_pci_pack(spark):
    spans = text_spans(spark, (1, "Please charge 4242 4242 4242 4242 for this order", "text", None), (2, "4242 4242 4242 4243 and thirty more letters", "ocr", 0.5), (3, "too short", "text", None), (5, "nothing of interest here, but long enough", "text", None))
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    got = {r["doc_id"]: (r["decision"], [x["code"] for x in r["reasons"]]) for r in packs.run_pack("global.pci_lite.v1", docs, spans).collect()}
    assert got == {1: ("CONFIRMED", []), 2: ("REVIEW", ["PAN_SUSPECT_OCR_LOW_CONF"]), 3: ("REJECTED", ["EXTRACTION_EMPTY"]), 4: ("REJECTED", ["EXTRACTION_EMPTY"]), 5: ("CONFIRMED", [])}
    assert '"decision":"CONFIRMED"' in packs.report_json(packs.pci_lite(docs, spans)).where("doc_id = 1").first()["report"]


def test_pci_remaining_and_older_rules(spark):
    rows = spark.createDataFrame([(1, 50, 1, 0, 1, 1, 0.9), (2, 50, 1, 0, 0, 0, 0.1), (3, 50, 1, 0, 1, 0, 0.9)], "doc_id long, char_count int, hits int, suspicions int, remaining int, hits_remaining int, quality_score double")
    assert [r["reasons"] for r in policy.decide_pci(rows).orderBy("doc_id").collect()] == [["PAN_REMAINS_AFTER_REDACTION"], [], ["PAN_REMAINS_AFTER_REDACTION"]]
    assert [r["decision"] for r in policy.decide_pci_legacy(rows).orderBy("doc_id").collect()] == ["REVIEW", "REJECTED", "CONFIRMED"]


def test_uk_pack(spark):
    spans = text_spans(spark, (1, "Sort code 20-18-11 account number 83337973", "text", 1.0), (2, "a perfectly ordinary line of some length", "text", 1.0), (3, "Sort code 20-18-11 account number 83337973", "text", 1.0))
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    quality = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.2)], "doc_id long, quality_score double")
    got = {r["doc_id"]: (r["decision"], [x["code"] for x in r["reasons"]]) for r in packs.run_pack("uk.bank_statement.v1", docs, spans, quality).collect()}
    assert got == {1: ("CONFIRMED", []), 2: ("REVIEW", ["NO_PII_FOUND"]), 3: ("REJECTED", ["EXTRACTION_QUALITY_LOW"])}


def test_packs_registry():
    assert packs.list_packs() == sorted(packs.PACKS)
    with pytest.raises(ValueError):
        packs.run_pack("none")


def test_redaction_leaves_nothing(spark):
    spans = text_spans(spark, (1, "A 4242 4242 4242 4242 b 4111111111111111 c", "text", None), (1, "é 5555555555554444", "text", None))
    out = R.redact_text(spans, card_pan(spans))
    texts = [r["text"] for r in out.orderBy("span_id").collect()]
    assert texts == [f"A {'█' * 19} b {'█' * 16} c", f"é {'█' * 16}"]
    assert R.remaining(out).count() == 0


def test_visual_card(spark):
    good = [(1, 0, 65 + 25 * i, 60, 12, 13, 150.0, 420, 225, 94500.0) for i in range(14)]
    ragged = [(2, 0, 65 + 25 * i, 60 + 9 * (i % 2), 12, 13, 150.0, 420, 225, 94500.0) for i in range(14)]
    few = [(3, 0, 65 + 25 * i, 60, 12, 13, 150.0, 420, 225, 94500.0) for i in range(9)]
    rows = V.visual_card(spark.createDataFrame(good + ragged + few, CONTOURS)).collect()
    assert [(r["doc_id"], r["digit_like_count"], r["x0"], r["x1"]) for r in rows] == [(1, 14, 65, 65 + 25 * 13 + 12)]


def test_boxes_and_ocr_choice(spark):
    boxes = spark.createDataFrame([(1, 0, "card", 0.5, 1.0, 1.0, 9.0, 9.0), (1, 0, "id_card", 0.9, 2.0, 2.0, 8.0, 8.0), (1, 0, "pan", 0.9, 3.0, 3.0, 4.0, 4.0)], BOXES)
    assert V.best_box(boxes, V.CARD_LABELS).first()["x1"] == 2.0
    pages = spark.createDataFrame([(1, 0, 1000, 500), (2, 0, 1000, 500)], "doc_id long, page int, width int, height int")
    got = {r["doc_id"]: tuple(r["roi"]) for r in V.rois(pages, boxes, "pan", ("pan",)).collect()}
    assert got == {1: (3.0, 3.0, 4.0, 4.0), 2: (80.0, 175.0, 920.0, 325.0)}
    results = spark.createDataFrame([(1, 0, "pan", 0, "a", "12", 0.9, True), (1, 0, "pan", 1, "b", "1234", 0.1, True), (1, 0, "pan", 2, "c", "1234", 0.1, True), (1, 0, "pan", 3, "d", "12345", 0.9, False)], OCR_RESULTS)
    assert V.best_ocr(results, True).first()["engine"] == "b" and V.best_ocr(results, False).first()["engine"] == "a"
    assert V.engines_used(results).first()["engines"] == ["a", "b", "c"]


def test_equal_boxes_of_two_labels(spark):
    rows = [(1, 0, label, 0.5, 1.0, 1.0, 9.0, 9.0) for label in ("id_card", "card")]
    for order in (rows, rows[::-1]):
        assert V.best_box(spark.createDataFrame(order, BOXES).coalesce(1), V.CARD_LABELS).first()["label"] == "card"


def test_homography_round_trip(spark):
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(60.0).alias("y1"))
    m, inverse = F.array(*map(F.lit, (2.0, 0.0, 1.0, 0.0, 4.0, -2.0, 0.0, 0.0, 1.0))), F.array(*map(F.lit, (0.5, 0.0, -0.5, 0.0, 0.25, 0.5, 0.0, 0.0, 1.0)))
    df = spark.range(1).select(V.map_box(box, m, F.lit(5.0), F.lit(6.0)).alias("b")).select(V.map_box(F.col("b"), inverse, F.lit(5.0), F.lit(6.0), True).alias("b"))
    assert tuple(df.first()["b"]) == (10.0, 20.0, 30.0, 60.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two 4242424242424242\n")
    rows = providers.scan(spark, str(tmp_path), providers.PlainText).orderBy("span_id").collect()
    assert [(r["span_id"], r["text"]) for r in rows] == [(0, "one"), (2, "two 4242424242424242")]
    docs = spark.createDataFrame([(1, "a  b\n\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in S.word_spans(docs).orderBy("span_id").collect()] == [(1, "a"), (1, "b"), (1, "c")]
    assert sorted(r[0] for r in S.needs_ocr(S.line_spans(docs), docs, 3).collect()) == [2, 3]
    assert spark.createDataFrame([("<p>a &amp; b</p><script>x</script><!-- y -->c",)], "html string").select(S.html_text()).first()[0] == "a & b c"
    assert sinks.ocr_text(S.line_spans(docs)).first()["text"] == "a  b\nc"
    assert providers.engines(providers.ocr_mode("AUTO"), {"tesseract", "paddle"}) == ["paddle", "tesseract"] and providers.engines(providers.ocr_mode("odd"), set()) == ["tesseract"]


def ocr_words(spark, doc, words, conf=0.95):
    return spark.createDataFrame([(doc, k, t, (45.0 * k, 0.0, 45.0 * k + 40, 20.0), 0, "ocr", conf, "word") for k, t in enumerate(words)], SPANS)


def test_stitched_numbers_are_redacted_and_searched_again(spark):
    """Four words of one number go, a fifth and sixth that make no number with the rest stay."""
    words = ocr_words(spark, 1, ["4242", "4242", "4242", "4242"]).union(ocr_words(spark, 2, ["4242"] * 8)).union(ocr_words(spark, 3, ["Paid", "5555", "5555", "5555", "4444", "thanks", "for", "everything"]))
    out = R.redact_text(words, packs.pan_detections(words))
    assert [r["text"] for r in out.where("doc_id = 1").orderBy("span_id").collect()] == ["█" * 4] * 4
    assert [r["text"] for r in out.where("doc_id = 3").orderBy("span_id").collect()] == ["Paid", *["█" * 4] * 4, "thanks", "for", "everything"]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {r["doc_id"]: (r["decision"], [x["code"] for x in r["reasons"]], len(r["detections"]), r["trace"]["post_redaction"]["hits_remaining"]) for r in packs.pci_lite(docs, words).collect()}
    assert got[1] == ("REJECTED", ["EXTRACTION_EMPTY"], 1, 0)
    # Eight equal groups are one number by its digits: what is left after it goes is found again.
    assert got[2] == ("REVIEW", ["PAN_REMAINS_AFTER_REDACTION"], 1, 1)
    assert got[3] == ("CONFIRMED", [], 1, 0)


def test_word_ids_differ(spark):
    docs = spark.createDataFrame([(1, "w " * 100_003 + "\nnext line")], "doc_id long, text string")
    words = S.word_spans(docs)
    assert words.count() == words.select("span_id").distinct().count() == 100_005
    pages = spark.createDataFrame([(1, ["a\nb", None, "c"], "ocr", 0.4)], "doc_id long, pages array<string>, source string, quality_score double")
    assert [(r["page"], r["text"], r["ocr_conf"]) for r in S.page_spans(pages).orderBy("span_id").collect()] == [(0, "a", 0.4), (0, "b", 0.4), (2, "c", 0.4)]


class Reads:
    def rows(self, path, content):
        yield {"page": 0, "roi": "pan", "text": content.decode(), "avg_conf": 0.9}


class Fails:
    def rows(self, path, content):
        if b"bad" in content:
            raise ValueError("cannot read this")
        yield from Reads().rows(path, content)


class Absent:
    def __init__(self):
        raise ImportError("no such engine")


def test_ocr_attempts_keep_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("good 1")
    (tmp_path / "b.txt").write_text("bad 2")
    out = providers.ocr_attempts(spark, str(tmp_path), {"apple": Absent, "paddle": Fails}, "auto").collect()
    got = sorted((r["engine"], r["success"], r["text"], r["error"]) for r in out if r["engine"] != "none")
    assert got == [("apple", False, "", "no such engine"), ("apple", False, "", "no such engine"), ("paddle", False, "", "cannot read this"), ("paddle", True, "good 1", None)]
    none = [r for r in out if r["engine"] == "none"]
    assert len(none) == 1 and none[0]["text"] == "" and none[0]["doc_id"] == next(r["doc_id"] for r in out if r["error"] == "cannot read this")
    assert all(r["elapsed_ms"] >= 0 for r in out)


PHOTO = "doc_id long, page int, width int, height int, scale double, blur_score double, occlusion_suspected boolean, force_band_redact boolean"


def photo_rows(spark, texts, blur=80.0, hidden=False, force=False):
    pages = spark.createDataFrame([(1, 0, 1000, 600, 2.0, blur, hidden, force)], PHOTO)
    ocr = spark.createDataFrame([(1, 0, roi, k, "tesseract", t, 0.95, True) for k, (roi, t) in enumerate(texts)] + [(1, 0, "pan", 9, "apple", "", 0.0, False)], OCR_RESULTS)
    return pages, spark.createDataFrame([(1, 0, "card", 0.9, 100.0, 80.0, 900.0, 560.0), (1, 0, "face", 0.8, 10.0, 10.0, 60.0, 80.0)], BOXES), ocr


def seen(report):
    r = report.first()
    return r["decision"], [x["code"] for x in r["reasons"]], r["action"], len(r["suggested_redactions"] or [])


def test_card_run(spark):
    as_of = date(2026, 1, 1)
    good = photo_rows(spark, [("pan", "4111 1111 1111 1111"), ("expiry", "12/34")])
    out = photos.card_run(*good, as_of)
    assert seen(out) == ("CONFIRMED", ["PAN_CONFIRMED"], None, 0)
    assert [r["label"] for r in photos.paint(out, good[0], good[1]).collect()] == ["card_pan"]
    assert seen(photos.card_run(*photo_rows(spark, [("pan", "4111 1111 1111 1112")]), as_of)) == ("REVIEW", ["PAN_SUSPECT"], None, 0)
    after = spark.createDataFrame([(1, 0, "5555 5555 5555 4444", 0.9, "roi_ocr")], "doc_id long, page int, text string, ocr_conf double, source string")
    assert seen(photos.card_run(*photo_rows(spark, [("pan", "5555 5555 5555 4444")]), as_of, after=after)) == ("REVIEW", ["PAN_REMAINS"], None, 0)
    looks = spark.createDataFrame([(1, 0, 65 + 25 * i, 60, 12, 13, 150.0, 420, 225, 94500.0) for i in range(14)], CONTOURS)
    assert seen(photos.card_run(*photo_rows(spark, []), as_of, looks)) == ("REVIEW", ["PAN_SUSPECT_VISUAL"], None, 1)
    forced = photo_rows(spark, [], force=True)
    out = photos.card_run(*forced, as_of, looks)
    assert seen(out) == ("REVIEW", ["PAN_SUSPECT_VISUAL"], "FORCED_REDACT_REVIEW", 1)
    # Moved by the card's corner and scaled to page units.
    assert [(r["x0"], r["y0"]) for r in photos.paint(out, forced[0], forced[1]).collect()] == [((65 + 100) / 2, (60 + 80) / 2)]


def test_id_run(spark):
    zone = "P<GBRA" + "<" * 32 + "\n" + "123456789" + "GBR" + "<" * 26 + "0"
    rows = photo_rows(spark, [("mrz", zone), ("id_number", "ID123456")])
    out = photos.id_run(*rows)
    assert seen(out) == ("CONFIRMED", ["MRZ_CONFIRMED"], None, 0)
    assert sorted(r["label"] for r in photos.paint(out, rows[0], rows[1]).collect()) == ["face", "id_number", "mrz"]
    assert seen(photos.id_run(*photo_rows(spark, [("id_number", "ABC12345")], blur=5.0, hidden=True))) == ("REVIEW", ["ID_SUSPECT", "QUALITY_LOW", "OCCLUSION"], None, 0)
    assert photos.id_run(*rows).first()["trace"]["ocr_backends_used"] == ["tesseract"]


def test_profiles_from_data(spark):
    D.register_profile("own", D.rules_from({"fields": {"sort": {"primitive": "uk_sort_code", "category": "bank_identifiers", "context_keywords": ["sort"]}, "any": {"primitive": "id_number"}}}))
    spans = text_spans(spark, (1, "Sort code 20-18-11 or ABC123456", "text", 1.0), (2, "no 20-18-11 here", "text", 1.0))
    got = sorted((r["doc_id"], r["field_id"], r["raw"]) for r in D.profile(spans, "own", raw=True).collect())
    assert got == [(1, "any", "ABC123456"), (1, "sort", "20-18-11")] and "own" in D.profile_names()
    del D.PROFILES["own"]


def test_chosen_text(spark):
    kind = "doc_id long, pages array<string>, source string, quality_score double"
    text, ocr = spark.createDataFrame([(1, ["a"], "text", 0.9), (2, ["b"], "text", 0.1), (3, ["c"], "text", 0.1)], kind), spark.createDataFrame([(1, ["x"], "ocr", 0.9), (2, ["y"], "ocr", 0.8), (3, ["z"], "ocr", 0.2)], kind)
    read = lambda mode: {r["doc_id"]: (r["source"], r["reason"]) for r in S.chosen_text(text, ocr, mode).collect()}
    assert read("auto") == {1: ("text", None), 2: ("ocr", None), 3: ("ocr", "ocr_quality_too_low")}
    assert read("text")[2] == ("text", "quality_too_low") and read("ocr")[3] == ("ocr", "ocr_quality_too_low")


def test_stream_gives_the_batch_result(spark, tmp_path):
    spans = text_spans(spark, *[(k, f"card 4242 4242 4242 4242 paid by customer {chr(97 + k)}", "text", None) for k in range(20)])
    spans.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ST.read_spans(spark, str(tmp_path / "in"), SPANS, files_per_trigger=1)
    q = ST.detect(stream, ["card_pan"]).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = lambda df: sorted(repr(r) for r in df.collect())
    assert rows(spark.table("found")) == rows(card_pan(spans)) and spark.table("found").count() == 20
    decide = lambda b: packs.pci_lite(b.select("doc_id").distinct(), b).select("doc_id", "decision")
    done = ST.decide_batches(stream, decide, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert done.awaitTermination(120)
    assert rows(ST.decided(spark, str(tmp_path / "out"))) == rows(decide(spans))


def test_a_document_in_two_batches_is_decided_whole(spark, tmp_path):
    first = text_spans(spark, (1, "nothing to see in this line of text", "text", None), (2, "4242 4242 4242 4243 and thirty more letters", "ocr", 0.5))
    again = text_spans(spark, (1, "a number 4242 4242 4242 4243, badly read", "ocr", 0.4)).withColumn("span_id", F.lit(9).cast("long"))
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    decide = lambda b: packs.pci_lite(b.select("doc_id").distinct(), b).select("doc_id", "decision")
    for rows in (None, again):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ST.decide_batches(ST.read_spans(spark, str(tmp_path / "in"), SPANS), decide, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    assert {r["doc_id"]: r["decision"] for r in ST.decided(spark, str(tmp_path / "out")).collect()} == {1: "REVIEW", 2: "REVIEW"}
