"""Detectors, stitching and field parsers on literal spans, and against plain Python on random text."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from sievelight.functions import fields, pan
from sievelight.functions import text as T
from sievelight.operators import detectors as D
from sievelight.operators import geometry as G
from sievelight.operators.detectors import PanConfig
from sievelight.schema import SPANS

BOX = (10.0, 20.0, 200.0, 40.0)


def spans(spark, *rows):
    """Rows of (text, source, conf, box)."""
    return spark.createDataFrame([(1, k, t, b, 0, s, c, "line") for k, (t, s, c, b) in enumerate(rows)], SPANS)


def found(df):
    return [r.asDict() for r in df.collect()]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_valid_number(spark):
    (r,) = found(D.card_pan(spans(spark, ("Please charge my card 4242 4242 4242 4242 for this order.", "text", None, BOX))))
    assert r["severity"] == "hit" and r["validators"] == ["luhn"] and r["text"].endswith("4242") and r["text"].startswith("****")
    assert tuple(r["bbox"]) == BOX and (r["start"], r["length"]) == (22, 19)


@pytest.mark.parametrize("text", ["Card: 4242 4242 4242 4243", "Card used: **** **** **** 4242", "", None, "no digits", "42" * 20])
def test_nothing(spark, text):
    assert found(D.card_pan(spans(spark, (text, "text", None, BOX)))) == []


def test_low_confidence_is_a_suspicion(spark):
    (r,) = found(D.card_pan(spans(spark, ("4242 4242 4242 4243", "ocr", 0.60, BOX)), PanConfig(suspicion_below=0.75)))
    assert r["severity"] == "suspicion" and "luhn" not in r["validators"]
    assert found(D.card_pan(spans(spark, ("4242 4242 4242 4243", "ocr", 0.90, BOX)))) == []
    assert len(found(D.card_pan(spans(spark, ("4242 4242 4242 4243", "ocr", None, BOX))))) == 1


def test_lookalikes_are_repaired(spark):
    (r,) = found(D.card_pan(spans(spark, ("Card 4O12 8888 8888 1881", "text", None, BOX)), raw=True))
    assert r["raw"] == "4012888888881881"


def test_raw_is_hashed_by_default(spark):
    (r,) = found(D.card_pan(spans(spark, ("4242424242424242", "text", None, BOX))))
    assert len(r["raw"]) == 64


def boxes(n=4):
    return [(45.0 * k, 0.0, 45.0 * k + 40, 20.0) for k in range(n)]


def test_stitching_with_b_as_6(spark):
    df = spans(spark, *zip(["4000", "123%", "Sb78", "9017"], ["ocr"] * 4, [0.95, 0.60, 0.65, 0.90], boxes()))
    (r,) = found(G.stitch_detections(df, PanConfig(b_as_6=True)))
    assert r["severity"] == "hit" and {"stitch", "confusable:b->6"} <= set(r["validators"]) and tuple(r["bbox"]) == (0.0, 0.0, 175.0, 20.0)


def test_stitching_of_low_confidence(spark):
    df = spans(spark, *zip(["6000", "1234", "5678", "9010"], ["ocr"] * 4, [0.55, 0.50, 0.45, 0.40], boxes()))
    (r,) = found(G.stitch_detections(df))
    assert r["severity"] == "suspicion" and "near_pan" in r["validators"]


def test_far_gaps_and_text_spans_are_not_stitched(spark):
    far = [(200.0 * k, 0.0, 200.0 * k + 40, 20.0) for k in range(4)]
    df = spans(spark, *zip(["4242"] * 4, ["ocr"] * 4, [0.9] * 4, far))
    assert found(G.stitch_detections(df)) == []
    assert found(G.stitch_detections(spans(spark, *zip(["4242"] * 4, ["text"] * 4, [0.9] * 4, boxes())))) == []


def test_running_lines_join_after_a_mean_of_zero(spark):
    rows = [("a", "ocr", 1.0, (0.0, -5.0, 1.0, 5.0)), ("b", "ocr", 1.0, (5.0, 95.0, 6.0, 105.0)), ("c", "ocr", 1.0, (9.0, 95.0, 9.5, 105.0))]
    got = {r["span_id"]: r["line_no"] for r in found(G.running_lines(spans(spark, *rows)))}
    assert got[0] == got[1] and got[2] != got[1]


def plain_lines(rows, tol):
    order, out, line, mean, n = sorted(rows, key=lambda r: ((r[1] + r[2]) / 2, r[0], r[3])), {}, -1, 0.0, 0
    for x, y0, y1, k in order:
        c = (y0 + y1) / 2
        if n and abs(c - (mean or c)) <= tol:
            n += 1
            mean = (mean * (n - 1) + c) / n
        else:
            line, n, mean = line + 1, 1, c
        out[k] = line
    return out


def test_running_lines_against_plain(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(100)), float(y := rng.randrange(60)), y + 10.0, k) for k in range(60)]
    df = spark.createDataFrame([(1, k, "t", (x, a, x + 1, b), 0, "ocr", 1.0, "word") for x, a, b, k in rows], SPANS)
    assert {r["span_id"]: r["line_no"] for r in found(G.running_lines(df, 4.0))} == plain_lines(rows, 4.0)


C = "0-9BIOSZbilosz"
PAN_RE = re.compile(rf"(?<![{C}])(?:[{C}][ \-]*){{13,19}}(?![{C}])")
REPAIR = dict(zip("OoIilSsBbZz", "00111558822"))


def plain_candidates(raw):
    kept = []
    for i, c in enumerate(raw):
        near = (i and raw[i - 1] in "0123456789") or (i + 1 < len(raw) and raw[i + 1] in "0123456789")
        kept.append(c if c in "0123456789 -" or c in REPAIR and near else " ")
    clean, out = "".join(kept), []
    for m in PAN_RE.finditer(clean):
        a, b = m.span()
        while a < b and clean[a] in " -":
            a += 1
        while b > a and clean[b - 1] in " -":
            b -= 1
        part = raw[a:b]
        digits = "" if "*" in part or "•" in part else "".join(REPAIR.get(c, c) for c in part if c in REPAIR or c in "0123456789")
        if 13 <= len(digits) <= 19:
            out.append((a, b - a, digits))
    return out


def test_candidates_against_plain(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789" * 3 + " - OolISsBbZzxé*•\n😀\x01\x02") for _ in range(rng.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pan.candidates(F.col("text")).alias("c"))
    for r in df.collect():
        assert [tuple(x) for x in r["c"]] == plain_candidates(r["text"].replace("\x01", " ").replace("\x02", " ")), repr(r["text"])


def test_checksum_and_mask(spark):
    rng = random.Random(3)
    digits = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    rows = spark.createDataFrame([(d,) for d in digits], "d string").select("d", pan.luhn(F.col("d")), pan.mask(F.col("d"))).collect()
    for d, ok, shown in rows:
        hidden = "*" * max(0, len(d) - 4) + d[-4:]
        assert ok == luhn(d) and shown == " ".join(hidden[i : i + 4] for i in range(0, len(hidden), 4))


@pytest.mark.parametrize(("text", "conf", "expected"), [("Card 4111 1111 1111 1111", 0.9, ("hit", ["regex", "roi", "luhn"])), ("4111 1111 1111 1112", 0.9, ("suspicion", ["regex", "roi"])), ("4111 1111 1111 1111", 0.2, ("suspicion", ["regex", "roi", "luhn", "low_conf"])), ("41 x 11 y 1111 z 1111 w 1111", 0.9, ("hit", ["regex", "roi", "luhn"])), ("123", 0.9, None)])
def test_region_numbers(spark, text, conf, expected):
    got = [(r["severity"], r["validators"]) for r in found(D.card_pan_roi(spans(spark, (text, "roi_ocr", conf, BOX))))]
    assert got == ([expected] if expected else [])


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_expiry(spark):
    parse = lambda t: one(spark, t, lambda c: fields.expiry(c, date(2026, 5, 1)))
    assert (parse("valid thru 12/34")["text"], parse("valid thru 12/34")["severity"]) == ("12/34", "hit")
    assert parse("10/11/2025")["text"] == "10/11" and parse("10/11/2025")["severity"] == "suspicion"
    assert parse("01/24")["validators"] == ["format_mm_yy", "expired"] and parse("01-25")["severity"] == "hit"
    assert parse("13/30") is None and parse(None) is None and parse("") is None


def test_mrz_and_id(spark):
    line = "P<GBRSMITH<<JOHN<<<<<<<<<<<<<<<<<<<<"
    assert one(spark, f" {line}\n{line.lower()}\nshort", fields.mrz) == f"{line}\n{line}"
    assert one(spark, line, fields.mrz) is None
    assert one(spark, "AB12345", fields.id_number) == "AB12345" and one(spark, "123", fields.id_number) is None and one(spark, "ab12345x", fields.id_number) is None


def test_text_helpers(spark):
    assert one(spark, "a1 12 123 1234 12345 x123456789", T.mask_preview) == "a1 ## ### #### #2345 x#####6789"
    assert one(spark, "a\r\nb\x0bc d\n", T.lines) == ["a", "b", "c", "d"]
    assert one(spark, "  x  ", T.strip) == "x"
    assert one(spark, "£ 1,234.50", T.is_currency) and not one(spark, "1,23", T.is_currency)


def test_uk_identifiers(spark):
    rows = ["Sort code 20-18-11", "Account number 83337973", "IBAN GB73 BOFS 2018 1183 3379 73", "NI AB123456C", "BG123456C", "NHS 943 476 5919", "ABCD9123456AB12", "SW1A 1AA"]
    df = spans(spark, *[(t, "text", None, BOX) for t in rows])
    count = lambda name, **o: len(found(D.get(name)(df, **o)))
    assert count("uk_sort_code") == 1 and count("uk_account_number_8d") == 1 and count("iban_gb") == 1
    assert count("uk_ni_number") == 0 and count("uk_ni_number", keywords=("ni",)) == 1
    assert count("uk_nhs_number", keywords=("nhs",)) == 1 and count("uk_driving_licence", keywords=("abcd",)) == 1
    assert count("uk_postcode_enhanced") == 0 and count("uk_postcode_enhanced", allow_unrestricted=True) == 1
    assert count("uk_address_line") == 0 and count("uk_address_line", region={"page": 0, "x_range": (0, 1), "y_range": (0, 1)}, sizes=(300.0, 100.0)) == 1
    assert {r["field_id"] for r in found(D.profile(df, "uk.bank_statement.v1"))} == {"sort_code", "account_number", "iban_gb"}


def test_registry():
    with pytest.raises(ValueError):
        D.get("nothing")
    assert {"card_pan", "card_16", "uk_sort_code", "name_header", "uk_address_line"} <= set(D.names())
    before = D.get("mrz")
    D.register("mrz")(before)
    assert D.get("mrz") is before
