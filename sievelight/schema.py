"""Row types of the engine."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPANS = f"doc_id long, span_id long, text string, bbox {BOX}, page int, source string, ocr_conf double, span_kind string"
DETECTIONS = f"doc_id long, span_id long, field_id string, category string, primitive string, text string, raw string, bbox {BOX}, page int, source string, severity string, validators array<string>, confidence double, start int, length int, context string"
BOXES = "doc_id long, page int, label string, conf double, x1 double, y1 double, x2 double, y2 double"
PAGES = "doc_id long, page int, width int, height int, scale double, render_dpi int, source string"
OCR_WORDS = f"array<struct<text:string,bbox:{BOX},confidence:double>>"
OCR_RESULTS = "doc_id long, page int, roi string, backend_order int, engine string, text string, avg_conf double, success boolean"
ATTEMPTS = f"{OCR_RESULTS}, error string, elapsed_ms double"
CONTOURS = "doc_id long, page int, px int, py int, pw int, ph int, contour_area double, card_w int, card_h int, card_area double"
DOC_TEXT = "doc_id long, pages array<string>, source string, quality_score double"

#: Categories of personal data.
CATEGORIES = ("customer_identity", "bank_identifiers", "card_numbers", "transaction_details", "gov_identifiers")
#: Suffixes of a document's artifacts.
ARTIFACTS = {"highlight_pdf": "_highlight.pdf", "redacted_pdf": "_redacted.pdf", "report_json": "_report.json", "ocr_text": "_ocr_text.txt", "ocr_spans": "_ocr_spans.json"}
