"""Text expressions: trimming, lines, masks, context keywords, currency, quality."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, beside CR LF.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
#: Every white space, as signs and as a class of a pattern.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = "\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: an amount alone.
CURRENCY = r"^[£]?\s*-?\d{1,3}(,\d{3})*(\.\d{2})?\s*$"
#: Words that lift the quality score of a statement's text.
QUALITY_WORDS = {
    "text": ["sort code", "account number", "iban", "statement", "account"],
    "ocr": ["sort code", "account number", "iban", "statement"],
}


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def pieces(text: Column) -> Column:
    """Parts of a text between line breaks; a break at the end opens an empty one."""
    return F.split(text, LINE_END, -1)


def some(text: Column) -> Column:
    """Whether a text has a sign that isn't white space."""
    return text.rlike(f"[^{BLANK}]")


def lines(text: Column) -> Column:
    """Lines of a text; a break at the end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def mask_preview(text: Column) -> Column:
    """Digit runs of two to four become as many #; longer ones keep their last four digits."""
    for n in (2, 3, 4):
        text = F.regexp_replace(text, f"(?<![0-9])[0-9]{{{n}}}(?![0-9])", "#" * n)
    return F.regexp_replace(text, "[0-9](?=[0-9]{4})", "#")


def has_context(text: Column, keywords: list[str]) -> Column:
    """Whether a text has any of the keywords (lower case), wherever it stands."""
    return F.lower(text).rlike("|".join(map(re.escape, keywords))) if keywords else F.lit(False)


def is_currency(text: Column) -> Column:
    return text.rlike(CURRENCY)


def quality(pages: Column, source: str = "text") -> Column:
    """Score of extracted text: full at 2000 characters, and a little more with a keyword."""
    joined = F.array_join(pages, "\n" if source == "text" else " ")
    n = F.length(strip(joined)) if source == "text" else F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(F.coalesce(p, F.lit(""))))
    boost = F.when(has_context(joined, QUALITY_WORDS[source]), 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), n / F.lit(2000.0)) + boost)
    return F.when(n == 0, F.lit(0.0)).otherwise(score) if source == "text" else score
