"""Payment-card expressions: repair of look-alike letters, candidates with offsets, checksum, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that OCR takes for digits, their digits, and the shape of a card number by the newer and the older rule.
LOOKALIKE, LOOKALIKE_DIGITS = "OoIilSsBbZz", "00111558822"
SIGN = f"0-9{LOOKALIKE}"
PAN = rf"(?<![{SIGN}])(?:[{SIGN}][ \-]*){{13,19}}(?![{SIGN}])"
STRICT_PAN = r"(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])"
STRICT_LOOKALIKE, STRICT_DIGITS = "OoIilSsBZz", "0011155822"
#: Look-alikes away from digits, and everything that is no part of a number.
NOISE = rf"(?<![0-9])[{LOOKALIKE}](?![0-9])|[^0-9 \-{LOOKALIKE}]"
#: What a text with a candidate has at least. A look-alike stays only beside a digit, so thirteen signs have five digits.
SOME_DIGITS = "(?:[0-9][^0-9]*+){5}"
SOME_STRICT = f"(?:[0-9{STRICT_LOOKALIKE}][ -]?+){{13}}"
OPEN, CLOSE = "\x01", "\x02"
#: Signs for look-alikes away from digits, which part digits but can still be told apart, and the shape of a number among them.
GREEK = "αβγδεζηθικλ"
CLEAN_PAN = rf"(?<![{SIGN}])[{SIGN}](?:[ \-*{GREEK}]*[{SIGN}]){{12,18}}(?![{SIGN}])"


def plain(text: Column) -> Column:
    """The text without the two marks that offsets are found by, of the same length."""
    return F.translate(text, OPEN + CLOSE, "  ")


def located(text: Column, pattern: str) -> Column:
    """All matches with their offsets, array of (start, found). Matches are put between marks, the text is split there, and the
    lengths of the parts before add up to the offsets."""
    def parts_of(parts: Column) -> Column:
        begin = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))
        step = lambda a, p: F.struct(
            (a["at"] + F.length(p) - 1).alias("at"),
            F.array_append(a["out"], F.struct(a["at"].alias("start"), F.substring_index(p, CLOSE, 1).alias("found"))).alias("out"),
        )
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), begin, step, lambda a: a["out"])

    # An array of one binds the parts, which are named thrice, so that they are made once.
    return F.transform(F.array(F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN, -1)), parts_of)[0]


def sanitised(text: Column) -> Column:
    """Same length; only digits, spaces, hyphens and look-alikes next to digits stay."""
    return F.regexp_replace(text, NOISE, " ")


def digits_of(candidate: Column, repair: bool = True) -> Column:
    """Digits of a candidate with look-alikes repaired; none at all if it has mask signs."""
    fixed = F.translate(candidate, LOOKALIKE, LOOKALIKE_DIGITS) if repair else candidate
    return F.when(candidate.rlike("[*•]"), F.lit("")).otherwise(F.regexp_replace(fixed, "[^0-9]", ""))


def cleaned(text: Column) -> Column:
    """Same length; digits, spaces, hyphens, mask signs as stars, look-alikes as they are next to digits and else as Greek letters."""
    out = F.translate(F.regexp_replace(text, rf"[^0-9 \-{LOOKALIKE}*•]", " "), LOOKALIKE + "•", GREEK + "*")
    for letter, sign in zip(LOOKALIKE, GREEK):
        out = F.regexp_replace(out, f"(?<=[0-9]){sign}|{sign}(?=[0-9])", letter)
    return out


def valid_numbers(clean: Column) -> Column:
    """The numbers of a cleaned text that pass the checksum, as they stand there."""
    digits = lambda m: F.regexp_replace(F.translate(m, LOOKALIKE + GREEK, LOOKALIKE_DIGITS * 2), "[^0-9]", "")
    found = F.regexp_extract_all(clean, F.lit(CLEAN_PAN), F.lit(0))
    return F.filter(found, lambda m: ~m.contains("*") & F.length(digits(m)).between(13, 19) & luhn(digits(m)))


def candidates(text: Column, repair: bool = True) -> Column:
    """Card number candidates of a text: array of (start, length, digits) with 13 to 19 digits."""
    raw = plain(text)

    def one(m: Column) -> Column:
        lead = F.length(m["found"]) - F.length(F.ltrim(m["found"]))
        body = F.regexp_replace(m["found"], r"^[ \-]+|[ \-]+$", "")
        start = m["start"] + lead
        return F.struct(start.alias("start"), F.length(body).alias("length"), digits_of(F.substring(raw, start + 1, F.length(body)), repair).alias("digits"))

    found = F.transform(located(sanitised(raw), PAN), one)
    return F.filter(found, lambda m: F.length(m["digits"]).between(13, 19))


def strict_candidates(text: Column) -> Column:
    """Candidates of the older rule: at most one separator between digits, and letters repaired only if they are a quarter or less
    of the candidate's letters and digits."""
    raw = plain(text)

    def one(m: Column) -> Column:
        slice_ = F.substring(raw, m["start"] + 1, F.length(m["found"]))
        signs, letters = F.regexp_replace(slice_, "[^0-9A-Za-z]", ""), F.regexp_replace(slice_, "[^A-Za-z]", "")
        fixed = F.when(F.length(letters) <= 0.25 * F.greatest(F.length(signs), F.lit(1)), F.translate(slice_, STRICT_LOOKALIKE, STRICT_DIGITS)).otherwise(slice_)
        return F.struct(m["start"].alias("start"), F.length(m["found"]).alias("length"), F.regexp_replace(fixed, "[^0-9]", "").alias("digits"))

    found = F.transform(located(F.translate(raw, STRICT_LOOKALIKE, STRICT_DIGITS), STRICT_PAN), one)
    return F.filter(found, lambda m: F.length(m["digits"]).between(13, 19))


def luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def mask(digits: Column) -> Column:
    """Stars but for the last four digits, in groups of four from the left."""
    hidden = F.concat(F.repeat(F.lit("*"), F.greatest(F.length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))
    return F.regexp_replace(hidden, "(.{4})(?=.)", "$1 ")


def digitish(text: Column, least: float = 0.5, symbols: bool = True) -> Column:
    """Whether enough of a token's letters, digits and per cent signs could be digits."""
    relevant = F.regexp_replace(text, r"[^\p{L}\p{N}%]", "")
    alike = F.regexp_replace(relevant, f"[^0-9{LOOKALIKE}{'%' if symbols else ''}]", "")
    return F.coalesce((F.length(relevant) > 0) & (F.length(alike) >= least * F.length(relevant)), F.lit(False))


def stitched_digits(text: Column, b_is_6: bool = False, symbols: bool = True) -> Column:
    """Digits of joined tokens; other letters are dropped, and a per cent sign is a 4."""
    text = F.translate(text, LOOKALIKE.replace("b", ""), "0011155822")
    text = F.translate(text, "b", "6" if b_is_6 else "8")
    return F.regexp_replace(F.translate(text, "%", "4") if symbols else text, "[^0-9]", "")


def roi_candidate(text: Column) -> Column:
    """Digits of the first card number of a region's text, or of all its digits if those make one."""
    from .text import strip

    clean = strip(text)
    first, all_ = F.regexp_extract(clean, f"({PAN})", 1), F.regexp_replace(clean, "[^0-9]", "")
    digits = F.when(first != "", digits_of(first)).when(F.length(all_).between(13, 19), all_)
    return F.when(F.length(digits).between(13, 19), digits)
