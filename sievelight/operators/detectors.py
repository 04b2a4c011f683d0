"""Detectors: tables of spans to tables of detections, by name.

Every detector is a projection and an explode of array expressions: no shuffle, no Python worker, and it runs on streams as well.
Masked text is the rule; the raw value comes only with ``raw=True``, else its SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, pan, text

Detector = Callable[..., DataFrame]
_REGISTRY: dict[str, Detector] = {}


def register(name: str) -> Callable[[Detector], Detector]:
    """Register a detector under a name; a later one replaces an earlier one."""

    def put(f: Detector) -> Detector:
        _REGISTRY[name] = f
        return f

    return put


def get(name: str) -> Detector:
    if name not in _REGISTRY:
        raise ValueError(f"unknown detector {name!r}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


@dataclass(frozen=True)
class PanConfig:
    """Tunables of card number detection. The numbers."""

    #: Repairs: look-alike letters, the per cent sign as a 4, and b as a 6 where 8 fails the checksum.
    repair: bool = True
    repair_signs: bool = True
    b_as_6: bool = False
    #: Confidences of OCR below which a failed number is a suspicion, on average and of the worst word.
    suspicion_below: float = 0.75
    weak_word: float = 0.6
    #: Stitching: fewest and most words, least share of digit-like signs, widest gap (in units, and in heights of the words), and the
    #: height of a line.
    words: tuple[int, int] = (2, 6)
    digit_share: float = 0.5
    gap: tuple[float, float] = (40.0, 1.0)
    line_height: float = 8.0

    @property
    def threshold(self) -> float:
        return min(max(self.suspicion_below, 0.0), 1.0)


@dataclass(frozen=True)
class Rule:
    """A field of a profile: a detector with its category and context keywords."""

    field_id: str
    primitive: str
    category: str
    keywords: tuple[str, ...] = field(default=())


def _cols(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names]


def detections(spans: DataFrame, found: Column, field_id: str, category: str, primitive: str, raw: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode an array of (text, raw, severity, validators, start, length) into detection rows; ``keep`` names more columns."""
    out = spans.withColumn("_m", F.explode(found))
    value = F.col("_m.raw") if raw else F.sha2(F.col("_m.raw"), 256)
    return out.select(
        *_cols(out, "doc_id", "span_id"), F.lit(field_id).alias("field_id"), F.lit(category).alias("category"), F.lit(primitive).alias("primitive"), F.col("_m.text").alias("text"), value.alias("raw"),
        *_cols(out, "bbox", "page", "source"), F.col("_m.severity").alias("severity"), F.col("_m.validators").alias("validators"), F.lit(1.0).alias("confidence"), F.col("_m.start").alias("start"), F.col("_m.length").alias("length"), text.strip(F.col("text")).alias("context"), *map(F.col, keep),
    )


def _entry(shown: Column, raw: Column, severity: Column, validators: Column, start: Column, length: Column) -> Column:
    return F.struct(shown.alias("text"), raw.alias("raw"), severity.alias("severity"), validators.cast("array<string>").alias("validators"), start.cast("int").alias("start"), length.cast("int").alias("length"))


def _judged(found: Column, suspicious: Column, passed: list[str], failed: list[str]) -> Column:
    def one(m: Column) -> Column:
        ok = pan.luhn(m["digits"])
        return _entry(pan.mask(m["digits"]), m["digits"], F.when(ok, "hit").otherwise("suspicion"), F.when(ok, F.array(*map(F.lit, passed))).otherwise(F.array(*map(F.lit, failed))), m["start"], m["length"])

    return F.transform(F.filter(found, lambda m: pan.luhn(m["digits"]) | suspicious), one)


def pan_found(text_: Column, config: PanConfig = PanConfig()) -> Column:
    """Judged card numbers of a span's text, of spans with source and ocr_conf; null where the text has too few digits."""
    low = F.coalesce((F.col("source") == "ocr") & (F.coalesce("ocr_conf", F.lit(0.0)) < config.threshold), F.lit(False))
    return F.when(text_.rlike(pan.SOME_DIGITS), _judged(pan.candidates(text_, config.repair), low, ["luhn"], ["regex"]))


def strict_found(text_: Column, config: PanConfig = PanConfig()) -> Column:
    """The same by the older rule; without a confidence there is no suspicion."""
    low = F.coalesce((F.lower(F.coalesce("source", F.lit(""))) == "ocr") & F.col("ocr_conf").isNotNull() & (F.col("ocr_conf") < config.threshold), F.lit(False))
    return F.when(text_.rlike(pan.SOME_STRICT), _judged(pan.strict_candidates(text_), low, ["luhn"], []))


@register("card_pan")
def card_pan(spans: DataFrame, config: PanConfig = PanConfig(), raw: bool = False) -> DataFrame:
    """Card numbers in single spans: a hit if the checksum holds, a suspicion if not but the span is OCR of low confidence."""
    return detections(spans, pan_found(F.col("text"), config), "card_pan", "card_numbers", "card_pan", raw)


@register("card_pan_strict")
def card_pan_strict(spans: DataFrame, config: PanConfig = PanConfig(), keywords: tuple[str, ...] = (), raw: bool = False) -> DataFrame:
    """Card numbers by the older rule, in spans with a keyword if any are given."""
    some = spans.where(text.has_context(F.col("text"), list(keywords))) if keywords else spans
    return detections(some, strict_found(F.col("text"), config), "card_pan", "card_numbers", "card_pan", raw)


register("card_16")(card_pan_strict)


@register("card_pan_roi")
def card_pan_roi(rois: DataFrame, raw: bool = False) -> DataFrame:
    """The card number of a region's text; one that passes is a suspicion still if the region was read badly."""
    digits = pan.roi_candidate(F.col("text"))
    ok, bad = pan.luhn(digits), F.coalesce("ocr_conf", F.lit(0.0)) < 0.5
    validators = F.filter(F.array(F.lit("regex"), F.lit("roi"), F.when(ok, "luhn"), F.when(ok & bad, "low_conf")), lambda v: v.isNotNull())
    entry = _entry(pan.mask(digits), digits, F.when(ok & ~bad, "hit").otherwise("suspicion"), validators, F.lit(None), F.lit(None))
    return detections(rois, F.when(digits.isNotNull(), F.array(entry)), "card_pan", "card_numbers", "card_pan", raw)


@register("card_expiry")
def card_expiry(rois: DataFrame, as_of: date, raw: bool = True) -> DataFrame:
    e = fields.expiry(F.col("text"), as_of)
    return detections(rois, F.when(e.isNotNull(), F.array(_entry(e["text"], e["raw"], e["severity"], e["validators"], F.lit(None), F.lit(None)))), "card_expiry", "card_numbers", "card_expiry", raw)


@register("mrz")
def mrz(rois: DataFrame, raw: bool = False) -> DataFrame:
    m = fields.mrz(F.col("text"))
    shown = F.regexp_replace(m, "[A-Z0-9](?=[^\n]{4})", "*")
    return detections(rois, F.when(m.isNotNull(), F.array(_entry(shown, m, F.lit("hit"), F.array(F.lit("mrz_pattern")), F.lit(None), F.lit(None)))), "mrz", "gov_identifiers", "mrz", raw)


@register("id_number")
def id_number(rois: DataFrame, raw: bool = False) -> DataFrame:
    n = fields.id_number(F.col("text"))
    shown = F.concat(F.repeat(F.lit("*"), F.greatest(F.length(n) - 4, F.lit(0))), F.right(n, F.lit(4)))
    return detections(rois, F.when(n.isNotNull(), F.array(_entry(shown, n, F.lit("suspicion"), F.array(F.lit("pattern_alnum")), F.lit(None), F.lit(None)))), "id_number", "gov_identifiers", "id_number", raw)


#: Patterns of identifiers, with their category and whether they need a keyword in their line.
PATTERNS = {
    "uk_sort_code": (r"\b\d{2}-\d{2}-\d{2}\b", "bank_identifiers", False),
    "uk_account_number_8d": (r"\b\d{8}\b", "bank_identifiers", False),
    "iban_gb": (r"\bGB[0-9A-Z]{2}[0-9A-Z ]{10,30}\b", "bank_identifiers", False),
    "uk_ni_number": (r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]?\b", "gov_identifiers", True),
    "uk_nhs_number": (r"\b\d{3}\s?\d{3}\s?\d{4}\b", "gov_identifiers", True),
    "uk_driving_licence": (r"\b[A-Z9]{5}\d{6}[A-Z9]{2}\d{2}\b", "gov_identifiers", True),
    "uk_passport_number": (r"\b\d{9}\b", "gov_identifiers", True),
}
POSTCODE = r"\b([A-Z]{1,2}\d[A-Z\d]?)\s?(\d[A-Z]{2})\b"
#: Words of an address line.
ADDRESS_WORDS = ["road", "street", "avenue", "lane", "close", "drive", "flat", "house", "no.", "building"]


#: What a match must not hold, by name.
EXCEPT = {"uk_account_number_8d": r"[.,£$]"}


def pattern_found(text_: Column, regex: str, drop: str | None = None) -> Column:
    """All matches of a pattern, masked but for the last two signs; null without any."""
    found = pan.located(pan.plain(text_), f"(?:{regex})")
    if drop:
        found = F.filter(found, lambda m: ~m["found"].rlike(drop))
    hidden = lambda v: F.concat(F.repeat(F.lit("*"), F.greatest(F.length(v) - 2, F.lit(0))), F.right(v, F.lit(2)))
    one = lambda m: _entry(hidden(m["found"]), m["found"], F.lit("hit"), F.array(F.lit("pattern")), m["start"], F.length(m["found"]))
    return F.when(text_.rlike(regex), F.transform(found, one))


def pattern(spans: DataFrame, name: str, regex: str, category: str, raw: bool = False) -> DataFrame:
    return detections(spans, pattern_found(F.col("text"), regex, EXCEPT.get(name)), name, category, name, raw)


def _by_pattern(name: str) -> Detector:
    regex, category, needs = PATTERNS[name]

    def detect(spans: DataFrame, keywords: tuple[str, ...] = (), raw: bool = False) -> DataFrame:
        if keywords:
            spans = spans.where(text.has_context(F.col("text"), list(keywords)))
        elif needs:
            spans = spans.where(F.lit(False))
        return pattern(spans, name, regex, category, raw)

    return detect


for _name in PATTERNS:
    register(_name)(_by_pattern(_name))


def in_region(spans: DataFrame, region: dict | None, sizes: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Spans inside a region given by page and fractions of the page's width and height."""
    if not region:
        return spans
    (x0, x1), (y0, y1), (w, h) = region["x_range"], region["y_range"], sizes
    b = F.col("bbox")
    return spans.where((F.col("page") == region.get("page", 0)) & (b["x0"] >= x0 * w) & (b["x1"] <= x1 * w) & (b["y0"] >= y0 * h) & (b["y1"] <= y1 * h))


@register("uk_postcode_enhanced")
def uk_postcode(spans: DataFrame, region: dict | None = None, sizes: tuple[float, float] = (1.0, 1.0), allow_unrestricted: bool = False, raw: bool = False) -> DataFrame:
    """Postcodes inside a region; without one only if all lines are allowed."""
    some = in_region(spans, region, sizes) if region or allow_unrestricted else spans.where(F.lit(False))
    return pattern(some, "uk_postcode_enhanced", POSTCODE, "customer_identity", raw)


@register("uk_address_line")
def uk_address_line(spans: DataFrame, region: dict | None = None, sizes: tuple[float, float] = (1.0, 1.0), raw: bool = False) -> DataFrame:
    """Lines of a region that have a postcode or an address word; without a region none."""
    some = in_region(spans, region, sizes) if region else spans.where(F.lit(False))
    line = text.strip(F.col("text"))
    some = some.where(F.col("text").rlike(POSTCODE) | text.has_context(F.col("text"), ADDRESS_WORDS))
    return detections(some, F.array(_entry(F.regexp_replace(line, r"[\p{L}\p{N}]", "*"), line, F.lit("hit"), F.array(F.lit("address")), F.lit(0), F.length("text"))), "uk_address_line", "customer_identity", "uk_address_line", raw)


@register("name_header")
def name_header(lines: DataFrame, field_id: str = "account_name", raw: bool = False) -> DataFrame:
    """Header lines (doc_id, page, line_no, text) that can name the account holder; for ``account_name`` the first alone."""
    line = text.strip(F.col("text"))
    some = lines.where(fields.header_line(line))
    if field_id == "account_name":
        first = some.groupBy("doc_id").agg(F.min_by(F.struct(*some.columns), F.struct("page", "line_no")).alias("r"))
        some = first.select("r.*")
    return detections(some, F.array(_entry(F.regexp_replace(line, r"[\p{L}\p{N}]", "*"), line, F.lit("hit"), F.array(F.lit("header")), F.lit(0), F.length("text"))), field_id, "customer_identity", "name_header", raw)


def header_names(words: DataFrame, region: dict, sizes: tuple[float, float] = (1.0, 1.0), field_id: str = "account_name", raw: bool = False) -> DataFrame:
    """Names in the header: the region's words, grouped to lines whose tops differ by two units at most."""
    from .geometry import line_spans

    lines = line_spans(in_region(words, region, sizes), 2.0).withColumn("source", F.lit("text"))
    return name_header(lines, field_id, raw)


#: Fields of the UK bank statement profile.
UK_BANK_STATEMENT = (
    Rule("sort_code", "uk_sort_code", "bank_identifiers", ("sort code", "sort-code", "sc")),
    Rule("account_number", "uk_account_number_8d", "bank_identifiers", ("account number", "account no", "a/c no", "acc no")),
    Rule("iban_gb", "iban_gb", "bank_identifiers", ("iban",)),
    Rule("card_pan", "card_pan_strict", "card_numbers", ("card number", "credit card", "debit card")),
)
PROFILES: dict[str, tuple[Rule, ...]] = {}


def register_profile(profile_id: str, rules: tuple[Rule, ...]) -> None:
    """Put a profile under a name; a later one replaces an earlier one."""
    PROFILES[profile_id] = tuple(rules)


def profile_names() -> list[str]:
    return sorted(PROFILES)


register_profile("uk.bank_statement.v1", UK_BANK_STATEMENT)


def rules_from(config: dict) -> tuple[Rule, ...]:
    """Rules of a profile given as data: {"fields": {field_id: {"primitive", "category", "context_keywords"}}}."""
    return tuple(Rule(k, v["primitive"], v.get("category", ""), tuple(v.get("context_keywords") or ())) for k, v in (config.get("fields") or {}).items())


def _rule_found(rule: Rule) -> Column | None:
    """A rule's detections as an array, or null if its detector is no projection of the span alone."""
    if rule.primitive in ("card_pan_strict", "card_16"):
        found, name = strict_found(F.col("text")), "card_pan"
    elif rule.primitive in PATTERNS:
        regex, _, needs = PATTERNS[rule.primitive]
        if needs and not rule.keywords:
            return F.lit(None)
        found, name = pattern_found(F.col("text"), regex, EXCEPT.get(rule.primitive)), rule.primitive
    else:
        return None
    gate = text.has_context(F.col("text"), list(rule.keywords)) if rule.keywords else F.lit(True)
    return F.when(gate, F.transform(found, lambda m: F.struct(F.lit(rule.field_id).alias("field_id"), F.lit(rule.category).alias("category"), F.lit(name).alias("primitive"), m.alias("m"))))


def profile(spans: DataFrame, profile_id: str, raw: bool = False) -> DataFrame:
    """Detections of all fields of a profile: one scan for all rules that are projections, whatever their number."""
    if profile_id not in PROFILES:
        raise ValueError(f"unknown profile {profile_id!r}; there are {', '.join(profile_names())}")
    rules = [(r, _rule_found(r)) for r in PROFILES[profile_id]]
    out, arrays = None, [c for _, c in rules if c is not None]
    if arrays:
        none = F.array().cast("array<struct<field_id:string,category:string,primitive:string,m:struct<text:string,raw:string,severity:string,validators:array<string>,start:int,length:int>>>")
        some = spans.withColumn("_p", F.explode(F.concat(*[F.coalesce(c, none) for c in arrays])))
        found = detections(some, F.array(F.col("_p.m")), "", "", "", raw, keep=("_p",))
        out = found.withColumns({c: F.col(f"_p.{c}") for c in ("field_id", "category", "primitive")}).drop("_p")
    for rule, column in rules:
        if column is None:
            found = get(rule.primitive)(spans, raw=raw).withColumn("field_id", F.lit(rule.field_id)).withColumn("category", F.lit(rule.category))
            out = found if out is None else out.unionByName(found)
    return out


def precise(found: DataFrame) -> DataFrame:
    """Without bank identifiers that look like amounts; needs raw values."""
    return found.where(~((F.col("category") == "bank_identifiers") & text.is_currency(F.col("raw"))))


def strict(found: DataFrame) -> DataFrame:
    """Hits of full confidence."""
    return found.where((F.col("confidence") >= 1.0) & (F.col("severity") == "hit"))
