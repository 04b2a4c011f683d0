"""Deterministic inputs from the driver's keyed tables, by expressions that Spark and DuckDB read alike.

Natural documents hold few identifiers, so statement lines, OCR words, photo boxes and the like are made from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import spans as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad(value: str, width: int) -> str:
    return f"lpad(CAST({value} AS STRING), {width}, '0')"


def letter(value: str, of: str = "ABCEGHJKLMNOPRSTWXYZ") -> str:
    return f"substr('{of}', CAST(({value}) % {len(of)} + 1 AS INT), 1)"


K = "c_custkey"
#: Published test numbers, and one that fails the checksum.
CARDS = ["4242 4242 4242 4242", "4111-1111-1111-1111", "5555555555554444", "378282246310005", "6011 1111 1111 1117", "4242 4242 4242 4243", "3530 1113 3330 0000", "4O12 8888 8888 1881", "**** **** **** 4242", "4222 2222 2222 2"]
CARD = f"CASE {K} % {len(CARDS)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CARDS)) + " END"
KINDS = [
    f"'Sort code: ' || {pad(f'{K} % 90 + 10', 2)} || '-' || {pad(f'{K} * 7 % 100', 2)} || '-' || {pad(f'{K} * 13 % 100', 2)}",
    f"'Ref ' || {pad(f'{K} % 90 + 10', 2)} || '-' || {pad(f'{K} * 7 % 100', 2)} || '-' || {pad(f'{K} * 13 % 1000', 3)} || ' de' || 'SC' || 'ription'",
    f"'Account number ' || {pad(f'{K} * 7919 % 100000000', 8)}",
    f"'Transfer ' || {pad(f'{K} * 7919 % 100000000', 8)} || ' to 1' || {pad(f'{K} * 104729 % 100000000', 8)}",
    f"'IBAN GB' || {pad(f'{K} % 100', 2)} || ' BOFS ' || {pad(f'{K} % 10000', 4)} || ' ' || {pad(f'{K} * 31 % 10000', 4)} || ' ' || {pad(f'{K} * 37 % 10000', 4)}",
    f"'NI number ' || {letter(f'{K} * 3')} || {letter(f'{K} * 7')} || {pad(f'{K} * 99991 % 1000000', 6)} || {letter(f'{K}', 'ABCDE')}",
    f"'NHS no ' || {pad(f'{K} * 17 % 1000', 3)} || ' ' || {pad(f'{K} * 19 % 1000', 3)} || ' ' || {pad(f'{K} * 23 % 10000', 4)}",
    f"'Driving licence ' || {letter(f'{K}')} || {letter(f'{K} * 3')} || {letter(f'{K} * 7')} || {letter(f'{K} * 11')} || '9' || {pad(f'{K} * 99991 % 1000000', 6)} || {letter(f'{K} * 13')} || '9' || {pad(f'{K} % 100', 2)}",
    f"'Passport number ' || {pad(f'{K} * 7919 % 1000000000', 9)}",
    f"'Flat ' || CAST({K} % 30 AS STRING) || ', 10 High Street, London SW' || CAST({K} % 10 AS STRING) || ' ' || CAST({K} * 3 % 10 AS STRING) || {letter(f'{K}')} || {letter(f'{K} * 3')}",
    f"'valid thru ' || {pad(f'{K} % 14', 2)} || '/' || {pad(f'{K} * 7 % 100', 2)}",
    f"'Card number ' || {CARD} || ' thanks'",
    f"'Paid with ' || {CARD} || ', order ' || CAST({K} AS STRING)",
    f"'£' || CAST({K} % 9 + 1 AS STRING) || ',' || {pad(f'{K} * 7 % 1000', 3)} || '.00'",
    f"'P<GBR' || {letter(f'{K}')} || {letter(f'{K} * 3')} || '<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<' || chr(10) || ' ' || {pad(f'{K} * 7919 % 1000000000', 9)} || 'gbr<<<<<<<<<<<<<<<<<<<<<<<<<<0' || chr(10) || 'x'",
    f"'Document ' || {letter(f'{K}')} || {letter(f'{K} * 3')} || ' ' || {pad(f'{K} * 7919 % 1000000', 6)} || ' issued'",
]
STATEMENT = f"CASE {K} % {len(KINDS)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(KINDS)) + " END"
STATEMENT_COLUMNS = [f"{K} AS doc_id", "CAST(0 AS BIGINT) AS span_id", f"{STATEMENT} AS text", f"CASE WHEN {K} % 3 = 0 THEN 'ocr' ELSE 'text' END AS source", f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE CAST({K} % 10 AS DOUBLE) / 10 END AS ocr_conf"]
STATEMENT_SQL = f"SELECT {', '.join(STATEMENT_COLUMNS)} FROM customer"


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement line per customer, as spans."""
    y = "CAST(c_custkey % 100 AS DOUBLE)"
    box = f"named_struct('x0', 0D, 'y0', {y}, 'x1', 10D, 'y1', {y} + 1) AS bbox"
    return table(spark, sf_dir, "customer").selectExpr(*STATEMENT_COLUMNS, box, "0 AS page", "'line' AS span_kind")


#: Lines of documents and statement lines together; the latter have negative ids, so they never meet those of documents.
ALL_SPANS_SQL = f"""
SELECT doc_id, span_id, text, 'text' AS source, CAST(NULL AS DOUBLE) AS ocr_conf FROM (
  SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS span_id, regexp_replace(unnest(s), '^\\s+|\\s+$', '', 'g') AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)) WHERE text <> ''
UNION ALL SELECT -1 - doc_id, span_id, text, source, ocr_conf FROM ({STATEMENT_SQL})
"""


def all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.line_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.unionByName(statement(spark, sf_dir).withColumn("doc_id", -1 - F.col("doc_id")))


#: OCR words from order lines: four-digit groups, some with look-alikes, on lines that wobble.
GROUPS = ["4242", "4242", "4242", "4242", "4111", "1111", "123%", "Sb78", "9O17", "text", "l2", "55S5"]
WORD = f"CASE WHEN l_orderkey % 5 = 0 THEN '4242' WHEN l_orderkey % 5 = 1 THEN CASE l_linenumber WHEN 1 THEN '4000' WHEN 2 THEN '123%' WHEN 3 THEN 'Sb78' ELSE '9017' END ELSE CASE (l_partkey + l_linenumber) % {len(GROUPS)} " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GROUPS)) + " END END"
X0, Y0 = "CAST(l_linenumber * 45 + l_partkey % 3 + (CASE WHEN l_suppkey % 17 = 0 THEN 60 ELSE 0 END) AS DOUBLE)", "CAST((l_partkey % 4) * 3 + (CASE WHEN l_suppkey % 11 = 0 THEN 30 ELSE 0 END) AS DOUBLE)"
#: A line's number is no key of an order's lines, so words are numbered in their order. All lines are words.
WORD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
WORD_COLUMNS = ["l_orderkey AS doc_id", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(WORD_ORDER)}) AS BIGINT) AS span_id", f"{WORD} AS text", f"{X0} AS x0", f"{Y0} AS y0", f"{X0} + 40 AS x1", f"{Y0} + 20 AS y1", "0 AS page", "'ocr' AS source", "CAST(l_partkey % 11 AS DOUBLE) / 10 AS ocr_conf"]
WORDS_SQL = f"SELECT {', '.join(WORD_COLUMNS)} FROM lineitem"


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*WORD_COLUMNS)
    return rows.select("doc_id", "span_id", "text", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "page", "source", "ocr_conf", F.lit("word").alias("span_kind"))


#: Turns of conversations with a card number planted in each.
TURN = f"text || ' card ' || CASE (conv_id + turn) % {len(CARDS)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CARDS)) + " END || ' thanks'"
TURNS_SQL = f"SELECT conv_id, turn, {TURN} AS text FROM conversations"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{TURN} AS text")


#: Photos, one per order: size, blur, occlusion, flags.
PHOTO_COLUMNS = ["o_orderkey AS doc_id", "0 AS page", "CAST(600 + o_custkey % 7 * 50 AS INT) AS width", "CAST(400 + o_custkey % 5 * 31 AS INT) AS height", "o_orderkey % 4 <> 0 AS card_candidate_present", "CAST(o_custkey % 60 AS DOUBLE) AS blur_score", "o_custkey % 7 = 0 AS occlusion_suspected", "o_orderkey % 9 = 0 AS force_band_redact", "CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS hits_remaining"]
PHOTOS_SQL = f"SELECT {', '.join(PHOTO_COLUMNS)} FROM orders"


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*PHOTO_COLUMNS)


#: Detections on photos, from order lines.
FOUND_COLUMNS = [
    "l_orderkey AS doc_id",
    "CASE l_partkey % 6 WHEN 0 THEN 'card_pan' WHEN 1 THEN 'card_expiry' WHEN 2 THEN 'mrz' WHEN 3 THEN 'id_number' ELSE 'card_pan' END AS field_id",
    "CASE WHEN l_suppkey % 3 = 0 THEN 'hit' ELSE 'suspicion' END AS severity",
    "CASE l_suppkey % 4 WHEN 0 THEN 'visual' WHEN 1 THEN 'roi_ocr' ELSE 'ocr' END AS source",
]
FOUND_SQL = f"SELECT {', '.join(FOUND_COLUMNS)} FROM lineitem"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*FOUND_COLUMNS)


#: Detector boxes on photos.
BOX_COLUMNS = ["l_orderkey AS doc_id", "0 AS page", "CASE l_partkey % 7 WHEN 0 THEN 'card' WHEN 1 THEN 'id_card' WHEN 2 THEN 'pan' WHEN 3 THEN 'expiry' WHEN 4 THEN 'mrz' WHEN 5 THEN 'id_number' ELSE 'face' END AS label", "CAST(l_quantity AS DOUBLE) / 50 AS conf", "CAST(l_partkey % 100 AS DOUBLE) AS x1", "CAST(l_suppkey % 100 AS DOUBLE) AS y1", "CAST(l_partkey % 100 + 200 AS DOUBLE) AS x2", "CAST(l_suppkey % 100 + 80 AS DOUBLE) AS y2"]
BOXES_SQL = f"SELECT {', '.join(BOX_COLUMNS)} FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*BOX_COLUMNS)


#: OCR results of two regions by engine; all lines are results.
RESULT_COLUMNS = ["l_orderkey AS doc_id", "0 AS page", "CASE WHEN l_suppkey % 2 = 0 THEN 'pan' ELSE 'expiry' END AS roi", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(WORD_ORDER)}) AS INT) AS backend_order", "CASE l_linenumber % 4 WHEN 0 THEN 'apple' WHEN 1 THEN 'paddle' WHEN 2 THEN 'tesseract' ELSE '' END AS engine", "'Card ' || CAST(l_partkey * 7919 AS STRING) || CASE WHEN l_suppkey % 3 = 0 THEN ' 12/34' ELSE '' END AS text", "CAST(l_quantity AS DOUBLE) / 50 AS avg_conf", "l_partkey % 5 <> 0 AS success"]
RESULTS_SQL = f"SELECT {', '.join(RESULT_COLUMNS)} FROM lineitem"


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*RESULT_COLUMNS)


#: What OCR reads in the regions of a photo, by order line: a card number, an expiry date, a machine-readable zone, a document number.
REGION_TEXT = (
    f"CASE l_linenumber % 4 WHEN 0 THEN 'No ' || CASE l_partkey % {len(CARDS)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CARDS)) + f" END WHEN 1 THEN 'valid thru ' || {pad('l_partkey % 14', 2)} || '/' || {pad('l_suppkey * 7 % 100', 2)} "
    f"WHEN 2 THEN CASE WHEN l_partkey % 3 = 0 THEN 'no zone' ELSE 'P<GBR' || {letter('l_partkey')} || '<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<' || chr(10) || {pad('l_partkey * 7919 % 1000000000', 9)} || 'gbr<<<<<<<<<<<<<<<<<<<<<<<<<<0' END ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'No ' || {letter('l_partkey')} || ' ' || {pad('l_partkey * 7919 % 1000000', 6)} ELSE 'no 12' END END"
)
REGION_COLUMNS = ["l_orderkey AS doc_id", "0 AS page", "CASE l_linenumber % 4 WHEN 0 THEN 'pan' WHEN 1 THEN 'expiry' WHEN 2 THEN 'mrz' ELSE 'id_number' END AS roi", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(WORD_ORDER)}) AS INT) AS backend_order", "CASE l_suppkey % 3 WHEN 0 THEN 'apple' WHEN 1 THEN 'paddle' ELSE 'tesseract' END AS engine", f"{REGION_TEXT} AS text", "CAST(l_quantity AS DOUBLE) / 50 AS avg_conf", "l_partkey % 5 <> 0 AS success"]
REGIONS_SQL = f"SELECT {', '.join(REGION_COLUMNS)} FROM lineitem"


def region_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*REGION_COLUMNS)


#: Contour boxes, fourteen to a card, from the keys of parts; some cards are ragged.
CONTOUR_SQL = """
SELECT p_partkey AS doc_id, 0 AS page, CAST(65 + 25 * i + CASE WHEN p_partkey % 5 = 0 THEN p_partkey * i % 23 ELSE p_partkey * i % 3 END AS INT) AS px,
  CAST(60 + CASE WHEN p_partkey % 7 = 0 THEN i * 5 ELSE (p_partkey + i) % 3 END AS INT) AS py, CAST(10 + i % 4 AS INT) AS pw, CAST(12 + (p_partkey + i) % 3 AS INT) AS ph, CAST(120 + i AS DOUBLE) AS contour_area,
  CASE WHEN p_partkey % 11 = 0 THEN 200 ELSE 420 END AS card_w, 260 AS card_h, CAST(109200 AS DOUBLE) AS card_area
FROM part, {SERIES}
"""


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    inner = CONTOUR_SQL.split("SELECT", 1)[1].split("FROM part")[0]
    return rows.selectExpr(*_split(inner))


def _split(columns: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[last:k])
            last = k + 1
    return [*out, columns[last:]]
