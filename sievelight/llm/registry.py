"""Queries of this subpackage and the SQL of those that SQL can express."""

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run

from .fertility import op9_fertility

from .line_dedup import OP10_SQL, op10_line_dedup
from .lm_score import op1_lm_score
from .minhash import OP5_SQL, op5_minhash
from .mixing import OP8_SQL, op8_mixing
from .packing import op4_packing
from .quality import op3_quality
from .spotsigs import op7_spotsigs
from .sstable import op6_sstable
from .url_filter import op2_url_filter

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_minhash": op5_minhash,
    "op6_sstable": op6_sstable,
    "op7_spotsigs": op7_spotsigs,
    "op8_mixing": op8_mixing,
    "op9_fertility": op9_fertility,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": run,
}
SQL: dict[str, str] = {k: v for k, v in {"op5_minhash": OP5_SQL, "op8_mixing": OP8_SQL, "op10_line_dedup": OP10_SQL, "pipeline": PIPELINE_SQL}.items() if v}
