"""The pipeline, stage by stage against brute force on what each stage was given."""

import hashlib
import random

import pytest

import corpus_pipeline
from sievelight.llm.shared import written

from . import test_line_dedup, test_minhash, test_mixing, test_packing
from .test_quality import text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("repeated", [False, True])
def test_stages(spark, tmp_path, repeated):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        body = text(rng, i % 5 > 0)
        if i % 4 == 0:
            body += "\nThis passage of more than five words stands in many documents"
        rows.append((i, body, "en", rng.choice(["a", "b", None]), len(body)))
    rows += [(500 + k, rows[k][1] + " tail" * (k % 2), "en", "a", 0) for k in range(1, 60, 3)] + [(900, None, None, None, None), (901, "", None, "a", 0)]
    if repeated:
        rows += [(i, t, "en", s, len(t)) for i, t, s in ((None, rows[8][1], "a"), (None, text(rng, True), "b"), (2, text(rng, True), "a"), (2, rows[2][1], "a"))]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given = rows
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)))
        got = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality":
            assert set(got) < set(given) and 100 < len(got) < 180
        elif name == "line_dedup":
            want = []
            for i, t, gone in test_line_dedup.brute([r[:2] for r in given]):
                left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
                if left is None or left.split() or not gone:
                    want.append((i, left))
            assert sorted((r[:2] for r in got), key=repr) == sorted(want, key=repr)
            assert all(r[4] == len(r[1]) for r in got if r[1] and r[0] is not None and r[0] < 500)
        elif name == "minhash":
            # Rows are numbered in the order of ids and of texts' md5, as their own ids need not differ.
            rows_ = sorted((r[:2] for r in given), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.md5((r[1] or "").encode()).hexdigest()))
            kept = {k for k, _, _, stays in test_minhash.brute([(k, t) for k, (_, t) in enumerate(rows_)]) if stays}
            assert sorted((r[:2] for r in got), key=repr) == sorted((rows_[k] for k in kept), key=repr)
        elif name == "mixing":
            times = test_mixing.brute([(r[0], r[1], r[3]) for r in given])
            if not repeated:
                assert sorted(r[0] for r in got) == sorted(i for i, (_, _, c) in times.items() for _ in range(c))
            assert {r[:2] for r in got} <= {r[:2] for r in given}
        else:
            test_packing.check([r[:2] for r in given], out.collect(), (512, 1024, 2048, 4096))
            assert sum(len(r["input_ids"]) for r in out.collect()) == sum(len(test_packing.plain()(r[1])) for r in given)
        docs, given = out, got


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
