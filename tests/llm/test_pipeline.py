"""The corpus pipeline: what each stage keeps, against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kinfold.llm import common, packing, quality
from tests.llm.helpers import CLASHING, SPACED, messy
from tests.llm.test_formats import brute_places
from tests.llm.test_joins import brute_components, brute_dedup, brute_keep_one, brute_leaks


def ids_and_texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def as_written(docs):
    """As the next stage reads it."""
    return common.materialize(docs, "stage")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in cp.STAGES[:-1]:
        before = ids_and_texts(docs)
        scored = quality.score_quality(docs, labels) if name == "quality" else None
        docs = as_written(stage(spark, docs, sf))
        assert docs.columns == columns
        after = dict(ids_and_texts(docs))
        if name == "quality":
            assert set(after) == {r["doc_id"] for r in scored.where("score >= 0.7").collect()} and 0.6 * len(before) < len(after) < len(before)
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c, _ in brute_components(before)}
        if name == "passages":
            left = {d: sha for d, _, _, sha in brute_dedup(before)}
            old = dict(before)
            assert set(after) == set(left)
            assert all(after[d] == old[d] or hashlib.sha256(after[d].encode()).hexdigest() == left[d] for d in after)
            assert all(hashlib.sha256(" ".join(re.findall(SPACED, after[d])).encode()).hexdigest() == left[d] for d in after)
        if name == "benchmark":
            assert set(after) == {r[0] for r in brute_leaks(before, bench) if not r[-1]}
    check_packing_stage(spark, docs, sf)


def check_packing_stage(spark, docs, sf):
    """Every piece where a plain deficit round-robin puts it."""
    pieces = cp.packing_stage(spark, docs, sf).collect()
    tokens = packing.tokenize(docs, "doc_id", "text", "source", packing.default_vocabulary()).collect()
    want = brute_places([(r["source"], r["part"], r["at"], r["n"]) for r in tokens])
    got = sorted((r["sequence_id"] * packing.SEQUENCE + r["offset"], r["length"], r["source"]) for r in pieces)
    flat = [s for _, n, s in got for _ in range(n)]
    assert flat == want and [p for p, _, _ in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]


def test_stages_on_messy_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, one id with several texts, clashing columns: values come back as they were."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = messy(spark)
    df = df.unionByName(df.where("doc_id = 7").withColumns({"doc_id": F.lit(2).cast("long"), "text": F.lit("another text of the same id"), "n_chars": F.lit(27)}))
    stages = dict(cp.STAGES)
    for name, stage in cp.STAGES[:-1]:
        rows = df.collect()
        out = as_written(stage(spark, df, str(tmp_path)))
        assert out.columns == df.columns and out.dtypes == df.dtypes
        mark = lambda r: tuple(r[c] for c in ("doc_id", "lang", "source", *CLASHING))
        marks = {mark(r): r for r in rows}
        assert all(mark(r) in marks for r in out.collect())
        same = [r for r in out.collect() if r["text"] == marks[mark(r)]["text"]]
        if name != "passages":
            assert len(same) == out.count()
        assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    kept = ids_and_texts(stages["near_duplicates"](spark, df, str(tmp_path)))
    assert sorted(kept, key=str) == brute_keep_one(ids_and_texts(df))
    cut = {(r["doc_id"], r["part"]): r["text"] for r in stages["passages"](spark, df, str(tmp_path)).collect()}
    assert len(cut) == df.select("doc_id", "part").distinct().count()
    leaks = brute_leaks(ids_and_texts(df), [(1, "one two"), (2, None)])
    assert sorted(map(str, (d for d, _ in ids_and_texts(stages["benchmark"](spark, df, str(tmp_path)))))) == sorted(str(r[0]) for r in leaks if not r[-1])
    check_packing_stage(spark, df, str(tmp_path))
    assert stages["packing"](spark, df.limit(0), str(tmp_path)).count() == 0


def test_run_and_release(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    common.release(spark)
    with pytest.raises(Exception, match="(?i)exist|no such"):
        out.count()
