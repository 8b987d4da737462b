"""The pipeline, stage by stage, against each operator's brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quaystone.llm.quality import fit_quality, score_quality
from quaystone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "mixture"]
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixture":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3] and sizes[5] == sizes[4]
    lines = spark.read.parquet(f"{tmp_path}/lines")
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/near").collect()}
    from tests.llm.test_operators import brute_near, fill, words

    assert kept == {d for d, (_, _, k) in brute_near([(r["doc_id"], r["text"]) for r in lines.collect()]).items() if k}
    # benchmark: no kept document holds three quarters of an item, every other one does
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(words(t, True))
    items = [g for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (g := grams(r["text"]))]
    clean = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/near").collect() if not any(100 * len(grams(r["text"]) & g) >= 75 * len(g) for g in items)}
    left = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/benchmark").collect()}
    assert left.keys() == clean
    # mixture: every source at its target
    sizes, taken = {}, {}
    for r in spark.read.parquet(f"{tmp_path}/mixture").collect():
        source = left[r["doc_id"]]["source"]
        assert r["size"] == len(words(left[r["doc_id"]]["text"]))
        sizes[source], taken[source] = sizes.get(source, 0) + r["size"], taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in fill(sizes).items())
    # quality: what the fitted model, tested against brute force elsewhere, accepts
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    accepted = {r["doc_id"] for r in score_quality(docs, fit_quality(docs, labels)).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/quality").collect()} == accepted


def test_run(spark):
    from quaystone.llm.common import children
    from quaystone.sources.scratch import owned, scratch_dir

    folder = f"{scratch_dir(spark)}/quaystone"
    before = set(children(spark, folder))
    with owned():
        rows = corpus_pipeline.run(spark, SF).collect()
        left = set(children(spark, folder)) - before
        # the last stage's result alone is left of all that the stages stored
        assert len(left) == 1 and children(spark, f"{folder}/{left.pop()}") == ["4-mixture"]
    assert set(children(spark, folder)) == before
    assert rows and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) < 50


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == len(rows)
