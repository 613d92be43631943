"""The corpus pipeline on small documents."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from storyloom.llm.common import written

WORDS = ["".join(np.random.default_rng(k).choice(list("abcdefgh"), 6)) for k in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_stages(spark, tmp_path):
    line = "this very line stands in many documents"
    rows = [(k, f"{line}\n{prose(80, k)}", "en", "s", k, "more") for k in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0, None), (101, "12 34", None, None, None, None), (102, None, "en", "s", None, None), (103, f"{prose(40, 500)} {prose(60, 900)}", "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, prose(60, 900))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["language_id"]) == {*range(30), 100, 103}
    assert sum(line in r["text"] for r in seen["line_dedup"].values()) == 1 and all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values())
    assert set(seen["minhash_dedup"]) == {*range(30), 103}
    assert set(seen["benchmark_decontamination"]) == set(range(30))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(range(30))
