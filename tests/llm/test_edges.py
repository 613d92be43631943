"""All operators on nulls, empty and very long texts, ties, repeated rows, empty tables, and columns that clash with theirs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import decontaminate, html_text, language, line_dedup, minhash, packing, substrings, token_file, topk, toxicity
from storyloom.llm.common import new_folder

WORDS = ["".join(np.random.default_rng(k).choice(list("abcdefgh"), 6)) for k in range(300)]
#: Names that the operators use themselves, or return.
CLASHING = ["node", "hash", "words", "value", "start", "score", "component_id", "rank", "task", "key", "labelled", "host", "item_id", "shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LONG = [(50, prose(20_000, 1)), (51, "x" * 1_000_000), (52, "a line of a million characters " * 33_000), (53, "\n" * 100_000)]
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, prose(60, 2)), (5, prose(60, 3)), (6, prose(60, 2)), (None, prose(60, 2)), (None, None), (7, "\u00b2 \u00bd \u2167"), (-8, "\x00 \ud7ff \U0001f600 <|endoftext|>")]


def docs_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None) for i, t in rows], SCHEMA)
    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def items_of(spark):
    return spark.createDataFrame([(1, prose(60, 2)), (None, "x"), (2, None), (3, "one")], "item_id long, text string").withColumn("distance", F.lit(1)).withColumn("doc_id", F.lit(2))


def labels_of(spark):
    return spark.createDataFrame([(5, 1), (6, 0), (None, 1), (4, None), (50, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))


def files(spark, docs):
    path = new_folder(spark, "files")
    token_file.write_token_files(docs, path)
    return token_file.read_token_files(spark, path)


EACH_ROW = {
    "toxicity": lambda spark, docs: toxicity.score_toxicity(docs, toxicity.learned(docs, labels_of(spark))),
    "minhash": lambda spark, docs: minhash.near_duplicates(docs, 4),
    "token_file": files,
    "line_dedup": lambda spark, docs: line_dedup.dedup_lines(docs),
    "language": lambda spark, docs: language.identify(docs, language.learned(docs, F.lit(True))),
}
OTHERS = {
    "packing": lambda spark, docs: packing.pack_documents(docs),
    "substrings": lambda spark, docs: substrings.repeated_passages(docs),
    "decontaminate": lambda spark, docs: decontaminate.find_leaks(docs, items_of(spark)),
}


@pytest.mark.parametrize("name", sorted(EACH_ROW))
def test_a_row_for_each_row(spark, name):
    run = EACH_ROW[name]
    ids = sorted((str(i) for i, _ in ODD + LONG))
    assert sorted(str(r["doc_id"]) for r in run(spark, docs_of(spark, ODD + LONG)).collect()) == ids
    assert run(spark, docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_other_rows(spark, name):
    run = OTHERS[name]
    found = run(spark, docs_of(spark, ODD + LONG)).collect()
    ids = {r["doc_id"] for r in found}
    wanted = {"packing": {i for i, _ in ODD + LONG}, "substrings": {6}, "decontaminate": {4, 5, 6, None}}[name]
    assert ids == wanted or name == "substrings" and 6 in ids | {r["other_id"] for r in found} and ids <= {5, 6}
    assert run(spark, docs_of(spark, [])).count() == 0


def test_stages_keep_columns_and_rows(spark, tmp_path):
    docs = docs_of(spark, ODD + LONG)
    items_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            found = stage(spark, rows, str(tmp_path))
            assert found.columns == docs.columns and found.count() <= rows.count(), name
    # An empty benchmark leaks nowhere.
    none = items_of(spark).limit(0)
    assert decontaminate.without_leaks(docs, none).count() == len(ODD + LONG)


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [2.0, 1.0]), (4, [2.0, 1.0]), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("clash").alias(c) for c in ("weights", "block", "score", "rank", "query_id")))
    found = topk.top_k(vectors, F.col("vec_id") == 0, 2)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()} == {(0, 1, 3), (0, 2, 4)}
    assert topk.top_k(vectors.limit(0), F.col("vec_id") == 0, 2).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/x", None), (1, "http://a/x", None), (2, None, "<p>" + "w " * 500_000), (None, "http://a/y", "<article>t")], "page_id long, url string, html string")
    pages = pages.select("*", *(F.lit("clash").alias(c) for c in ("host", "words", "runs", "part", "n_chars")))
    assert sorted(str(r["page_id"]) for r in html_text.main_texts(pages).collect()) == ["1", "1", "2", "None"]
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_pairs_at_the_very_similarity(spark):
    """Sets that share 80 of 100 shingles are linked, those that share 79 of 101 aren't."""
    rows = []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(93)]
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join([*words[:83], *(f"o{k}x{i}" for i in range(10))])))
        words = [f"v{k}x{i}" for i in range(93)]
        rows.append((10 * k + 2, " ".join(words)))
        rows.append((10 * k + 3, " ".join([*words[:82], *(f"q{k}x{i}" for i in range(11))])))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows), 4).collect()}
    assert all(found[10 * k + 1] == 10 * k and found[10 * k + 3] == 10 * k + 3 for k in range(40))


def test_near_passages_are_found(spark):
    """Passages of 60 words, one of which is another in every copy (similarity 51/61): at least 9 of 10 are found, and texts without any stay alone."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        passage = [f"p{k % 20}x{i}" for i in range(60)]
        if k >= 20:
            passage[rng.integers(8, 52)] = f"c{k}"
        rows.append((k, f"{' '.join(f'a{k}x{i}' for i in range(80))} {' '.join(passage)} {' '.join(f'b{k}x{i}' for i in range(70))}"))
    rows += [(100 + k, " ".join(f"z{k}x{i}" for i in range(150))) for k in range(20)]
    found = substrings.repeated_passages(docs_of(spark, rows)).collect()
    hit = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    assert len(hit & set(range(60))) >= 54 and not hit & set(range(100, 120))
