"""Patterns find what they find in the SQL's engine."""

import duckdb
import pytest
from pyspark.sql import functions as F

from storyloom.functions import quality, text
from storyloom.plans.quality import matches

ODD = ["édeal", "dealé", "deals", "ſhopping", "aſhopping", "home\rcash", "home\ncash", "you\x0bshould", "you should", "3 productſ", "é3 ways", "gifts ſhe'll love", "x0% intro apr", "é0% intro apr", "Associated Preſs", "éap", "٣deal", "", None]


@pytest.mark.parametrize("patterns", [quality.SERVICE_PATTERNS, quality.FINANCE_PATTERNS, quality.WIRE_PATTERNS, quality.AGGREGATOR_PATTERNS])
def test_patterns(spark, patterns):
    made = spark.createDataFrame(list(enumerate(ODD)), "id int, text string").select("id", quality.any_of(F.col("text"), patterns).alias("found"))
    con = duckdb.connect()
    con.execute("CREATE TABLE odd (id INT, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", list(enumerate(ODD)))
    assert sorted(map(tuple, made.collect())) == con.execute(f"SELECT id, {matches('text', patterns)} FROM odd ORDER BY id").fetchall()


@pytest.mark.parametrize("pattern", [r"\bBen Sasse\b", r"[\s/-]a\\b", r"\bmarch\s+(20[0-9]{2})\b"])
@pytest.mark.parametrize("value", ["éBen Sasse", "Ben ſasse", "xBen Sasse", "\x0ba\\b", "/a\\b", "émarch 2023", "march\x0b2023"])
def test_any_case(spark, pattern, value):
    found = spark.range(1).select(F.lit(value).rlike(text.as_re2(pattern, True))).first()[0]
    assert found == duckdb.execute("SELECT regexp_matches(?, ?)", [value, "(?i)" + pattern]).fetchone()[0]
