"""Text functions against their stated rules."""

import pytest
from pyspark.sql import functions as F

from korpusline.functions import text as tx
from korpusline.functions import vectors as vc


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f("t").alias("x")).first().x


@pytest.mark.parametrize(
    "line,expected",
    [("1. Общие", True), ("1.2.3 Порядок", True), ("Раздел 2 Цены", True), ("ГЛАВА 3 Сроки", True), ("ПРИЛОЖЕНИЕ", True), ("3000 тонн цемента", True), ("abc", False), ("1.", False), (None, False), ("", False)],
)
def test_is_heading(spark, line, expected):
    assert one(spark, line, tx.is_heading) is expected


@pytest.mark.parametrize("line,depth,number", [("1. Общие", 0, "1"), ("1.2.3 Порядок", 2, "1.2.3"), ("Раздел 2 Цены", 0, "2"), ("Общие", 0, None)])
def test_depth_and_number(spark, line, depth, number):
    assert one(spark, line, tx.heading_depth) == depth
    assert one(spark, line, tx.section_number) == number


def test_tokens_words_path(spark):
    assert one(spark, "Ёлка,  café №5", tx.tokens) == ["елка", "caf", "5"]
    assert one(spark, None, tx.tokens) == []
    assert one(spark, "Ёлка café_1", tx.words) == ["ёлка", "café_1"]
    assert one(spark, r"data\ПТО/akt_v1.1-2022.pdf", tx.path_text) == "data ПТО akt v1 pdf"


def test_sentences_keep_digits(spark):
    assert one(spark, "1. Раз два. Три 4\n5! Шесть", tx.sentences) == ["1.", "Раз два.", "Три 4", "5!", "Шесть"]
    assert one(spark, None, tx.sentences) == []
    assert one(spark, " \n ", tx.sentences) == []


def test_doc_key(spark):
    rows = spark.createDataFrame([(None, "", "p"), ("", None, None), ("a", "d", "p")], "category string, doc_id string, doc_path string")
    assert [r.k for r in rows.select(tx.doc_key().alias("k")).collect()] == ["UNK::p", "UNK::doc", "a::d"]


def test_references(spark):
    assert one(spark, "2 см. глава 2 и пункт 1.1", tx.references) == ["1.1"]
    assert one(spark, "см. глава 2", tx.references) == []


def test_smart_truncate(spark):
    assert one(spark, "Раз два три. Четыре пять. Шесть семь восемь.", lambda c: tx.smart_truncate(c, 5)) == "Раз два три."
    assert one(spark, "абвгдежз" * 10, lambda c: tx.smart_truncate(c, 2)) == "абвгдежз"
    assert one(spark, "мало", lambda c: tx.smart_truncate(c, 5)) == "мало"


def test_section_id_and_level(spark):
    rows = spark.createDataFrame([(None,), ([],), (["Общие сведения о предмете", "1.2 Цены"],), (["Общие сведения о предмете"],)], "h array<string>")
    got = rows.select(tx.section_id("h").alias("s"), tx.hierarchy_level("h").alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [("root", 0), ("root", 0), ("1.2", 2), ("Общие_сведения_о_пре", 0)]


def test_encode_is_unit_and_null_safe(spark):
    rows = spark.createDataFrame([("бетон бетон щебень",), (None,), ("",)], "t string").select(vc.encode("t").alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-9
    assert not any(rows[1].v) and not any(rows[2].v)


def test_word_hit_ratio(spark):
    rows = spark.createDataFrame([("Бетон вода", "ж/б бетонный")], "q string, c string")
    assert rows.select(tx.word_hit_ratio("q", "c").alias("x")).first().x == 0.5


def test_row_text_leaves_nulls_out(spark):
    rows = spark.createDataFrame([("1", None)], "a string, b string")
    assert rows.select(tx.row_text({"A": F.col("a"), "B": F.col("b")}).alias("x")).first().x == "A: 1"
