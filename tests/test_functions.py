"""Scalar functions on the FIXTURES.md edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import clean as CL
from tidemark.functions import dates as DT
from tidemark.functions import text as TX

D = dt.date


def one(spark, expr, schema="x string", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_price_parsing(spark):
    rows = [("1,200",), ("abc",), ("",), ("  300　",), (None,)]
    assert one(spark, CL.to_number("x"), rows=rows) == [None, None, None, 300.0, None]
    assert one(spark, CL.to_number("x", strip_commas=True), rows=rows) == [1200.0, None, None, 300.0, None]
    assert one(spark, CL.to_long("x"), rows=rows) == [1200, None, None, 300, None]


def test_lenient_dates(spark):
    rows = [("2024-02-30",), ("2024-13-01",), ("2024-02-29",), ("x",)]
    assert one(spark, CL.to_date_lenient("x"), rows=rows) == [None, None, D(2024, 2, 29), None]


def _dates(spark, rule, legacy, rows):
    df = spark.createDataFrame(rows, "y int, m int, w int")
    return [r[0] for r in df.select(DT.week_to_date("y", "m", "w", rule, legacy)).collect()]


def test_first_monday_rule(spark):
    rows = [(14, 3, 1), (14, 3, 2), (14, 3, 3), (14, 7, 1), (18, 3, 4), (14, 13, 1), (14, 7, None),
            (20, 9, 5)]
    got = _dates(spark, "first_monday", 18, rows)
    assert got[:5] == [D(2014, 3, 5), D(2014, 3, 15), D(2014, 3, 25), D(2014, 7, 7), D(2018, 3, 26)]
    assert got[5] is None and got[6] is None
    assert got[7] == D(2020, 10, 5)  # week 5 runs past the month end (first Monday 2020-09-07 + 28)
    # legacy_before=2018 → months 1–6 always take 5/15/25
    assert _dates(spark, "first_monday", 2018, [(18, 3, 4)]) == [D(2018, 3, 25)]


def test_block_rule(spark):
    rows = [(14, 7, 1), (18, 3, 4), (20, 8, 5), (20, 8, None), (14, 3, None), (20, 8, 0)]
    got = _dates(spark, "block", 18, rows)
    assert got == [D(2014, 7, 1), D(2018, 3, 22), D(2020, 8, 28), D(2020, 8, 1), D(2014, 3, 25), None]


def test_category_splits_keep_null(spark):
    df = spark.createDataFrame([("その他",), ("ガシャポン",), (None,)], "c string")
    assert df.where(CL.ne_keep_null("c", "その他")).count() == 2
    assert df.where(CL.eq("c", "ガシャポン")).count() == 1


def test_survey_date_forms(spark):
    df = spark.createDataFrame([("2021年2月", "平成28年12月", "2021年 02月")], "k string, h string, f string")
    r = df.select(*DT.split_year_month("k"), *DT.heisei_year_month("h"), *DT.fixed_year_month("f")).first()
    assert tuple(r) == (2021, 2, 2016, 12, 2021, 2)


def test_unicode_space_split(spark):
    df = spark.createDataFrame([("　a  b　c　",)], "t string")
    assert df.select(TX.whitespace_fields("t")).first()[0] == ["a", "b", "c"]


def test_url_pattern_stops_at_hash_and_tilde(spark):
    df = spark.createDataFrame([("see https://x.example.com/a?b=1#frag and http://y.example.org/~user ok",)],
                               "t string")
    assert df.select(TX.find_urls("t")).first()[0] == ["https://x.example.com/a?b=1",
                                                       "http://y.example.org/"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\n \n　\nb", "p?id=201407", "x/y\\z", "1,200円", "再入荷")],
                               "t string, u string, s string, p string, r string")
    r = df.select(TX.drop_blank_lines("t"), TX.after_equals("u"), TX.basename("s"),
                  TX.before_yen("p"), TX.is_restock("r"), TX.safe_sheet_name("s"),
                  TX.mean_count_label(F.lit(1234.56), F.lit(3))).first()
    assert r[0] == "a\nb" and r[1] == "201407" and r[2] == "z" and r[3] == "1,200" and r[4] is True
    assert r[5] == "x_y_z" and r[6] == "1234.6円\n(3件)"
    assert df.select(TX.after_equals(F.lit("no-equals"))).first()[0] is None
