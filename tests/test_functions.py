from pyspark.sql import functions as F

from tidemark.functions import compat as C
from tidemark.plans import dialect
from tidemark.plans import statements as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_casts_give_null_where_they_fail(spark):
    assert one(spark, C.cast_or_null(F.lit("3.7"), "int")) == 3
    assert one(spark, C.cast_or_null(F.lit("hello"), "int")) is None
    assert one(spark, C.cast_or_null(F.lit("1"), "bool")) is True
    assert one(spark, C.cast_or_null(F.lit("yes"), "bool")) is False
    assert one(spark, C.cast_or_null(F.lit("oops"), "timestamp")) is None


def test_text_functions(spark):
    assert one(spark, C.length_bytes(F.lit("é€"))) == 5
    assert one(spark, C.trim_all(F.lit(" \t x y \n"))) == "x y"
    assert one(spark, C.substring_clamped(F.lit("abcdef"), -3, 2)) == "ab"
    assert one(spark, C.left_n(F.lit("abc"), -1)) == ""
    assert one(spark, C.mod_or_null(F.lit(7), F.lit(0))) is None
    assert one(spark, C.json_path(F.lit('{"a": {"b c": 1}}'), "a", "b c")) == "1"


def test_integer_average_truncates(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert df.agg(C.avg_int("x").alias("a")).first()["a"] == 1
    assert df.where("x > 9").agg(C.avg_int("x").alias("a")).first()["a"] is None


def test_statements():
    assert S.normalise("SELECT  'a  b'\n ;") == "SELECT 'a  b'"
    assert S.as_of("SELECT 1 FROM t AS OF LSN 7 WHERE x") == ("SELECT 1 FROM t  WHERE x", 7, None)
    assert dialect.expression("meta->'a'->>'b' = 'x'") == r"get_json_object(meta, '$[\'a\'][\'b\']') = 'x'"
    assert S.inline("a = $1 AND b = '$1'", {"1": "o'x"}) == "a = 'o''x' AND b = '$1'"
    assert S.parse("DELETE FROM t WHERE a = ' WHERE '")[1]["where"] == "a = ' WHERE '"
