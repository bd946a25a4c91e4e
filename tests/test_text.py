"""Column functions, each trap of the data model once."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions import text


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


@pytest.mark.parametrize(("raw", "labels"), [("a | b|c", ["a", "b", "c"]), (" |a||", ["a"]), (None, []), ("", []), ("a\nb", ["a\nb"])])
def test_labels(spark, raw, labels):
    assert one(spark, text.split_labels(F.col("x")), x=raw) == labels


def test_labels_by_other_separators(spark):
    assert one(spark, text.split_labels(F.col("x"), "\n"), x="a\n b\n\n") == ["a", "b"]
    assert one(spark, text.split_labels(F.col("x"), "."), x="a.b") == ["a", "b"]
    assert one(spark, text.join_labels(F.col("x")), x=["a", "", None, "b"]) == "a|b"
    assert one(spark, text.join_labels(F.col("x")), x=[]) == ""


@pytest.mark.parametrize(("a", "b", "want"), [("d", "e", "d"), (None, "e", None), ("", "e", "e"), ("", None, None), ("", "", None)])
def test_description_falls_through_for_empty_strings_only(spark, a, b, want):
    assert one(spark, text.pick_description(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("x", "ok"), [("123456789", False), ("1234567890", True), ("  12345678   ", False), ("\t\n1234567890 ", True), (None, False), ("", False)])
def test_described(spark, x, ok):
    assert one(spark, text.is_described(F.col("x")), x=x) is ok


def test_compositions(spark):
    assert one(spark, text.skill_text(F.col("a"), F.col("b"), F.col("c")), a="L", b=None, c=["x", "", "y"]) == "L. x; y"
    assert one(spark, text.skill_text(F.col("a"), F.col("b"), F.col("c")), a="L", b="", c=[]) == "L"
    payload = text.course_skill_text(*(F.col(c) for c in "abcdef"))
    assert one(spark, payload, a="n", b=None, c="", d="Apply", e=0, f=None) == "n. Bloom level: Apply. Proficiency: 0. Course: "
    assert one(spark, text.generation_text(F.col("l"), F.col("a"), F.col("b")), l="L", a=" x ", b=" ") == "x"
    assert one(spark, text.generation_text(F.col("l"), F.col("a"), F.col("b")), l="L", a=None, b="") == "L"
    doc = text.semantic_document(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert one(spark, doc, a="o'neil 3d-print", b="x", c=["p", "q"], d="g") == "O'Neil 3D-Print: x. Also known as p, q. Belongs to g"
    assert one(spark, doc, a="a", b=None, c=[], d=None) == "A: "


@pytest.mark.parametrize("x", ["o'neil 3d-print", "ÉCOLE de l'été", "", "a", "MiXeD CaSe", "tab\tsep"])
def test_title_case_is_pythons(spark, x):
    assert one(spark, text.title_case(F.col("x")), x=x) == x.title()


def test_answers(spark):
    assert one(spark, text.strip_fence(F.col("x")), x='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.strip_fence(F.col("x")), x=" {} ") == "{}"
    assert one(spark, text.drop_nan_words(F.col("x")), x="a nan nan") == "a"


def test_null_strings(spark):
    df = spark.createDataFrame([("Null ", ("x", "NULL"), ["null", "y"], 3)], "a string, b struct<c: string, d: string>, e array<string>, f int")
    row = text.null_strings_to_null(df).first()
    assert (row.a, tuple(row.b), row.e, row.f) == (None, ("x", None), [None, "y"], 3)
