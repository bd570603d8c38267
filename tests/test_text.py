"""Column functions against Python."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.functions import text as T


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(make(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_hex_and_patterns(spark):
    assert column(spark, ["0x1F", "1f", "zz", "12G", "", None, "0x", "0xFFFFFFFF"], "string", T.parse_hex) == [31, 31, None, None, None, None, None, 2**32 - 1]
    assert column(spark, [0, 2**32 - 1], "long", T.hex_id) == ["0x00000000", "0xFFFFFFFF"]
    names = ["ATX_a", "atxyb", "Atx", "a\\b%", "É_x", "é_x"]
    assert column(spark, names, "string", lambda v: T.like(v, "ATX_%")) == [True, True, False, False, False, False]
    assert column(spark, names, "string", lambda v: T.contains(v, "\\B%")) == [False, False, False, True, False, False]
    assert column(spark, names, "string", lambda v: T.like(v, "É%")) == [False] * 4 + [True, False]
    assert T.glob_to_like("a*b?") == "a%b_"
    assert [T.parse_id_literal(x) for x in ("0x1F", "12", "007", "1_0", "0b1", "x", "0xZ")] == [31, 12, None, 10, 1, None, None]


def test_names_and_previews(spark):
    rows = spark.createDataFrame([("", "e"), (None, ""), ("f", "e")], "f string, e string")
    assert [r[0] for r in rows.select(T.display_name(F.col("f"), F.col("e"))).collect()] == ["e", None, "f"]
    assert column(spark, ["abcd", "abc", None], "string", lambda v: T.shortened(v, 3)) == ["abc...", "abc", None]
    assert column(spark, ["WEAP", "????", None], "string", T.type_name) == ["Weapon", "????", None]


@given(st.text(max_size=20))
def test_literals_never_raise(query):
    assert T.parse_id_literal(query) is None or isinstance(T.parse_id_literal(query), int)


@pytest.mark.parametrize("keep", [-1, -5])
def test_negative_keep_is_refused(spark, keep):
    from strataspark.operators.lookups import purge_set

    with pytest.raises(ValueError):
        purge_set(spark.range(3), keep)
