import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wortsee.functions import text as tx


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_white_space_is_pythons(spark):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and c]
    spaces = [f"a{c}b" for c in every if c.isspace()] + [f"a{c}b" for c in every[:3000]]
    assert column(spark, spaces, tx.collapse_ws) == [" ".join(s.split()) for s in spaces]


def test_casefold_on_every_exception(spark):
    cases = list(tx.folding_exceptions()) + ["Straße", "ΌΣΟΣ", "ﬀ", "İ", "ẞ", "µm", None, ""]
    assert column(spark, cases, tx.casefold) == [c if c is None else c.casefold() for c in cases]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=20), min_size=1, max_size=60))
def test_normal_form_property(spark, values):
    assert column(spark, values, tx.normalize_word) == [" ".join(v.split()).casefold() for v in values]


@pytest.mark.parametrize(
    ("card", "present", "absent"),
    [
        ("der Kaffee", {"der kaffee", "kaffee"}, set()),
        ("der", {"der"}, set()),
        ("ein bisschen", {"bisschen"}, set()),
        ("ausruhen (sich)", {"ausruhen"}, set()),
        ("sich kümmern", {"kümmern"}, {"kummern"}),
        ("gern(e)", {"gern", "gerne"}, set()),
        ("ihr/ihm/ihn", {"ihr", "ihm", "ihn"}, set()),
        ("circa/ca.", {"circa", "ca"}, set()),
        ("nächst-", {"nächst"}, set()),
        ("auf jeden/keinen Fall", {"auf jeden fall", "auf keinen fall"}, {"fall"}),
        ("  ", set(), {""}),
    ],
)
def test_match_keys(spark, card, present, absent):
    keys = set(column(spark, [card], tx.match_keys)[0])
    assert present <= keys and not keys & absent


def test_form_list_has_no_other_keys(spark):
    assert column(spark, ["der, die, das"], tx.match_keys) == [["das", "der", "die"]]
    assert column(spark, ["Rad fahren", None], tx.match_keys)[0] == ["rad fahren"]
