import re

import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from plain_model import clean

from refsieve.functions import text as tx
from refsieve.functions import works as wx


def apply(spark, function, values):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("v"))).collect()]


def test_token_runs_are_cut_greedily(spark):
    words = ["a" * 15, "b" * 16, "c" * 26, "x", "x yz", "snake_case9"]
    assert apply(spark, tx.tokenize, words) == [
        ["a" * 15], ["b" * 15], ["c" * 15, "c" * 11], [], ["yz"], ["snake_case9"],
    ]


def test_words_are_letters_digits_underscore_but_no_marks(spark):
    words = ["Straße журнал", "हिन्दी", "٣٤ ab", "東京 x"]
    assert apply(spark, tx.tokenize, words) == [re.findall(r"\w{2,15}", w) for w in words]


def test_cleaning_steps(spark):
    texts = [
        "doi:10.1/x Smith, J.", "see doi:10.1/x", "<b>A</b> &amp; B", "http://a.b/c?d=1 Rest",
        "12 a_b.c-d [e|f]", "x doi:1 y doi:2 z", "a\u0085doi:b c", "no <open", "A-B..C__D",
        "doi:broken\nover line", "http\x1cnext",
    ]
    assert apply(spark, tx.clean_reference, texts) == [clean(t) for t in texts]


def test_dots_and_hyphens_go_one_by_one(spark):
    assert apply(spark, tx.clean_reference, ["a.b...c", "a-b--c"]) == ["abc", "abc"]


def test_cleaning_equals_plain_python_on_any_text(spark):
    alphabet = st.sampled_from(list("ab1_.-[]|<>&;: \n\t\x1c\u0085 éИ٣") + ["doi:", "http"])
    samples = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(alphabet, max_size=25).map("".join))
    def gather(value):
        samples.append(value)

    gather()
    assert apply(spark, tx.clean_reference, samples) == [clean(s) for s in samples]


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("plain, no markup", "plain, no markup"),
        ("<p>A <b>B</b></p>", "A B"),
        ("a < b and c > d", "a < b and c > d"),
        ("&lt;i&gt; &amp;amp; &eacute;&#233;&#xE9;", "<i> &amp; ééé"),
        ("&unknown; &#0; & alone", "&unknown; &#0; & alone"),
        ("x<script>var t='<p>';</script>y<!-- <b> -->z<style>p{}</style>", "xyz"),
        ("<!DOCTYPE html><?pi x?>t", "t"),
        ("open <script> never closed", "open "),
        (None, None),
    ],
)
def test_html_to_text(spark, markup, expected):
    assert apply(spark, tx.strip_html, [markup]) == [expected]


def test_terms_and_small_helpers(spark):
    assert apply(spark, tx.terms, ["The THE a Ünder_x"]) == [["the", "the", "ünder_x"]]
    assert apply(spark, tx.strip_digits, ["a1b22 ٣"]) == ["ab "]
    assert apply(spark, tx.squash, ["D. E. Post nov"]) == ["D.E.Postnov"]
    assert apply(spark, tx.clean_title, ["H<sub>2</sub>O &amp; SUBx"]) == ["H2O  x"]


def test_authors_and_flag(spark):
    frame = spark.createDataFrame(
        [
            (1, [("Doe", "Jane"), ("Roe", None), ("", "Ann")], ["Jane"]),
            (2, [], ["doe"]),
            (3, None, ["doe"]),
            (4, [("van Dam", "O'Neil")], ["ONEIL"]),
            (5, [("van Dam", "X")], ["Dam", "other"]),
        ],
        "id int, author array<struct<family:string, given:string>>, vocab array<string>",
    )
    names = wx.author_names(F.col("author"))
    rows = frame.select("id", names.alias("n"), wx.author_flag(F.col("vocab"), names).alias("f"))
    assert {r["id"]: (r["n"], r["f"]) for r in rows.collect()} == {
        1: (["doe, jane", "roe", "ann"], "Yes"),
        2: (None, "No"),
        3: (None, "No"),
        4: (["van dam, o'neil"], "Yes"),
        5: (["van dam, x"], "No"),
    }


def test_issn_by_type_takes_the_last_and_survives_gaps(spark):
    frame = spark.createDataFrame(
        [
            (1, [("p1", "print"), ("e1", "electronic"), ("p2", "print")]),
            (2, [("e1", "electronic")]),
            (3, None),
        ],
        "id int, issn array<struct<value:string, type:string>>",
    )
    maps = wx.typed_issns(F.col("issn"))
    rows = frame.select(
        "id", wx.issn_of_type(maps, "print").alias("p"), wx.issn_of_type(maps, "electronic").alias("e")
    )
    assert {r["id"]: (r["p"], r["e"]) for r in rows.collect()} == {
        1: ("p2", "e1"), 2: (None, "e1"), 3: (None, None),
    }


def test_token_in_title(spark):
    frame = spark.createDataFrame(
        [(1, ["Abc"], "xABCx"), (2, ["Abc"], ""), (3, ["Abc"], None), (4, ["no", "yes"], "Yes!")],
        "id int, v array<string>, t string",
    )
    flags = frame.orderBy("id").select(wx.contained_flag(F.col("v"), F.col("t"))).collect()
    assert [r[0] for r in flags] == ["Yes", "No", "No", "Yes"]


@pytest.mark.parametrize("markup", [
    "a &copy; b", "&copy 2020", "&notit; x", "&hellip;&nbsp;&CounterClockwiseContourIntegral;", "&#000000065; &#x00000041;",
    "&unknown; & &amp;lt;", "&amp", "x &fjlig; y", "it's &apos;q&apos; \\n",
])
def test_entities_of_html_5(spark, markup):
    assert apply(spark, tx.strip_html, [markup]) == [html.unescape(markup)]


def test_cleaned_text_is_cleaned_again_only_where_markup_may_have_formed(spark):
    texts = ["plain", "a1_b", "d1oi: x y", "doi:10 x", "<1a>b", "x <b> y", "&a1mp; z", "h2ttp://u v", "ht-tp", "", None, "1 < 2", "Ünder3"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    once = frame.select("t", tx.clean_reference(F.col("t")).alias("c"))

    def by_patterns(value):
        for pattern in (tx.DOI_PREFIX, tx.ANGLED, tx.ENTITY, tx.URL, tx.SINGLE_MARKS):
            value = F.regexp_replace(value, pattern, "")
        return value

    found = once.select("c", tx.clean_again(F.col("c")).alias("again"), by_patterns(F.col("t")).alias("c2"),
                        by_patterns(F.col("c")).alias("again2")).collect()
    assert [r["c"] for r in found] == [r["c2"] for r in found]
    assert [r["again"] for r in found] == [r["again2"] for r in found]
    assert any(r["again"] != r["c"] for r in found)


def test_every_named_entity_is_found(spark):
    names = sorted(n for n in html.entities.html5 if n.endswith(";"))
    frame = spark.createDataFrame([(f"a &{n} b",) for n in names], "t string")
    found = {r["t"]: r["s"] for r in frame.select("t", tx.strip_html(F.col("t")).alias("s")).collect()}
    assert found == {t: html.unescape(t) for t in found} and len(found) == len(names)
