import pytest
from pyspark.sql import functions as F

from refsieve.operators import grouping, sets
from refsieve.plans import journals, profile, reports
from refsieve.plans.prepare import flatten_results, prepare
from refsieve.plans.titles import clean_titles
from refsieve.schema import RESULT


def result_rows(spark, rows):
    """Rows of ``(DOI, tokens, container, print, electronic, type, title, author, flag, frac)``."""
    built = []
    for doi, tokens, container, p, e, kind, title, author, flag, fraction in rows:
        issn = [{"value": v, "type": t} for v, t in ((p, "print"), (e, "electronic")) if v]
        built.append(
            (doi, tokens, fraction, 30, 28, 40, kind, author, flag, "m",
             issn or [{"value": None, "type": None}], title, container)
        )
    return spark.createDataFrame(built, RESULT)


ARTICLE = "journal-article"


@pytest.fixture(scope="module")
def results(spark):
    return result_rows(
        spark,
        [
            ("d1", ["B", "A"], ["J", "K"], "p1", "e1", ARTICLE, "T", ["x, y"], "Yes", 0.9),
            ("d2", ["A", "B"], ["J", "K"], None, "e1", ARTICLE, "T", None, "No", 0.9),
            ("d3", ["A"], None, "p1", None, ARTICLE, None, ["z"], "No", 1.0),
            ("d4", ["A"], None, "p1", None, "book", None, ["z"], "No", 0.5),
            ("d5", ["C"], ["J, K"], None, None, None, "", [], "No", 0.7),
        ],
    )


def by_doi(frame, column):
    return {r["DOI"]: r[column] for r in frame.collect()}


def test_flattened_columns(results):
    frame = flatten_results(results)
    assert by_doi(frame, "separated_tokens")["d1"] == "A, B"
    assert by_doi(frame, "container_title") == {
        "d1": "J, K", "d2": "J, K", "d3": None, "d4": None, "d5": "J, K",
    }
    assert by_doi(frame, "electronic_issn")["d3"] is None
    assert by_doi(frame, "ref_pge")["d1"] == pytest.approx(0.7)


def test_group_counts_are_null_for_null_keys(results):
    frame = prepare(results)
    assert by_doi(frame, "token_counts_by_container_title") == {
        "d1": 2, "d2": 2, "d3": None, "d4": None, "d5": 1,
    }
    assert by_doi(frame, "token_counts_by_print_issn") == {
        "d1": 1, "d2": None, "d3": 2, "d4": 2, "d5": None,
    }
    assert by_doi(frame, "container_title_work_type_counts") == {
        "d1": 2, "d2": 2, "d3": None, "d4": None, "d5": None,
    }


def test_a_count_needs_no_window_and_keeps_rows(results):
    frame = prepare(results)
    assert frame.count() == 5
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()


def test_first_row_limits_before_its_shuffle(results):
    frame = grouping.keep_first(results, "title", [F.col("DOI").desc()])
    assert {(r["title"], r["DOI"]) for r in frame.collect()} == {
        ("T", "d2"), (None, "d4"), ("", "d5"),
    }
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_duplicates_treat_nulls_as_equal(results):
    kept = grouping.keep_duplicated(results, "title")
    assert sorted(by_doi(kept, "DOI")) == ["d1", "d2", "d3", "d4"]


def test_exclusions_keep_nulls(results):
    assert sorted(by_doi(grouping.not_in(results, "title", ["T"]), "DOI")) == ["d3", "d4", "d5"]
    others = reports.result_slice(results, except_type=ARTICLE)
    assert [r["DOI"] for r in others.collect()] == ["d5", "d4"]


def test_report_order_puts_nulls_last_and_ends_with_doi(results):
    frame = reports.journal_articles(prepare(results))
    assert [r["DOI"] for r in frame.collect()] == ["d3", "d1", "d2"]


def test_duplicate_titles(results, spark):
    assert [r["DOI"] for r in reports.duplicate_titles(flatten_results(results)).collect()] == [
        "d1", "d2",
    ]
    assert reports.duplicate_titles(flatten_results(results), ["T"]).count() == 0
    done = spark.createDataFrame([("d1",)], "DOI string")
    assert reports.other_duplicate_titles(flatten_results(results), done).count() == 0


def test_any_count_selects_an_article(spark):
    rows = [
        (f"a{i}", ["A"], ["J"] if i < 3 else None, None, f"e{i}", ARTICLE, "t", ["n"], "Yes", 0.5)
        for i in range(5)
    ]
    frame = prepare(result_rows(spark, rows))
    assert sorted(by_doi(reports.flagged_articles(frame, 3), "DOI")) == ["a0", "a1", "a2"]
    assert reports.unflagged_articles(frame, 1).count() == 0


def test_most_common_tokens(spark):
    frame = spark.createDataFrame(
        [("A", 5, 1, None), ("B", 2, 7, None), ("C", 5, 2, None), ("D", 1, 1, 1)],
        "separated_tokens string, token_counts_by_electronic_issn int, "
        "token_counts_by_print_issn int, token_counts_by_container_title int",
    )
    found = profile.most_common_tokens(frame).collect()
    assert sorted(r[0] for r in found) == ["A", "B", "C", "D"]


def test_reference_shapes(spark):
    frame = spark.createDataFrame(
        [
            ("d", [("u", "a", None), (None, "a", "x"), (None, None, "x"), (None, None, None)]),
            ("e", None),
        ],
        "DOI string, reference array<struct<unstructured:string, author:string, DOI:string>>",
    )
    rows = {r["DOI"]: tuple(r)[1:] for r in profile.reference_profile(frame).collect()}
    assert rows == {"d": (1, 3, 2, 1, 1), "e": (0, 0, 0, 0, 0)}


def test_term_counts_drop_stop_words_and_rare_terms(spark):
    frame = spark.createDataFrame([("The cat 1cat2 the A",), ("cats cat",)], "t string")
    stop = spark.createDataFrame([("the",)], "word string")
    assert {tuple(r) for r in profile.term_counts(frame, "t", stop).collect()} == {
        ("cat", 3), ("cats", 1),
    }
    assert [tuple(r) for r in profile.term_counts(frame, "t", stop, more_than=1).collect()] == [
        ("cat", 3),
    ]


def test_cleaned_titles_one_per_doi(spark):
    frame = spark.createDataFrame(
        [("d", "A <i>b</i>", 1), ("d", "SUBX", 2), ("e", "Edi&x;torial", 1), ("f", None, 1)],
        "DOI string, title string, n int",
    )
    assert [tuple(r) for r in clean_titles(frame, order="n").collect()] == [("d", "X")]


def test_set_operations(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), (None, "n")], "k string, v string")
    b = spark.createDataFrame([("1",), (None,), ("3",)], "k string")
    assert [r[0] for r in sets.key_difference(a, b, "k").collect()] == ["2"]
    assert [r[0] for r in sets.key_intersection(a, b, "k").collect()] == ["1"]
    assert sets.stack(a, b).count() == 7


JOURNAL = (
    "container_title string, print_issn string, electronic_issn string, "
    "container_title_work_type_counts long, member string, print_issn_counts long, "
    "electronic_issn_counts long"
)


def test_second_of_an_electronic_issn_goes_and_later_ones_stay(spark):
    frame = spark.createDataFrame(
        [
            ("t1", "p1", "e1", 9, "m", 3, 10), ("t2", "p2", "e1", 8, "m", 3, 10),
            ("t3", "p3", "e1", 7, "m", 3, 10), ("t4", None, "e1", 6, "m", None, 10),
            ("t5", "p5", None, 5, "m", 1, None), ("t6", None, None, 4, "m", None, None),
        ],
        JOURNAL,
    )
    kept = {r["container_title"] for r in journals.unique_journals(frame).collect()}
    assert kept == {"t1", "t3", "t5"}


def test_counts_follow_the_strongest_evidence(spark):
    frame = spark.createDataFrame(
        [
            ("dup_print", "p1", "e1", 1, "m", 4, 2), ("dup_print2", "p1", "e2", 1, "m", 4, 3),
            ("dup_e", "p3", "e3", 1, "m", 7, 6), ("dup_e2", None, "e3", 1, "m", None, 6),
            ("equal_e", "p5", "e5", 8, "m", 9, 8), ("equal_p", "p6", "e6", 5, "m", 5, 7),
            ("neither", "p7", "e7", 1, "m", 2, 3), ("no_issn", None, None, 1, "m", None, None),
        ],
        JOURNAL,
    )
    counted = journals.actual_counts(journals.issn_evidence(frame))
    assert {r["container_title"]: r["actual_counts"] for r in counted.collect()} == {
        "dup_print": 4, "dup_print2": 4, "dup_e": 6, "dup_e2": 6, "equal_e": 8, "equal_p": 5,
        "neither": 0, "no_issn": 0,
    }


def test_journal_report_fills_unknown_journals(spark):
    rows = [
        (f"d{i}", ["A"], [f"J{i % 3}"], f"p{i % 3}", f"e{i % 3}", ARTICLE, "t", ["n"], "No", 0.5)
        for i in range(9)
    ]
    info = spark.createDataFrame([("e0", "Zero", 40), ("e1", "One", 0)], "issn string, title string, total_dois long")
    report = journals.journal_report(prepare(result_rows(spark, rows)), info)
    shown = {
        r["Container Title from DOI"]: (
            r["DOI counts"], r["Journal Title in journals route"], r["Total No. of DOIs"],
            r["Percentage of DOI counts over total number of DOIs"],
        )
        for r in report.collect()
    }
    assert shown == {
        "J0": (3, "Zero", "40", "7.5"),
        "J1": (3, "One", "0", "None found"),
        "J2": (3, "None found", "None found", "None found"),
    }


def test_hot_keys_are_counted_without_broadcasts(spark):
    keys = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.col("id").cast("string"))
    frame = spark.range(3000).select(F.col("id").cast("string").alias("DOI"), keys.alias("k"))
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in settings:
        spark.conf.set(setting, "-1")
    try:
        counted = grouping.count_over(frame, ["k"], "n").groupBy("n").count().collect()
        duplicated = grouping.keep_duplicated(frame, "k").count()
    finally:
        for setting in settings:
            spark.conf.unset(setting)
    nulls = sum(i % 3 != 0 and i % 50 == 1 for i in range(3000))
    assert {r["n"]: r["count"] for r in counted} == {1000: 1000, 1: 2000 - nulls, None: nulls}
    assert duplicated == 1000 + nulls
