import json
import random

import pytest
from pyspark.sql import functions as F
from plain_model import dominant as model

from refsieve.operators import gating
from refsieve.operators import tokens as tk
from refsieve.plans.dominant import dominant_token_works
from refsieve.schema import RESULT, WORK
from refsieve.session import stored
from refsieve.sources import snapshot

FREE_STOP, AUTHOR_STOP = {"the", "journal"}, {"and"}


STOP = {"unstructured": sorted(FREE_STOP), "authors": sorted(AUTHOR_STOP)}


def stop_rows(spark):
    rows = [(kind, word) for kind, words in STOP.items() for word in words]
    return spark.createDataFrame(rows, "ref_type string, word string")


def by_long_tables(frame, stop, fraction, key):
    """The job from long tables; ``key`` tells works apart."""
    gated = gating.with_processable_share(gating.with_min_refs(frame))
    cleaned = tk.cleaned_refs(gated.select(key, F.inline("proc_refs")), key)
    kept = tk.remove_stopwords(tk.reference_tokens(cleaned, key), stop)
    leading = tk.dominant_tokens(tk.token_counts(kept, key), key)
    scored = tk.token_fraction(leading, tk.cleaned_lengths(cleaned, key), fraction, key=key)
    return gated.join(scored, key)


def made(works, spark):
    lines = spark.sparkContext.parallelize([json.dumps(w) for w in works])
    return spark.read.schema(WORK).json(lines)


def free(text, n):
    return [{"unstructured": text} for _ in range(n)]


def works():
    ref_fill = [{"author": f"Writer{chr(97 + i)} Name{chr(97 + i)}"} for i in range(10)]
    cases = {
        "at_gate": free("Smith alone", 25),
        "over_gate": free("Smith alone", 26),
        "tied": free("Beta Alpha", 26),
        "tie_by_occurrence": free("Beta Beta Alpha", 26),
        "stop_only": free("The the journal", 26),
        "half": free("Gold", 13) + [{"author": f"N{chr(97 + i)}x"} for i in range(13)],
        "below_half": free("Gold", 12) + [{"author": f"N{chr(97 + i)}x"} for i in range(14)],
        "both_sides": free("and Smith", 20) + [{"author": "and Smith"}] * 6,
        "prefers_free_text": [{"unstructured": "Free", "author": "Author"}] * 26,
        "empty_free_text_wins": [{"unstructured": "", "author": "Author"}] * 30 + free("Text", 26),
        "second_pass_empties": free("Keep", 25) + [{"author": "http://only.url"}] * 3,
        "second_pass_below_25": free("Keep", 24) + [{"author": "http://only.url"}] * 3,
        "cut_at_50": [{"unstructured": "x" * 49 + " Tail Tail"}] * 26,
        "case_matters": free("Smith", 13) + free("SMITH", 13) + free("smith", 4),
        "markup": [{"unstructured": "<i>Smith</i> &amp; &eacute;t"}] * 26,
        "doi_only": [{"DOI": "10.1/x"}] * 40,
        "mixed": free("Smith 2001", 20) + ref_fill,
    }
    rng = random.Random(7)
    names = ["Alpha", "Beta", "Gamma", "the", "and", "x", "delta-eps", "doi:1 ", "<b>", "q" * 30]
    for n in range(40):
        cases[f"random{n}"] = [
            {rng.choice(["unstructured", "author", "DOI"]): " ".join(rng.choices(names, k=rng.randint(1, 9)))}
            for _ in range(rng.randint(20, 60))
        ]
    built = []
    for n, (name, references) in enumerate(cases.items()):
        built.append(
            {
                "DOI": name, "type": "journal-article", "title": [name, "second"],
                "author": [{"family": "Smith", "given": "J"}] if n % 2 else None,
                "reference-count": len(references) + (60 if name == "mixed" else 0),
                "reference": references, "member": "m",
            }
        )
    built.append({"DOI": "no_references", "type": "book"})
    built.append({"DOI": "no_count", "reference": free("Smith", 30)})
    built.append({"DOI": "zero_count", "reference": free("Smith", 30), "reference-count": 0})
    return built


def expected(fraction):
    found = {}
    for work in works():
        references = [
            {k: v.replace("<i>Smith</i> &amp; &eacute;t", "Smith & ét") for k, v in r.items()}
            if work["DOI"] == "markup"
            else {k: v.replace("<b>", "") for k, v in r.items()}
            for r in work.get("reference") or []
        ]
        answer = model(references, work.get("reference-count"), FREE_STOP, AUTHOR_STOP, fraction)
        if answer:
            found[work["DOI"]] = answer
    return found


@pytest.mark.parametrize("fraction", [0.5, 0.2])
def test_job_equals_plain_python(spark, fraction):
    frame = dominant_token_works(made(works(), spark), STOP, fraction)
    assert frame.columns == RESULT.fieldNames()
    got = {
        r["DOI"]: (
            r["token_vocabulary"], r["total_processed_ref_len"], r["cleaned_references_length"],
            round(r["token_frac_refs"], 5),
        )
        for r in frame.collect()
    }
    wanted = {k: (v[0], v[2], v[3], round(v[1], 5)) for k, v in expected(fraction).items()}
    assert got == wanted
    assert {"over_gate", "tied", "half", "both_sides"} <= set(wanted)
    assert not {"at_gate", "stop_only", "second_pass_below_25", "no_count", "zero_count"} & set(wanted)


def test_rows_of_one_doi_are_works_of_their_own_in_every_way(spark):
    twice = made(works() + works(), spark).withColumn("work", F.monotonically_increasing_id())
    twice = stored(twice, "twice")
    rows = sorted(
        (r["DOI"], r["token_vocabulary"], r["cleaned_references_length"])
        for r in dominant_token_works(twice, STOP, 0.2).collect()
    )
    long = sorted(
        (r["DOI"], r["token_vocabulary"], r["cleaned_references_length"])
        for r in by_long_tables(twice, stop_rows(spark), 0.2, "work").collect()
    )
    assert rows == long and len(rows) == 2 * len(expected(0.2))


def test_job_has_no_shuffle_and_no_python(spark):
    frame = dominant_token_works(made(works(), spark), STOP)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Join", "Python", "Window", "Sort "))


def test_flag_and_result_columns(spark):
    rows = {
        r["DOI"]: r for r in dominant_token_works(made(works(), spark), STOP).collect()
    }
    assert rows["over_gate"]["flag"] == "Yes" and rows["tied"]["flag"] == "No"
    assert rows["over_gate"]["title"] == "over_gate"
    assert rows["over_gate"]["issn"] == [{"value": None, "type": None}]


def test_shares_round_half_to_even(spark):
    frame = spark.createDataFrame([(1, 40), (3, 40), (5, 200), (1, 0), (1, None)], "a int, b int")
    got = [r[0] for r in frame.select(gating.percentage(F.col("a"), F.col("b"))).collect()]
    assert got == [2, 8, 2, None, None]


def test_exploratory_share_prefers_authors_and_counts_raw(spark):
    frame = made(works(), spark)
    rows = {r["DOI"]: r for r in gating.processable_share(frame).collect()}
    assert rows["half"]["percentage"] == 100
    assert "doi_only" not in rows
    texts = gating.author_first_refs(frame).filter("DOI = 'prefers_free_text'")
    assert {r["text"] for r in texts.collect()} == {"Author"}


def test_multi_word_stop_entries_never_match(spark):
    tokens = spark.createDataFrame(
        [("d", 1, "unstructured", "et"), ("d", 1, "unstructured", "Stop")],
        "DOI string, ref_idx int, ref_type string, token string",
    )
    words = spark.createDataFrame(
        [("unstructured", "et al"), ("unstructured", "stop")], "ref_type string, word string"
    )
    assert [r["token"] for r in tk.remove_stopwords(tokens, words).collect()] == ["et"]


def test_stop_table_holds_all_sources(spark):
    ignore = spark.createDataFrame([("Atlantis",)], "word string")
    table = tk.stop_table(spark, ignore)
    kept = {(r["ref_type"], r["word"]) for r in table.collect()}
    assert {("unstructured", w) for w in ("the", "und", "vgl", "march", "et al", "atlantis")} <= kept
    assert ("authors", "atlantis") in kept and ("authors", "the") not in kept
    assert len(kept) == table.count()


def test_ignore_lists_from_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"unwanted_tokens": ["Foo", "foo", "Bar"]}))
    (tmp_path / "c.json").write_text(json.dumps({"countries": ["Chad", "FOO"]}))
    words = snapshot.read_ignore_tokens(spark, str(tmp_path / "t.json"), str(tmp_path / "c.json"))
    assert sorted(r["word"] for r in words.collect()) == ["bar", "chad", "foo"]
    assert snapshot.read_ignore_tokens(spark).count() == 0


def test_computed_references_are_computed_once_behind_the_gate(spark):
    """The filter on their number was pushed below the projection with a copy of the computation."""
    texts = F.transform(F.sequence(F.lit(1), F.col("id") + 1), lambda i: F.concat(F.lit("ref"), i))
    kept = gating.with_min_refs(spark.range(40).select("id", texts.alias("reference")), 25)
    assert kept.columns == ["id", "reference"]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
    assert sorted(r["id"] for r in kept.select("id").collect()) == list(range(25, 40))


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("prefer", ["unstructured", "authors"])
def test_texts_of_references_are_columns_and_not_lambdas(spark, prefer):
    """Inside a lambda over the references every text was interpreted, not compiled."""
    odd = [
        {"DOI": "nulls", "reference": [None, {}, {"unstructured": "", "author": "Ab"}, {"author": "1"}, {"author": "Cd"}]},
        {"DOI": "none", "reference": []}, {"DOI": "null", "reference": None},
        {"DOI": "marks", "reference": [{"unstructured": "<b>A &amp;amp; Bc &lt;i&gt; doi:1 ", "author": "http://x Ef"}] * 2},
    ]
    frame = made(works() + odd, spark)
    found = gating.processable_refs(frame, prefer)
    wanted = frame.select("DOI", F.inline(gating.processable_array(F.col("reference"), prefer)))
    assert found.columns == wanted.columns
    assert sorted(found.collect()) == sorted(wanted.collect()) and "transform(reference" not in plan_of(found)
    twice = wanted.select("DOI", "ref_idx", "ref_type", tk.text.clean_reference(F.col("text")).alias("text"))
    again = tk.cleaned_refs(found)
    assert sorted(again.collect()) == sorted(twice.filter(tk.text.has_token(F.col("text"))).collect())


def test_stop_words_in_lists_need_no_join(spark):
    refs = tk.cleaned_refs(gating.processable_refs(made(works(), spark)))
    tokens = tk.reference_tokens(refs)
    lists, table = tk.remove_stopwords(tokens, STOP), tk.remove_stopwords(tokens, stop_rows(spark))
    assert sorted(lists.collect()) == sorted(table.collect()) and lists.count() < tokens.count()
    assert "Join" not in plan_of(lists) and "Join" in plan_of(table)
    assert tk.remove_stopwords(tokens, {"unstructured": [], "authors": []}).count() == tokens.count()


def test_empty_stop_lists_keep_every_token(spark):
    """An empty list became ``IN (NULL)``, which is neither true nor false, and dropped every token."""
    found = dominant_token_works(made(works(), spark), {"unstructured": [], "authors": []})
    assert {"stop_only", "over_gate"} <= {r["DOI"] for r in found.collect()}


def test_counts_by_work_are_shuffled_once(spark):
    """Counts dealt by work and token were shuffled by work once more."""
    refs = tk.cleaned_refs(gating.processable_refs(made(works(), spark)))
    kept = tk.remove_stopwords(tk.reference_tokens(refs), STOP)
    once, twice = (tk.dominant_tokens(tk.token_counts(kept, by_work=b)) for b in (True, False))
    assert sorted(once.collect()) == sorted(twice.collect())
    plan = once._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
