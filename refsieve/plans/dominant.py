"""The snapshot job: works in, works dominated by one token out.

Everything about a work sits in its own row, so the job is expressions over nested arrays: one
scan, no shuffle and no join. Each stage goes through ``inline`` of a list that is empty when a
gate fails, which computes the stage once and keeps later gates from being copied below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.functions import text, works
from refsieve.functions.gate import once, passing
from refsieve.operators import gating
from refsieve.operators.gating import MIN_PROCESSABLE, UNSTRUCTURED
from refsieve.operators.tokens import MIN_FRACTION, is_stop_word
from refsieve.schema import RESULT


def _kept_tokens(words: dict[str, list[str]]) -> Column:
    """Tokens per cleaned reference without the stop words of its type."""
    pattern = text.TOKEN.replace("\\", "\\\\")
    return F.expr(
        f"""transform(cleaned, p -> filter(regexp_extract_all(p.text, '{pattern}', 0), t -> NOT
        {is_stop_word("t", "p.ref_type", words)}))"""
    )


def _longest_run(ordered: Column) -> Column:
    """Length of the longest run of equal values in a sorted list.

    The running best grows by one whenever the value that many places back is the same.
    """
    positions = F.sequence(F.lit(0), F.array_size(ordered) - 1)
    grown = F.aggregate(
        positions,
        F.lit(0),
        lambda best, i: F.when(
            F.get(ordered, i) == F.get(ordered, F.greatest(i - best, F.lit(0))),
            F.when(i >= best, best + 1).otherwise(best),
        ).otherwise(best),
    )
    return F.when(F.array_size(ordered) > 0, grown).otherwise(0)


def _scored(df: DataFrame, words: dict[str, list[str]], min_fraction: float) -> DataFrame:
    # Free text was cleaned when it was chosen, author strings were not.
    again = F.filter(
        F.transform(
            "proc_refs",
            lambda p: F.struct(
                p["ref_type"].alias("ref_type"),
                F.when(p["ref_type"] == UNSTRUCTURED, text.clean_again(p["text"]))
                .otherwise(text.clean_reference(p["text"])).alias("text"),
            ),
        ),
        lambda p: text.has_token(p["text"]),
    )
    enough = passing(again, lambda refs: F.array_size(refs) >= MIN_PROCESSABLE)
    df = df.select("*", enough.alias("cleaned"))

    per_reference = _kept_tokens(words)
    df = df.select("*", once(per_reference.alias("per_reference")))
    once_each = F.flatten(F.transform("per_reference", F.array_distinct))
    df = df.select("*", once(F.sort_array(once_each).alias("ordered")))

    covered = passing(
        _longest_run(F.col("ordered")),
        lambda best: (best > 0) & (best / F.array_size("cleaned") >= min_fraction),
    )
    return df.select("*", covered.alias("reference_count")).withColumn(
        "fraction", F.col("reference_count") / F.array_size("cleaned")
    )


def _vocabulary(df: DataFrame) -> DataFrame:
    """Tokens reaching ``reference_count``, narrowed to those with the most occurrences."""
    leaders = F.array_distinct(
        F.filter(
            "ordered",
            lambda t, i: t == F.get(F.col("ordered"), i + F.col("reference_count") - 1),
        )
    )
    df = df.select("*", once(leaders.alias("leaders")))
    occurrences = F.flatten("per_reference")
    counted = F.transform(
        "leaders",
        lambda leader: F.struct(
            F.array_size(F.filter(occurrences, lambda t: t == leader)).alias("n"), leader.alias("token")
        ),
    )
    df = df.select("*", once(counted.alias("counted")))
    most = F.array_max(F.transform("counted", lambda c: c["n"]))
    winners = F.filter("counted", lambda c: c["n"] == most)
    return df.withColumn("token_vocabulary", F.transform(winners, lambda c: c["token"]))


def _result(df: DataFrame) -> DataFrame:
    return df.select(
        "DOI",
        "token_vocabulary",
        F.col("token_frac_refs").cast("float").alias("token_frac_refs"),
        F.col("proc_ref_count").cast("int").alias("total_processed_ref_len"),
        F.col("cleaned_references_length").cast("int").alias("cleaned_references_length"),
        F.col("total_reference_length").cast("int").alias("total_reference_length"),
        "work_type",
        "author",
        works.author_flag(F.col("token_vocabulary"), F.col("author")).alias("flag"),
        "member",
        "issn",
        "title",
        "container_title",
    ).select(RESULT.fieldNames())


def dominant_token_works(
    works_df: DataFrame,
    stop: dict[str, list[str]],
    min_fraction: float = MIN_FRACTION,
    min_refs: int = gating.MIN_REFERENCES,
) -> DataFrame:
    """Works whose most frequent reference token covers at least ``min_fraction`` of them.

    ``stop`` holds the stop words per reference type, as ``tokens.stop_lists`` gives them; they
    become literal sets. Every row of ``works_df`` is a work, whatever its ``DOI``.
    """
    gated = gating.project_work(
        gating.with_processable_share(gating.with_min_refs(works_df, min_refs))
    )
    scored = _vocabulary(_scored(gated, stop, min_fraction))
    return _result(
        scored.withColumn("cleaned_references_length", F.array_size("cleaned")).withColumnRenamed(
            "fraction", "token_frac_refs"
        )
    )
