"""Tokens of references as rows: stop words, counts, dominant token, coverage.

The operators here work on long tables and shuffle by work and token. ``refsieve.plans.dominant``
answers the same question inside each row and needs no shuffle. ``key`` names the column that tells
works apart; where several rows have one ``DOI``, give each row a key of its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refsieve import fixed_values
from refsieve.functions import text
from refsieve.functions.gate import once, worked_out
from refsieve.operators.gating import AUTHORS, MIN_PROCESSABLE, UNSTRUCTURED

MIN_FRACTION = 0.5


def words_table(spark: SparkSession, words) -> DataFrame:
    """A word list as a table of distinct lower-case words."""
    distinct = sorted({word.lower() for word in words})
    return spark.createDataFrame(pa.table({"word": pa.array(distinct, pa.string())}))


def language_words(languages=tuple(fixed_values.STOP_LANGUAGES)) -> list[str]:
    """Spark's own stop-word lists; needs a running session."""
    return [w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)]


def stop_table(
    spark: SparkSession,
    ignore: DataFrame | None = None,
    languages=tuple(fixed_values.STOP_LANGUAGES),
) -> DataFrame:
    """Stop words per reference type, ``(ref_type, word)``.

    Free text loses language, domain and month words, author strings a short fixed list; words
    of the ``ignore`` table are dropped from both.
    """
    free = language_words(languages) + fixed_values.DOMAIN_WORDS + fixed_values.MONTHS
    tables = [
        words_table(spark, free).select(F.lit(UNSTRUCTURED).alias("ref_type"), "word"),
        words_table(spark, fixed_values.AUTHOR_WORDS).select(
            F.lit(AUTHORS).alias("ref_type"), "word"
        ),
    ]
    if ignore is not None:
        kinds = F.explode(F.array(F.lit(UNSTRUCTURED), F.lit(AUTHORS))).alias("ref_type")
        tables.append(ignore.select(kinds, F.lower("word").alias("word")))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result.distinct() if ignore is not None else result


def stop_lists(stop: DataFrame) -> dict[str, list[str]]:
    """A stop table as sorted lists per reference type. Stop words are lists to begin with."""
    rows = stop.distinct().collect()
    return {
        kind: sorted(r["word"] for r in rows if r["ref_type"] == kind)
        for kind in (UNSTRUCTURED, AUTHORS)
    }


def cleaned_refs(refs: DataFrame, key: str = "DOI") -> DataFrame:
    """Clean processable references once more and drop those that have no token left.

    Free text was cleaned when it was chosen, author strings were not.
    """
    again = F.when(F.col("ref_type") == UNSTRUCTURED, text.clean_again(F.col("text"))).otherwise(
        text.clean_column(F.col("text"))
    )
    kept = worked_out(refs, again, "_again").filter(text.has_token(F.col("_again")))
    return kept.select(key, "ref_idx", "ref_type", F.col("_again").alias("text"))


def reference_tokens(refs: DataFrame, key: str = "DOI") -> DataFrame:
    """One row per token occurrence: ``DOI, ref_idx, ref_type, token, first``.

    ``first`` marks the first occurrence within its reference, so that references can later be
    counted by a plain sum instead of a distinct count with a shuffle of its own.
    """
    found = refs.select(
        key, "ref_idx", "ref_type", once(text.tokenize(F.col("text")).alias("tokens"))
    )
    return found.select("*", F.posexplode("tokens").alias("pos", "token")).select(
        key,
        "ref_idx",
        "ref_type",
        "token",
        (F.array_position("tokens", F.col("token")) == F.col("pos") + 1).alias("first"),
    )


def is_stop_word(token: str, ref_type: str, words: dict[str, list[str]]) -> str:
    """Whether a token is a stop word of its reference type, as SQL text with literal sets.

    Written as SQL text, because two thousand literals parse far faster than they cross py4j.
    """
    cases = [
        f"WHEN {text.literal(kind)} THEN lower({token}) IN ({', '.join(text.literal(w) for w in listed)})"
        for kind, listed in words.items() if listed
    ]
    return f"CASE {ref_type} {' '.join(cases)} ELSE false END" if cases else "false"


def remove_stopwords(
    tokens: DataFrame, stop: DataFrame | dict[str, list[str]], ref_type: str | None = None
) -> DataFrame:
    """Drop tokens whose lower-case form is a stop word of their reference type.

    Stop words given as lists, as ``stop_lists`` makes them, become literal sets, which cost a token
    far less than a join. A table may be of any size. It carries no broadcast hint: Spark broadcasts
    it when its size allows, and otherwise shuffles and splits skewed words.
    """
    if ref_type is not None:
        tokens = tokens.filter(F.col("ref_type") == ref_type)
    if isinstance(stop, dict):
        return tokens.filter(~F.expr(is_stop_word("token", "ref_type", stop)))
    if ref_type is not None:
        stop = stop.filter(F.col("ref_type") == ref_type)
    words = stop.select(F.col("ref_type").alias("stop_type"), F.col("word").alias("stop_word"))
    matches = (F.col("ref_type") == F.col("stop_type")) & (
        F.lower("token") == F.col("stop_word")
    )
    return tokens.join(words, matches, "left_anti")


def token_counts(tokens: DataFrame, key: str = "DOI", by_work: bool = False) -> DataFrame:
    """Occurrences and references per work and token.

    The references of a work come from one input row, so all its counts are combined before the
    one shuffle. ``by_work`` shuffles occurrences by work instead, for what then looks at whole
    works: ``dominant_tokens`` of such counts needs no shuffle of its own.
    """
    if by_work:
        tokens = tokens.select(key, "token", "first").repartition(key)
    return tokens.groupBy(key, "token").agg(
        F.count("*").alias("token_count"), F.count_if("first").alias("reference_count")
    )


def dominant_tokens(counts: DataFrame, key: str = "DOI") -> DataFrame:
    """Token(s) of each work with the most references, then the most occurrences; ties all kept.

    Spark limits ``rank() = 1`` before the shuffle by work, so only tokens that lead within their
    task are sent.
    """
    by_work = Window.partitionBy(key).orderBy(F.desc("reference_count"), F.desc("token_count"))
    leading = counts.withColumn("_rank", F.rank().over(by_work)).filter(F.col("_rank") == 1)
    return leading.groupBy(key, "reference_count", "token_count").agg(
        F.sort_array(F.collect_list("token")).alias("token_vocabulary")
    )


def cleaned_lengths(cleaned: DataFrame, key: str = "DOI") -> DataFrame:
    return cleaned.groupBy(key).agg(F.count("*").alias("cleaned_references_length"))


def token_fraction(
    dominant: DataFrame,
    lengths: DataFrame,
    min_fraction: float = MIN_FRACTION,
    min_cleaned: int = MIN_PROCESSABLE,
    key: str = "DOI",
) -> DataFrame:
    """Share of cleaned references the dominant token covers, kept from ``min_fraction`` up.

    The threshold is applied in double precision, the stored share is single precision.
    """
    lengths = lengths.filter(F.col("cleaned_references_length") >= min_cleaned)
    share = F.col("reference_count") / F.col("cleaned_references_length")
    return (
        dominant.join(lengths, key)
        .filter(share >= min_fraction)
        .withColumn("token_frac_refs", share.cast("float"))
    )
