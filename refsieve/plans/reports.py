"""Reports over the prepared frame.

Sorted reports end their sort keys with ``DOI``, which settles ties and lets a range-partitioned
sort split a value that many rows share.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.fixed_values import (
    ARTICLE_COLUMNS,
    ARTICLE_HEADINGS,
    BOOK_COLUMNS,
    BY_ISSN_AND_TITLE,
    CHAPTER_COLUMNS,
    CONTAINED_COLUMNS,
    DUPLICATE_COLUMNS,
    MISSING,
    STOP_TITLES,
    WORK_TYPE_COLUMNS,
)
from refsieve.functions import works
from refsieve.operators.grouping import (
    ascending,
    descending,
    differs,
    keep_duplicated,
    not_in,
    sum_over,
)
from refsieve.operators.sets import with_ids, without_ids

JOURNAL_ARTICLE = "journal-article"


def shape_report(
    df: DataFrame, columns: Sequence[str], names: Mapping[str, str] = ARTICLE_HEADINGS
) -> DataFrame:
    """Columns of a report in order, under their headings."""
    return df.select([F.col(c).alias(names.get(c, c)) for c in columns])


def fill_report_nulls(df: DataFrame, columns: Iterable[str], text: str = MISSING) -> DataFrame:
    """Show ``text`` where a value is missing; the columns become strings."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(text)) for c in columns})


def _articles(df: DataFrame) -> DataFrame:
    return df.filter(F.col("work_type") == JOURNAL_ARTICLE)


def journal_articles(df: DataFrame) -> DataFrame:
    return (
        _articles(df)
        .select(ARTICLE_COLUMNS)
        .orderBy(
            *descending(
                "token_frac_refs", "token_counts_by_electronic_issn", "token_counts_by_print_issn"
            ),
            "DOI",
        )
    )


def _repeated_token_articles(df: DataFrame, flag: str, min_count: int) -> DataFrame:
    often = F.greatest(*BY_ISSN_AND_TITLE) >= min_count
    return (
        _articles(df)
        .select(ARTICLE_COLUMNS)
        .filter((F.col("flag") == flag) & often)
        .orderBy(
            *descending(
                "token_counts_by_electronic_issn",
                "token_counts_by_container_title",
                "token_counts_by_print_issn",
                "token_frac_refs",
            ),
            "DOI",
        )
    )


def flagged_articles(df: DataFrame, min_count: int = 10) -> DataFrame:
    """Articles whose token is an author and recurs ``min_count`` times in a journal."""
    return _repeated_token_articles(df, works.YES, min_count)


def unflagged_articles(df: DataFrame, min_count: int = 10) -> DataFrame:
    """Articles whose token is no author and recurs ``min_count`` times in a journal."""
    return _repeated_token_articles(df, works.NO, min_count)


def unflagged_people(df: DataFrame, names: DataFrame, min_count: int = 10) -> DataFrame:
    """Unflagged articles whose token is listed as a person, column ``name`` of ``names``."""
    listed = names.select(F.col("name").alias("separated_tokens"))
    return unflagged_articles(df, min_count).join(listed, "separated_tokens", "left_semi")


def duplicate_titles(df: DataFrame, stop_titles: Sequence[str] = tuple(STOP_TITLES)) -> DataFrame:
    """Journal articles that share their title with another one."""
    titled = _articles(df).filter(F.col("title").isNotNull() & (F.col("title") != ""))
    repeated = keep_duplicated(not_in(titled, "title", stop_titles), "title")
    return repeated.select(DUPLICATE_COLUMNS).orderBy(
        *ascending("title", "container_title"), "DOI"
    )


def flagged_or_unflagged(df: DataFrame, *keys: DataFrame) -> DataFrame:
    """Rows whose DOI is in any of the given reports."""
    done = keys[0].select("DOI")
    for other in keys[1:]:
        done = done.unionByName(other.select("DOI"))
    return with_ids(df, done)


def other_duplicate_titles(df: DataFrame, done: DataFrame) -> DataFrame:
    """Duplicate titles among journal articles outside ``done``; missing titles count as equal."""
    rest = without_ids(_articles(df), done).filter(differs("title", ""))
    return keep_duplicated(rest, "title").orderBy(*ascending("title"), "DOI")


def by_work_type(df: DataFrame, work_type: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one work type, highest token share first."""
    columns = columns or WORK_TYPE_COLUMNS.get(work_type, CONTAINED_COLUMNS)
    return (
        df.filter(F.col("work_type") == work_type)
        .select(list(columns))
        .orderBy(*descending("token_frac_refs"), "DOI")
    )


def books(df: DataFrame) -> DataFrame:
    return by_work_type(df, "book", BOOK_COLUMNS)


def with_title_flags(df: DataFrame) -> DataFrame:
    vocabulary = F.col("token_vocabulary")
    return df.withColumns(
        {
            "title_flag": works.contained_flag(vocabulary, F.col("title")),
            "container_title_flag": works.contained_flag(vocabulary, F.col("container_title")),
        }
    )


def book_chapters(df: DataFrame) -> DataFrame:
    return with_title_flags(df.filter(F.col("work_type") == "book-chapter")).select(
        CHAPTER_COLUMNS
    )


def titled_not_authored(chapters: DataFrame) -> DataFrame:
    """Chapters whose token is in the title but is no author."""
    return chapters.filter(
        (F.col("title_flag") == works.YES) & (F.col("flag") == works.NO)
    ).orderBy(*descending("token_frac_refs"), "DOI")


def unequal_lengths(df: DataFrame, below: int | None = None) -> DataFrame:
    """Results that lost references to cleaning, optionally only those left with few."""
    lost = df.withColumn(
        "unequal",
        ~F.col("total_processed_ref_len").eqNullSafe(F.col("cleaned_references_length")),
    )
    if below is None:
        return lost
    return lost.filter(F.col("unequal") & (F.col("cleaned_references_length") < below))


def result_slice(
    df: DataFrame,
    full: bool | None = None,
    flag: str | None = None,
    work_type: str | None = None,
    except_type: str | None = None,
) -> DataFrame:
    """Results by full or partial coverage, flag and work type."""
    if full is not None:
        whole = F.col("token_frac_refs") >= 1
        df = df.filter(whole if full else ~whole)
    if flag is not None:
        df = df.filter(F.col("flag") == flag)
    if work_type is not None:
        df = df.filter(F.col("work_type") == work_type)
    if except_type is not None:
        df = df.filter(differs("work_type", except_type))
    return df.orderBy(*descending("token_frac_refs"), "DOI")


def by_token(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    return df.filter(F.col("separated_tokens").isin(list(tokens)))


def with_author(df: DataFrame, name: str) -> DataFrame:
    """Rows with ``name`` anywhere in their author text."""
    return df.filter(works.writes_name(F.col("author"), name))


def top_works(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` works that lead by the given columns."""
    return df.orderBy(*descending(*columns), "DOI").limit(k)


def references_by_author(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """References of any work whose author string is listed: one row per reference."""
    wanted = F.filter("reference", lambda r: r["author"].isin(list(names)))
    return df.select("DOI", F.inline(wanted).alias("key", "unstructured", "author", "ref_doi"))


def pairs_per_id(pairs: DataFrame, name: str = "DOI_counts") -> DataFrame:
    """Add how many works each work behind ``id1`` is paired with, copies counted."""
    partners = F.when(F.col("id1") == F.col("id2"), F.col("copies1") - 1).otherwise(F.col("copies2"))
    return sum_over(pairs.withColumn("_n", partners), "id1", "_n", name).drop("_n")
