"""Gates and projections that decide which works and references are analysed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.functions import text, works
from refsieve.functions.gate import passing, worked_out

UNSTRUCTURED, AUTHORS = "unstructured", "authors"

MIN_REFERENCES = 25
MIN_PROCESSABLE = 25
MIN_PERCENTAGE = 30
TEXT_CUT = 50


def with_min_refs(df: DataFrame, more_than: int = MIN_REFERENCES) -> DataFrame:
    """Works with more than ``more_than`` references; computed references are computed once."""
    number = passing(F.coalesce(F.array_size("reference"), F.lit(0)), lambda n: n > more_than)
    return df.select("*", number.alias("_n")).select(*[F.col(f"`{name}`") for name in df.columns])


def has_references(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["reference"])


def chosen_reference(reference: Column, prefer: str = UNSTRUCTURED, cut: int = TEXT_CUT) -> Column:
    """The processable side of one reference as ``(ref_type, text)``; null if it has none.

    Free text is stripped of markup, cut to ``cut`` characters and cleaned; an author string is
    only stripped of markup, it is cleaned before tokenising.
    """
    free, author = reference.getField("unstructured"), reference.getField("author")
    cut_free = text.clean_reference(F.substring(text.strip_html(free), 1, cut))
    sides = {
        UNSTRUCTURED: (
            free,
            F.struct(F.lit(UNSTRUCTURED).alias("ref_type"), cut_free.alias("text")),
        ),
        AUTHORS: (
            author,
            F.struct(F.lit(AUTHORS).alias("ref_type"), text.strip_html(author).alias("text")),
        ),
    }
    first = prefer
    second = AUTHORS if prefer == UNSTRUCTURED else UNSTRUCTURED
    return F.when(sides[first][0].isNotNull(), sides[first][1]).when(
        sides[second][0].isNotNull(), sides[second][1]
    )


def processable_array(
    references: Column, prefer: str = UNSTRUCTURED, cut: int = TEXT_CUT
) -> Column:
    """Processable references of a work as ``array<struct<ref_idx, ref_type, text>>``."""
    chosen = F.transform(
        references,
        lambda r, i: F.struct(
            (i + 1).alias("ref_idx"), chosen_reference(r, prefer, cut).alias("chosen")
        ),
    )
    kept = F.filter(chosen, lambda c: text.has_token(c["chosen"]["text"]))
    return F.transform(
        kept,
        lambda c: F.struct(
            c["ref_idx"].alias("ref_idx"),
            c["chosen"]["ref_type"].alias("ref_type"),
            c["chosen"]["text"].alias("text"),
        ),
    )


def processable_refs(
    df: DataFrame, prefer: str = UNSTRUCTURED, cut: int = TEXT_CUT, key: str = "DOI"
) -> DataFrame:
    """One row per processable reference: ``key, ref_idx, ref_type, text``.

    The same as ``processable_array``, but references become rows first and their texts columns.
    """
    sides = {
        UNSTRUCTURED: (F.col("_free"), F.substring(text.strip_html(F.col("_free")), 1, cut)),
        AUTHORS: (F.col("_author"), text.strip_html(F.col("_author"))),
    }
    first = prefer
    second = AUTHORS if prefer == UNSTRUCTURED else UNSTRUCTURED

    def of_chosen(value: Callable[[str], Column]) -> Column:
        return F.when(sides[first][0].isNotNull(), value(first)).when(
            sides[second][0].isNotNull(), value(second)
        )

    refs = df.select(key, F.posexplode_outer("reference").alias("_pos", "_r")).select(
        key,
        (F.col("_pos") + 1).alias("ref_idx"),
        F.col("_r.unstructured").alias("_free"),
        F.col("_r.author").alias("_author"),
    )
    visible = worked_out(refs, of_chosen(lambda side: sides[side][1]), "_visible").select(
        key, "ref_idx", of_chosen(F.lit).alias("ref_type"), "_visible"
    )
    cleaned = F.when(F.col("ref_type") == UNSTRUCTURED, text.clean_column(F.col("_visible"))).otherwise(
        F.col("_visible")
    )
    kept = worked_out(visible, cleaned, "text").filter(text.has_token(F.col("text")))
    return kept.select(key, "ref_idx", "ref_type", "text")


def percentage(part: Column, whole: Column) -> Column:
    """Whole per cent, half to even; null for a missing or zero whole."""
    return F.bround(F.try_divide(part, whole) * 100, 0).cast("int")


def with_processable_share(
    df: DataFrame,
    min_count: int = MIN_PROCESSABLE,
    min_percentage: int = MIN_PERCENTAGE,
    prefer: str = UNSTRUCTURED,
) -> DataFrame:
    """Add ``proc_refs`` and keep works with enough of them, in number and in share.

    The array goes through ``inline`` of a one-element list, so that it is computed once and the
    gate is not pushed below it with a second copy of the expression.
    """
    rows = F.transform(
        F.array(processable_array(F.col("reference"), prefer)),
        lambda refs: F.struct(
            refs.alias("proc_refs"),
            F.array_size(refs).alias("proc_ref_count"),
            percentage(F.array_size(refs), F.col("reference-count")).alias("proc_ref_ptge"),
        ),
    )
    kept = F.filter(
        rows,
        lambda r: (r["proc_ref_count"] >= min_count) & (r["proc_ref_ptge"] >= min_percentage),
    )
    return df.select("*", F.inline(kept))


def processable_share(
    df: DataFrame, more_than_count: int = 5, more_than_percentage: int = 30
) -> DataFrame:
    """Exploratory share: author strings first, nothing cleaned, count and rounded percentage."""
    count = F.coalesce(
        F.array_size(
            F.filter(
                "reference",
                lambda r: r["author"].isNotNull() | r["unstructured"].isNotNull(),
            )
        ),
        F.lit(0),
    )
    shared = df.withColumn("processable_ref_count", count).withColumn(
        "percentage", percentage(F.col("processable_ref_count"), F.col("reference-count"))
    )
    return shared.filter(
        (F.col("percentage") > more_than_percentage)
        & (F.col("processable_ref_count") > more_than_count)
    )


def author_first_refs(df: DataFrame) -> DataFrame:
    """Raw author strings, free text only where a reference has no author: ``DOI, ref_idx, text``."""
    exploded = df.select("DOI", F.posexplode("reference").alias("pos", "r"))
    return exploded.select(
        "DOI",
        (F.col("pos") + 1).alias("ref_idx"),
        F.coalesce("r.author", "r.unstructured").alias("text"),
    ).filter(F.col("text").isNotNull())


def project_work(df: DataFrame) -> DataFrame:
    """Flatten a work: first title, author names, ISSN maps, declared and actual counts."""
    extra = [c for c in ("proc_refs", "proc_ref_count", "proc_ref_ptge") if c in df.columns]
    return df.select(
        "DOI",
        F.col("type").alias("work_type"),
        works.author_names(F.col("author")).alias("author"),
        works.first_title(F.col("title")).alias("title"),
        F.col("container-title").alias("container_title"),
        works.typed_issns(F.col("issn-type")).alias("issn"),
        "member",
        F.col("reference-count").alias("ref_count"),
        F.array_size("reference").alias("total_reference_length"),
        *extra,
    )


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select([F.col(f"`{name}`") for name in columns])


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [name for name in df.columns if part in name]


def deposited_year(df: DataFrame) -> DataFrame:
    return df.withColumn("deposited_year", works.year_of(F.col("deposited")))


def by_id(df: DataFrame, ids: DataFrame | Iterable[str], key: str = "DOI") -> DataFrame:
    """Rows whose key is in a short list or in a table of keys."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))
