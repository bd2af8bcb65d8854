"""Expressions over the author, ISSN, title and date fields of a work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refsieve.functions.text import NON_WORD, separated

YES, NO = "Yes", "No"


def yes_no(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), YES).otherwise(NO)


def _filled(part: Column) -> Column:
    return F.when(part != "", part)


def author_names(authors: Column) -> Column:
    """``family, given`` in lower case per author; null for a missing or empty author list."""
    names = F.transform(
        authors,
        lambda a: F.lower(
            F.concat_ws(", ", _filled(a.getField("family")), _filled(a.getField("given")))
        ),
    )
    return F.when(F.array_size(authors) > 0, names)


def author_flag(vocabulary: Column, authors: Column) -> Column:
    """Yes if a token equals a name part of the work's own authors."""
    parts = F.transform(
        F.split(F.array_join(authors, ","), ","), lambda part: F.regexp_replace(part, NON_WORD, "")
    )
    return yes_no(
        (F.array_size(authors) > 0) & F.arrays_overlap(F.transform(vocabulary, F.lower), parts)
    )


def contained_flag(vocabulary: Column, title: Column) -> Column:
    """Yes if a token occurs anywhere in the title, ignoring case."""
    return yes_no(
        (title != "") & F.exists(vocabulary, lambda t: F.contains(F.lower(title), F.lower(t)))
    )


def first_title(titles: Column) -> Column:
    return F.get(titles, F.lit(0))


def typed_issns(issns: Column) -> Column:
    """ISSN structs as maps; one empty entry where the work has none."""
    maps = F.transform(
        issns,
        lambda i: F.create_map(
            F.lit("value"), i.getField("value"), F.lit("type"), i.getField("type")
        ),
    )
    none = F.create_map(
        F.lit("value"), F.lit(None).cast("string"), F.lit("type"), F.lit(None).cast("string")
    )
    return F.coalesce(maps, F.array(none))


def issn_of_type(issns: Column, kind: str) -> Column:
    """The last ISSN of one type (``print`` or ``electronic``)."""
    of_kind = F.filter(issns, lambda i: i["type"] == kind)
    return F.try_element_at(of_kind, F.lit(-1))["value"]


def container_name(containers: Column) -> Column:
    return separated(containers)


def year_of(dated: Column) -> Column:
    """First year of a ``date-parts`` struct."""
    return F.get(F.get(dated.getField("date-parts"), F.lit(0)), F.lit(0))


def writes_name(authors: Column, name: str) -> Column:
    return F.contains(separated(authors), F.lit(name))
