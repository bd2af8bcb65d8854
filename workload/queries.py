"""One query per operator, over whole tables, with flat columns that compare across engines."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsieve.fixed_values import ARTICLE_COLUMNS, SIMILAR_TITLE_COLUMNS, STOP_TITLES
from refsieve.functions import text as tx
from refsieve.functions import works as wx
from refsieve.operators import (
    characters,
    copies,
    embeddings,
    gating,
    grouping,
    sets,
    tfidf,
)
from refsieve.operators import tokens as tk
from refsieve.operators.gating import AUTHORS, UNSTRUCTURED
from refsieve.plans import dominant, journals, profile, reports, titles
from refsieve.plans.prepare import COUNTS, flatten_results, prepare
from refsieve.session import shared_folder, stored
from refsieve.sources import sinks, snapshot
from workload import views

_WRITTEN: dict[tuple, str] = {}


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, whole numbers as long, fractions as double with 6 places."""

    def column(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, "|")
        elif isinstance(field.dataType, T.IntegerType):
            value = value.cast("long")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = F.round(value.cast("double"), 6)
        return value.alias(field.name)

    return df.select([column(f) for f in df.schema.fields])


def stop_lists(spark, sf):
    return tk.stop_lists(stop_words(spark, sf))


def stop_words(spark, sf):
    return tk.stop_table(spark, views.ignore_words(spark, sf))


def first_titles(spark, sf):
    """``DOI, title`` of all works that have a title, one row per DOI."""
    works = views.works(spark, sf, references=False)
    titled = works.select("DOI", wx.first_title(F.col("title")).alias("title"))
    return titled.filter(F.col("title") != "").groupBy("DOI").agg(F.max("title").alias("title"))


def _version(spark, sf):
    """When the documents last changed, as their store says."""
    files = views.table(spark, sf, "documents").select("_metadata.file_modification_time")
    return files.agg(F.max("file_modification_time")).first()[0]


def results(spark, sf):
    """The result table, written once per session and data folder and read back."""
    key = (spark.sparkContext.applicationId, sf, _version(spark, sf))
    if key not in _WRITTEN:
        found = dominant.dominant_token_works(views.works(spark, sf), stop_lists(spark, sf))
        _WRITTEN[key] = sinks.write_results(found, _scratch(spark, "results"))
    return snapshot.read_results(spark, _WRITTEN[key])


def prepared(spark, sf, counts=tuple(COUNTS)):
    """The prepared frame with some of its counts, written once per session and data folder."""
    key = ("prepared", spark.sparkContext.applicationId, sf, _version(spark, sf))
    if key not in _WRITTEN:
        path = _scratch(spark, "prepared")
        prepare(results(spark, sf)).write.parquet(path)
        _WRITTEN[key] = path
    frame = spark.read.parquet(_WRITTEN[key])
    return frame.drop(*[name for name in COUNTS if name not in counts])


def cleaned(spark, sf):
    return tk.cleaned_refs(gating.processable_refs(views.works(spark, sf)))


def kept_tokens(spark, sf, ref_type=None, refs=None):
    refs = cleaned(spark, sf) if refs is None else refs
    return tk.remove_stopwords(tk.reference_tokens(refs), stop_lists(spark, sf), ref_type)


def digest(value: Column, *names: str) -> list[Column]:
    """Length and hash of a long text, in place of the text."""
    return [F.length(value).cast("long").alias("n_chars"), F.md5(value).alias("digest")]


# --- sources and sinks ---------------------------------------------------------------------


def read_snapshot(spark, sf):
    path = _scratch(spark, "snapshot")
    views.works(spark, sf).write.json(path)
    works = snapshot.read_works(spark, path)
    return flat(
        works.select(
            "DOI", "type", "title", "container-title", "member", "prefix",
            F.col("reference-count").alias("reference_count"),
            F.coalesce(F.array_size("reference"), F.lit(0)).alias("n_references"),
            wx.author_names(F.col("author")).alias("author"),
        ).withColumnRenamed("container-title", "container_title")
    )


def read_items(spark, sf):
    path = _scratch(spark, "items")
    works = views.works(spark, sf)
    document = F.to_json(F.struct(F.collect_list(F.struct(*works.columns)).alias("items")))
    # A document holds a thousand rows of one partition, whatever their keys, and is a file.
    numbered = works.withColumn("part", F.floor(F.monotonically_increasing_id() / 1000))
    documents = numbered.groupBy("part").agg(document.alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return flat(
        snapshot.read_items(spark, path).select(
            "DOI", "type", "member", F.coalesce(F.array_size("reference"), F.lit(0)).alias("n_references")
        )
    )


def read_ignore_lists(spark, sf):
    tokens, countries = _scratch(spark, "tokens"), _scratch(spark, "countries")
    views.table(spark, sf, "benchmark").select(
        F.array(F.regexp_extract("text", tx.TERM, 0)).alias("unwanted_tokens")
    ).write.json(tokens)
    views.table(spark, sf, "nation").select(F.array("n_name").alias("countries")).write.json(
        countries
    )
    return snapshot.read_ignore_tokens(spark, tokens, countries)


def read_results(spark, sf):
    table = results(spark, sf)
    return flat(table.withColumn("issn", F.transform("issn", lambda m: F.coalesce(m["value"], F.lit("")))))


def report_round_trip(spark, sf):
    report = reports.duplicate_titles(flatten_results(results(spark, sf)))
    path = sinks.write_report(report, _scratch(spark, "report"))
    return snapshot.read_report(spark, path, sinks.flat(report).schema)


# --- gating and projection -----------------------------------------------------------------


def min_refs(spark, sf):
    kept = gating.with_min_refs(views.works(spark, sf))
    return flat(kept.select("DOI", F.array_size("reference").alias("n_references")))


def processable_refs(spark, sf):
    return flat(gating.processable_refs(views.works(spark, sf)))


def author_first_refs(spark, sf):
    return flat(gating.author_first_refs(views.works(spark, sf)))


def share_gate(spark, sf):
    kept = gating.with_processable_share(views.works(spark, sf))
    return flat(kept.select("DOI", "proc_ref_count", "proc_ref_ptge"))


def processable_share(spark, sf):
    kept = gating.processable_share(views.works(spark, sf))
    return flat(kept.select("DOI", "processable_ref_count", "percentage"))


def project_work(spark, sf):
    works = gating.project_work(views.works(spark, sf))
    return flat(
        works.withColumn("issn", F.transform("issn", lambda m: F.coalesce(m["value"], F.lit(""))))
    )


def author_names(spark, sf):
    works = views.works(spark, sf)
    return flat(works.select("DOI", wx.author_names(F.col("author")).alias("author")))


def has_references(spark, sf):
    return gating.has_references(views.works(spark, sf)).select("DOI")


def select_columns(spark, sf):
    wanted = ["DOI", "type", "member", "prefix", "is-referenced-by-count"]
    return flat(
        gating.select_columns(views.works(spark, sf), wanted).withColumnRenamed(
            "is-referenced-by-count", "cited_by"
        )
    )


def deposited_year(spark, sf):
    return flat(gating.deposited_year(views.works(spark, sf)).select("DOI", "deposited_year"))


def article_layout(spark, sf):
    frame = reports.journal_articles(prepared(spark, sf))
    columns = [c for c in ARTICLE_COLUMNS if c != "token_counts_by_container_title"]
    return flat(reports.shape_report(frame, columns))


def report_nulls(spark, sf):
    frame = flatten_results(results(spark, sf)).select(
        "DOI", "title", "container_title", "print_issn", "total_reference_length"
    )
    return flat(reports.fill_report_nulls(frame, ["title", "container_title", "print_issn"]))


def by_id(spark, sf):
    picked = gating.by_id(views.works(spark, sf), views.toxic_dois(spark, sf))
    return flat(picked.select("DOI", "type", "reference-count")).withColumnRenamed(
        "reference-count", "reference_count"
    )


def columns_like(spark, sf):
    works = views.works(spark, sf)
    found = gating.select_columns(works, ["DOI", *gating.columns_like(works, "ref")])
    return flat(
        found.select(
            "DOI",
            "prefix",
            F.col("reference-count").alias("reference_count"),
            F.col("is-referenced-by-count").alias("cited_by"),
            F.coalesce(F.array_size("reference"), F.lit(0)).alias("n_references"),
        )
    )


# --- text ----------------------------------------------------------------------------------


def strip_html(spark, sf):
    pages = views.table(spark, sf, "pages").select(
        "page_id", tx.strip_html(F.col("html")).alias("text")
    )
    return flat(pages.select("page_id", *digest(F.col("text"))))


def clean_reference(spark, sf):
    refs = gating.author_first_refs(views.works(spark, sf))
    return flat(refs.withColumn("text", tx.clean_reference(F.col("text"))))


def tokenize(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id", tx.tokenize(F.col("text")).alias("tokens")
    )
    return flat(
        docs.select(
            "doc_id",
            F.array_size("tokens").alias("n_tokens"),
            F.md5(F.array_join("tokens", " ")).alias("digest"),
        )
    )


def _kept_by_type(spark, sf, ref_type):
    kept = kept_tokens(spark, sf, ref_type)
    return kept.groupBy("token").agg(F.count("*").alias("n"))


def free_text_stop_words(spark, sf):
    return _kept_by_type(spark, sf, UNSTRUCTURED)


def author_stop_words(spark, sf):
    return _kept_by_type(spark, sf, AUTHORS)


def strip_digits(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", *digest(tx.strip_digits(F.col("text"))))


def squash_names(spark, sf):
    refs = views.works(spark, sf).select(F.explode("reference").alias("r"))
    names = refs.filter(F.col("r.author").isNotNull()).select(tx.squash(F.col("r.author")).alias("a"))
    return profile.term_counts(names, "a")


def clean_titles(spark, sf):
    works = views.works(spark, sf).select("DOI", wx.first_title(F.col("title")).alias("title"))
    return titles.clean_titles(works)


def flat_results(spark, sf):
    frame = flatten_results(results(spark, sf))
    return flat(
        frame.select(
            "DOI", "separated_tokens", "container_title", "print_issn", "electronic_issn", "ref_pge"
        )
    )


def title_flags(spark, sf):
    frame = reports.with_title_flags(flatten_results(results(spark, sf)))
    return frame.select("DOI", "title_flag", "container_title_flag")


def author_flag(spark, sf):
    """The flag for every work's first reference word rather than for dominated works only."""
    works = gating.project_work(views.works(spark, sf))
    word = F.array(F.regexp_extract("title", tx.TOKEN, 0))
    flag = wx.author_flag(word, F.col("author"))
    return works.select("DOI", flag.alias("flag"))


def with_author(spark, sf):
    found = reports.with_author(results(spark, sf), "autoren")
    return flat(found.select("DOI", "author", "title"))


# --- aggregations --------------------------------------------------------------------------


def token_counts(spark, sf):
    return flat(tk.token_counts(kept_tokens(spark, sf)))


def dominant_tokens(spark, sf):
    return flat(tk.dominant_tokens(tk.token_counts(kept_tokens(spark, sf), by_work=True)))


def token_fraction(spark, sf):
    # Read for tokens and for lengths, and cleaned by many patterns: written once instead.
    refs = stored(cleaned(spark, sf), "cleaned", "zstd")
    best = tk.dominant_tokens(tk.token_counts(kept_tokens(spark, sf, refs=refs), by_work=True))
    scored = tk.token_fraction(best, tk.cleaned_lengths(refs), min_fraction=0.1)
    return flat(
        scored.select("DOI", "token_vocabulary", "token_frac_refs", "cleaned_references_length")
    )


def dominant_token_works(spark, sf):
    found = dominant.dominant_token_works(views.works(spark, sf), stop_lists(spark, sf))
    return flat(
        found.select(
            "DOI", "token_vocabulary", "token_frac_refs", "total_processed_ref_len",
            "cleaned_references_length", "total_reference_length", "work_type", "author", "flag",
            "member", "title", "container_title",
        )
    )


def dominant_token_works_low(spark, sf):
    found = dominant.dominant_token_works(views.works(spark, sf), stop_lists(spark, sf), 0.05)
    return flat(found.select("DOI", "token_vocabulary", "token_frac_refs", "flag"))


def term_counts(spark, sf):
    stop = stop_words(spark, sf).filter(F.col("ref_type") == UNSTRUCTURED)
    return profile.term_counts(views.table(spark, sf, "documents"), "text", stop, more_than=9)


def vocabulary(spark, sf):
    return profile.vocabulary(views.table(spark, sf, "documents"), "text")


def reference_profile(spark, sf):
    return flat(profile.reference_profile(views.works(spark, sf)))


def share_histogram(spark, sf):
    shared = gating.processable_share(views.works(spark, sf))
    return flat(profile.share_histogram(shared))


def work_type_counts(spark, sf):
    frame = flatten_results(results(spark, sf))
    return profile.work_type_counts(frame, None, ["DOI", "author", "title", "print_issn"])


def book_type_counts(spark, sf):
    return profile.work_type_counts(results(spark, sf), ["book", "book-chapter", "book-part"])


def work_types(spark, sf):
    return profile.work_types(results(spark, sf))


def most_common_tokens(spark, sf):
    return profile.most_common_tokens(reports.unflagged_articles(prepared(spark, sf), 2))


def token_list(spark, sf):
    return profile.token_list(flatten_results(results(spark, sf)), "Autoren")


def fraction_distribution(spark, sf):
    frame = flatten_results(results(spark, sf))
    return flat(profile.fraction_distribution(frame, "book-chapter", "Autoren"))


def token_authors(spark, sf):
    return profile.token_authors(flatten_results(results(spark, sf)), "Autoren", 3)


def top_repeated_titles(spark, sf):
    return profile.top_repeated_titles(tfidf.tfidf_pairs(first_titles(spark, sf)))


# --- counts that keep rows -----------------------------------------------------------------


def _group_count(name):
    def query(spark, sf):
        return flat(prepared(spark, sf, [name]).select("DOI", *COUNTS[name], name))

    return query


def issn_counts(spark, sf):
    frame = flatten_results(results(spark, sf))
    for issn in ("print_issn", "electronic_issn"):
        frame = grouping.count_over(frame, [issn], f"{issn}_counts")
    return flat(frame.select("DOI", "print_issn_counts", "electronic_issn_counts"))


def first_per_token(spark, sf):
    frame = prepared(spark, sf)
    order = grouping.descending(
        "token_counts_by_electronic_issn",
        "token_counts_by_print_issn",
        "token_counts_by_container_title",
    )
    kept = grouping.keep_first(frame, "separated_tokens", [*order, F.col("DOI")])
    return flat(kept.select("separated_tokens", "DOI", "token_counts_by_electronic_issn"))


def duplicated_titles(spark, sf):
    works = gating.project_work(views.works(spark, sf)).select("DOI", "title", "work_type")
    return grouping.keep_duplicated(works, "title")


def pairs_per_id(spark, sf):
    pairs = stored(tfidf.tfidf_pairs(first_titles(spark, sf)), "pairs")
    counted = reports.pairs_per_id(pairs)
    return flat(counted.select("id1", "id2", "DOI_counts"))


def prepared_frame(spark, sf):
    return flat(prepare(results(spark, sf)).drop("token_vocabulary"))


# --- reports -------------------------------------------------------------------------------


def journal_articles(spark, sf):
    return flat(reports.journal_articles(prepared(spark, sf)))


def flagged_articles(spark, sf):
    return flat(reports.flagged_articles(prepared(spark, sf)))


def unflagged_articles(spark, sf):
    return flat(reports.unflagged_articles(prepared(spark, sf)))


def unflagged_people(spark, sf):
    return flat(reports.unflagged_people(prepared(spark, sf), views.people(spark, sf), 2))


def duplicate_titles(spark, sf):
    return flat(reports.duplicate_titles(flatten_results(results(spark, sf))))


def _reported(spark, sf):
    frame = prepared(spark, sf)
    return frame, reports.flagged_articles(frame), reports.unflagged_people(
        frame, views.people(spark, sf)
    )


def flagged_or_unflagged(spark, sf):
    frame, flagged, people = _reported(spark, sf)
    return flat(reports.flagged_or_unflagged(frame, flagged, people).select("DOI", "flag", "title"))


def other_duplicate_titles(spark, sf):
    frame, flagged, people = _reported(spark, sf)
    done = sets.stack(flagged.select("DOI"), people.select("DOI"))
    return flat(
        reports.other_duplicate_titles(frame, done).select("DOI", "title", "container_title")
    )


def books(spark, sf):
    return flat(reports.books(prepared(spark, sf, [])))


def book_chapters(spark, sf):
    return flat(reports.book_chapters(prepared(spark, sf, [])))


def titled_not_authored(spark, sf):
    return flat(reports.titled_not_authored(reports.book_chapters(prepared(spark, sf, []))))


def _work_type(kind):
    def query(spark, sf):
        return flat(reports.by_work_type(prepared(spark, sf, []), kind))

    return query


def unequal_lengths(spark, sf):
    lost = reports.unequal_lengths(results(spark, sf))
    return flat(
        lost.select("DOI", "total_processed_ref_len", "cleaned_references_length", "unequal")
    )


def few_left(spark, sf):
    lost = reports.unequal_lengths(results(spark, sf), below=40)
    return flat(lost.select("DOI", "total_processed_ref_len", "cleaned_references_length"))


def full_coverage(spark, sf):
    return flat(reports.result_slice(results(spark, sf), full=True).select("DOI", "token_frac_refs"))


def partial_coverage(spark, sf):
    found = reports.result_slice(results(spark, sf), full=False)
    return flat(found.select("DOI", "token_frac_refs"))


def flagged_slice(spark, sf):
    found = reports.result_slice(
        results(spark, sf), full=False, flag="Yes", work_type="journal-article"
    )
    return flat(found.select("DOI", "token_frac_refs", "flag"))


def not_journal_slice(spark, sf):
    found = reports.result_slice(results(spark, sf), except_type="journal-article")
    return flat(found.select("DOI", "token_frac_refs", "work_type"))


def top_works(spark, sf):
    found = reports.top_works(
        views.works(spark, sf), ["`reference-count`", "`is-referenced-by-count`"], 10
    )
    return flat(
        found.select(
            "DOI",
            F.col("reference-count").alias("reference_count"),
            F.col("is-referenced-by-count").alias("cited_by"),
        )
    )


def references_by_author(spark, sf):
    names = ["Autoren The and", "Autoren The", "The", "De la", "Autorfr Le"]
    found = reports.references_by_author(views.works(spark, sf), names)
    return found.select("DOI", "key", "author")


def by_token(spark, sf):
    found = reports.by_token(flatten_results(results(spark, sf)), ["Autorfr", "Autorde"])
    return flat(found.select("DOI", "separated_tokens", "token_frac_refs"))


# --- journals ------------------------------------------------------------------------------


def journals_ranked(spark, sf):
    return flat(journals.journals_ranked(prepared(spark, sf, ["container_title_work_type_counts"])))


def _top_journals(spark, sf):
    ranked = journals.journals_ranked(prepared(spark, sf, ["container_title_work_type_counts"]))
    return journals.top_journals(ranked)


def top_journals(spark, sf):
    return flat(_top_journals(spark, sf))


def issn_evidence(spark, sf):
    evidence = journals.issn_evidence(_top_journals(spark, sf))
    return evidence.select("container_title", "eq_e", "eq_p", "dup_e", "dup_p")


def actual_counts(spark, sf):
    counted = journals.actual_counts(journals.issn_evidence(_top_journals(spark, sf)))
    return flat(counted.select("container_title", "actual_counts"))


def unique_journals(spark, sf):
    kept = journals.unique_journals(_top_journals(spark, sf))
    return kept.select("container_title", "print_issn", "electronic_issn")


def journal_info(spark, sf):
    found = journals.with_journal_info(_top_journals(spark, sf), views.journals(spark, sf))
    return found.select("container_title", "electronic_issn", "journal_title", "total_dois")


def journal_report(spark, sf):
    frame = prepared(spark, sf, ["container_title_work_type_counts"])
    return flat(journals.journal_report(frame, views.journals(spark, sf)))


# --- joins and sets ------------------------------------------------------------------------


def _keyed_pairs(spark, sf):
    pairs = tfidf.tfidf_pairs(first_titles(spark, sf)).filter(F.col("id1") != F.col("id2"))
    return pairs.select(F.col("id1").alias("DOI"), F.col("id2").alias("DOI2"), "score")


def _articles(spark, sf):
    works = gating.project_work(views.works(spark, sf, references=False))
    return works.withColumn(
        "print_issn", wx.issn_of_type(F.col("issn"), "print")
    ).withColumn("electronic_issn", wx.issn_of_type(F.col("issn"), "electronic")).withColumn(
        "container_title", wx.container_name(F.col("container_title"))
    ).select(SIMILAR_TITLE_COLUMNS)


def join_pairs(spark, sf):
    joined = sets.join_pairs(_articles(spark, sf).select("DOI", "title", "member"), _keyed_pairs(spark, sf))
    return flat(joined)


def join_partner(spark, sf):
    joined = sets.join_partner(
        _keyed_pairs(spark, sf), _articles(spark, sf), {"author": "doi2_author", "member": "doi2_member"}
    )
    return flat(joined)


def pair_attributes(spark, sf):
    return flat(sets.pair_attributes(_keyed_pairs(spark, sf), _articles(spark, sf)))


def without_ids(spark, sf):
    works = views.works(spark, sf).select("DOI", "member")
    return sets.without_ids(works, views.toxic_dois(spark, sf))


def with_ids(spark, sf):
    works = views.works(spark, sf).select("DOI", "member")
    return sets.with_ids(works, views.toxic_dois(spark, sf))


def stack(spark, sf):
    frame = results(spark, sf)
    return sets.stack(
        reports.result_slice(frame, flag="Yes").select("DOI", "flag", "title"),
        reports.result_slice(frame, work_type="book").select("DOI", "flag", "member"),
    )


def _issn_tables(spark, sf):
    frame = flatten_results(results(spark, sf))
    flagged, rest = (
        frame.filter(F.col("flag") == flag).select("electronic_issn") for flag in ("Yes", "No")
    )
    return flagged, rest


def key_difference(spark, sf):
    flagged, rest = _issn_tables(spark, sf)
    return sets.key_difference(rest, flagged, "electronic_issn")


def key_intersection(spark, sf):
    flagged, rest = _issn_tables(spark, sf)
    return sets.key_intersection(rest, flagged, "electronic_issn")


# --- similarity ----------------------------------------------------------------------------


def tfidf_weights(spark, sf):
    return flat(tfidf.tfidf(first_titles(spark, sf)))


def tfidf_pairs(spark, sf):
    return flat(tfidf.tfidf_pairs(first_titles(spark, sf)))


def tfidf_pairs_half(spark, sf):
    pairs = tfidf.tfidf_pairs(first_titles(spark, sf), 0.5)
    return flat(pairs.select("id1", "id2", "score", "n_pairs"))


def embedding_pairs(spark, sf):
    return flat(embeddings.embedding_pairs(views.table(spark, sf, "embeddings")))


def embedding_pairs_low(spark, sf):
    return flat(embeddings.embedding_pairs(views.table(spark, sf, "embeddings"), 0.3))


def score_band(spark, sf):
    pairs = tfidf.score_band(tfidf.tfidf_pairs(first_titles(spark, sf)))
    return flat(pairs.select("id1", "id2", "score"))


def top_pair(spark, sf):
    pairs = tfidf.tfidf_pairs(first_titles(spark, sf)).filter(F.col("id1") != F.col("id2"))
    return flat(tfidf.top_pair(pairs).select("id1", "id2", "score"))


def jaccard_pairs(spark, sf):
    return flat(characters.jaccard_pairs(first_titles(spark, sf), 0.8))


def edit_pairs(spark, sf):
    pairs = characters.edit_pairs(first_titles(spark, sf), 0.8, transpositions=False)
    return flat(pairs.select("id1", "id2", "score", "n_pairs"))


def swap_edit_pairs(spark, sf):
    pairs = characters.edit_pairs(first_titles(spark, sf), 0.8)
    return flat(pairs.select("id1", "id2", "score", "n_pairs"))


def title_members(spark, sf):
    return copies.members(first_titles(spark, sf), "title")


def similar_title_report(spark, sf):
    articles = stored(_articles(spark, sf), "articles")
    cleaned = stored(titles.clean_titles(articles, STOP_TITLES).filter(F.col("title") != ""), "cleaned")
    pairs = stored(tfidf.tfidf_scores(cleaned), "title-pairs")
    return flat(titles.similar_title_report(articles, pairs, cleaned))


def similar_vector_report(spark, sf):
    """The same report from vectors: works with an embedding, which is what is compared."""
    articles = stored(_articles(spark, sf), "articles")
    vectors = views.table(spark, sf, "embeddings").select(
        F.concat(F.lit("10.5555/"), "vec_id").alias("DOI"), F.col("embedding").alias("title"))
    pairs = stored(embeddings.embedding_pairs(vectors, 0.45, "DOI", "title"), "vector-pairs")
    report = titles.similar_title_report(articles, pairs, vectors)
    return flat(report.select("DOI", "DOI2", "score", "n_partners", "DOI_counts", "container_title", "container_title_counts"))


QUERIES = {
    "read_snapshot": read_snapshot,
    "read_items": read_items,
    "read_ignore_lists": read_ignore_lists,
    "read_results": read_results,
    "report_round_trip": report_round_trip,
    "min_refs": min_refs,
    "processable_refs": processable_refs,
    "author_first_refs": author_first_refs,
    "share_gate": share_gate,
    "processable_share": processable_share,
    "project_work": project_work,
    "author_names": author_names,
    "has_references": has_references,
    "select_columns": select_columns,
    "deposited_year": deposited_year,
    "article_layout": article_layout,
    "report_nulls": report_nulls,
    "by_id": by_id,
    "columns_like": columns_like,
    "strip_html": strip_html,
    "clean_reference": clean_reference,
    "tokenize": tokenize,
    "free_text_stop_words": free_text_stop_words,
    "author_stop_words": author_stop_words,
    "strip_digits": strip_digits,
    "squash_names": squash_names,
    "clean_titles": clean_titles,
    "flat_results": flat_results,
    "title_flags": title_flags,
    "author_flag": author_flag,
    "with_author": with_author,
    "token_counts": token_counts,
    "dominant_tokens": dominant_tokens,
    "token_fraction": token_fraction,
    "dominant_token_works": dominant_token_works,
    "dominant_token_works_low": dominant_token_works_low,
    "term_counts": term_counts,
    "vocabulary": vocabulary,
    "reference_profile": reference_profile,
    "share_histogram": share_histogram,
    "work_type_counts": work_type_counts,
    "book_type_counts": book_type_counts,
    "work_types": work_types,
    "most_common_tokens": most_common_tokens,
    "token_list": token_list,
    "fraction_distribution": fraction_distribution,
    "token_authors": token_authors,
    "top_repeated_titles": top_repeated_titles,
    **{name: _group_count(name) for name in COUNTS},
    "issn_counts": issn_counts,
    "first_per_token": first_per_token,
    "duplicated_titles": duplicated_titles,
    "pairs_per_id": pairs_per_id,
    "prepared_frame": prepared_frame,
    "journal_articles": journal_articles,
    "flagged_articles": flagged_articles,
    "unflagged_articles": unflagged_articles,
    "unflagged_people": unflagged_people,
    "duplicate_titles": duplicate_titles,
    "flagged_or_unflagged": flagged_or_unflagged,
    "other_duplicate_titles": other_duplicate_titles,
    "books": books,
    "book_chapters": book_chapters,
    "titled_not_authored": titled_not_authored,
    "proceedings_articles": _work_type("proceedings-article"),
    "posted_content": _work_type("posted-content"),
    "other_works": _work_type("other"),
    "unequal_lengths": unequal_lengths,
    "few_left": few_left,
    "full_coverage": full_coverage,
    "partial_coverage": partial_coverage,
    "flagged_slice": flagged_slice,
    "not_journal_slice": not_journal_slice,
    "top_works": top_works,
    "references_by_author": references_by_author,
    "by_token": by_token,
    "journals_ranked": journals_ranked,
    "top_journals": top_journals,
    "issn_evidence": issn_evidence,
    "actual_counts": actual_counts,
    "unique_journals": unique_journals,
    "journal_info": journal_info,
    "journal_report": journal_report,
    "join_pairs": join_pairs,
    "join_partner": join_partner,
    "pair_attributes": pair_attributes,
    "without_ids": without_ids,
    "with_ids": with_ids,
    "stack": stack,
    "key_difference": key_difference,
    "key_intersection": key_intersection,
    "tfidf_weights": tfidf_weights,
    "tfidf_pairs": tfidf_pairs,
    "tfidf_pairs_half": tfidf_pairs_half,
    "embedding_pairs": embedding_pairs,
    "embedding_pairs_low": embedding_pairs_low,
    "score_band": score_band,
    "top_pair": top_pair,
    "jaccard_pairs": jaccard_pairs,
    "edit_pairs": edit_pairs,
    "swap_edit_pairs": swap_edit_pairs,
    "title_members": title_members,
    "similar_title_report": similar_title_report,
    "similar_vector_report": similar_vector_report,
}
