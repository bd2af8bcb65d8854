"""The same queries as SQL over the given tables, in long relational form."""

from __future__ import annotations

import html.entities
from functools import cache

from pyspark.sql import SparkSession

from refsieve import fixed_values as fx
from refsieve.operators import tokens
from refsieve.plans.prepare import COUNTS

WORD = r"[\p{L}\p{N}_]"
TOKEN = WORD + "{2,15}"
TERM = WORD + "{2,}"
SPACES = r"\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, '', 'g')"


def clean(expr: str) -> str:
    for pattern in (
        f"doi:[^\\n]*?[{SPACES}]", "<[^\\n]*?>", "&[^\\n]*?;", f"http[^{SPACES}]+", r"\p{Nd}+",
        "_+", r"\.", "-", r"[\[|\]]",
    ):
        expr = replaced(expr, pattern)
    return expr


def clean_title(expr: str) -> str:
    for pattern in ("&[^\\n]*?;", "SUB", "<[^\\n]*?>"):
        expr = replaced(expr, pattern)
    return expr


@cache
def entity_map() -> str:
    pairs = html.entities.html5.items()
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs) + "}"


@cache
def open_entities() -> str:
    names = [name for name in html.entities.html5 if not name.endswith(";")]
    return quoted("^(" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")")


def character(code: str) -> str:
    return (
        f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 "
        f"THEN chr(({code})::INTEGER) END"
    )


def visible(expr: str) -> str:
    """Text of markup without hidden blocks, tags and entities."""
    stripped = expr
    for pattern in (
        r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
        r"|<template\b.*?(?:</template\s*>|\z)|<!--.*?(?:-->|\z)",
        r"(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>",
    ):
        stripped = replaced(stripped, pattern)
    decimal = "TRY_CAST(regexp_extract(p, '^#0*([0-9]{1,7});', 1) AS BIGINT)"
    hexadecimal = "TRY_CAST('0x' || regexp_extract(p, '^#[xX]0*([0-9A-Fa-f]{1,6});', 1) AS BIGINT)"
    decoded = (
        f"coalesce({entity_map()}[regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*;)', 1)], "
        f"{character(decimal)}, {character(hexadecimal)})"
    )
    name = f"regexp_extract(p, {open_entities()}, 1)"
    opened = f"{entity_map()}[{name}] || substr(p, length({name}) + 1)"
    return (
        f"CASE WHEN regexp_matches({expr}, '[<&]') THEN array_to_string(list_transform("
        f"string_split({stripped}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE "
        f"coalesce({decoded} || substr(p, strpos(p, ';') + 1), {opened}, '&' || p) END), '') "
        f"ELSE {expr} END"
    )


@cache
def language_words() -> list[str]:
    """Stop words of the running session, which is started when there is none."""
    SparkSession.builder.getOrCreate()
    return tokens.language_words()


@cache
def stop_rows() -> str:
    free = {w.lower() for w in language_words() + fx.DOMAIN_WORDS + fx.MONTHS}
    author = {w.lower() for w in fx.AUTHOR_WORDS}
    rows = [("unstructured", w) for w in sorted(free)] + [("authors", w) for w in sorted(author)]
    return ", ".join(f"({quoted(kind)}, {quoted(word)})" for kind, word in rows)


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


PERCENT = "round_even(n_proc::DOUBLE / nullif(ref_count, 0) * 100, 0)"

# Named parts in dependency order: name -> (parts it reads, SQL).
PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], sql: str) -> None:
    PARTS[name] = (needs, sql)


part("sentences", [], f"""
SELECT doc_id, lang, source, n_chars, text, list_filter(list_transform(
  regexp_split_to_array(text, '[.\\n]+'), lambda p: trim(p, ' ')),
  lambda p: regexp_matches(p, '{TERM}')) AS parts
FROM documents""")
part("refs", ["sentences"], """
SELECT doc_id, i,
  CASE WHEN i % 10 <> 0 AND i % 3 <> 0 THEN body END AS unstructured,
  CASE WHEN i % 10 <> 0 AND i % 3 = 0 THEN body END AS author,
  CASE WHEN i % 10 = 0 THEN '10.5555/r' || i END AS ref_doi
FROM (SELECT doc_id, i, CASE WHEN i % 33 = 21 THEN 'http://ref.example/' || i
        WHEN i % 11 = 4 THEN 'doi:10.1000/182 ' || planted
        WHEN i % 11 = 7 THEN '<i>Vol. 12</i> &amp; ' || planted
        WHEN i % 11 = 9 THEN 'http://ref.example/x ' || planted ELSE planted END AS body
  FROM (SELECT doc_id, i, CASE WHEN doc_id % 4 = 0 AND (i % 10 < 7 OR doc_id % 36 = 0)
          THEN 'Autor' || lang || ' ' || p ELSE p END AS planted
    FROM (SELECT doc_id, lang, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i
          FROM sentences)))""")
part("works", ["sentences"], f"""
SELECT doc_id, '10.5555/' || doc_id AS doi,
  CASE WHEN k <= 4 THEN 'journal-article' WHEN k = 5 THEN 'other' WHEN k = 6 THEN 'book'
    WHEN k = 7 THEN 'book-chapter' WHEN k = 8 THEN 'proceedings-article'
    ELSE 'posted-content' END AS work_type,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN ''
    WHEN doc_id % 12 = 0 THEN 'Autor' || lang || ' ' || parts[1] ELSE parts[1] END AS title,
  CASE WHEN doc_id % 13 <> 0 THEN lower(concat_ws(', ', nullif(CASE WHEN doc_id % 8 = 0
    THEN 'Autor' || lang ELSE regexp_extract(text, '{TERM}') END, ''),
    nullif(substr(source, 1, 4), ''))) END AS author,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 16 = 0 THEN 'Autor' || lang || ' Annals'
    WHEN doc_id % 5 < 2 THEN 'Journal ' || lang || ' ' || source
    ELSE 'Journal ' || lang END AS container_title,
  CASE WHEN doc_id % 7 <> 0 THEN 'P' || source END AS print_issn,
  CASE WHEN doc_id % 9 <> 0 THEN 'E' || source END AS electronic_issn,
  source AS member, len(parts) AS n_refs, len(parts) + doc_id % 5 AS ref_count,
  n_chars % 97 AS cited_by
FROM (SELECT *, doc_id // 8 % 10 AS k FROM sentences)""")
part("proc", ["refs"], f"""
SELECT doc_id, i, ref_type, text FROM (
  SELECT doc_id, i, CASE WHEN unstructured IS NOT NULL THEN 'unstructured'
      WHEN author IS NOT NULL THEN 'authors' END AS ref_type,
    CASE WHEN unstructured IS NOT NULL THEN {clean(f"substr({visible('unstructured')}, 1, 50)")}
      WHEN author IS NOT NULL THEN {visible('author')} END AS text
  FROM refs) WHERE regexp_matches(text, '{TOKEN}')""")
part("cleaned", ["proc"], f"""
SELECT * FROM (SELECT doc_id, i, ref_type, {clean('text')} AS text FROM proc)
WHERE regexp_matches(text, '{TOKEN}')""")
part("ignored", [], f"""
SELECT DISTINCT word FROM (SELECT lower(n_name) AS word FROM nation UNION ALL
  SELECT lower(regexp_extract(text, '{TERM}')) FROM benchmark) WHERE word <> ''""")
part("stop", ["ignored"], """
SELECT * FROM (VALUES @STOP@) AS v(ref_type, word)
UNION SELECT t.ref_type, word FROM ignored, (VALUES ('unstructured'), ('authors')) AS t(ref_type)""")
part("kept", ["cleaned", "stop"], f"""
SELECT t.* FROM (SELECT doc_id, i, ref_type, unnest(regexp_extract_all(text, '{TOKEN}')) AS token
  FROM cleaned) AS t
WHERE NOT EXISTS (SELECT 1 FROM stop s
  WHERE s.ref_type = t.ref_type AND s.word = lower(t.token))""")
part("counts", ["kept"], """
SELECT doc_id, token, count(*) AS token_count, count(DISTINCT i) AS reference_count
FROM kept GROUP BY doc_id, token""")
part("best", ["counts"], """
SELECT doc_id, any_value(reference_count) AS reference_count,
  any_value(token_count) AS token_count, list(token ORDER BY token) AS vocabulary
FROM (SELECT *, rank() OVER (PARTITION BY doc_id
        ORDER BY reference_count DESC, token_count DESC) AS place FROM counts)
WHERE place = 1 GROUP BY doc_id""")
part("proc_counts", ["proc"], "SELECT doc_id, count(*) AS n_proc FROM proc GROUP BY doc_id")
part("clean_counts", ["cleaned"], "SELECT doc_id, count(*) AS n_clean FROM cleaned GROUP BY doc_id")
part("gated", ["works", "proc_counts"], f"""
SELECT w.*, n_proc, {PERCENT}::BIGINT AS ptge FROM works w JOIN proc_counts USING (doc_id)
WHERE n_proc >= 25 AND {PERCENT} >= 30""")
part("dominated", ["gated", "clean_counts", "best"], f"""
SELECT g.*, n_clean, vocabulary, reference_count / n_clean AS share,
  round(CAST(CAST(reference_count / n_clean AS FLOAT) AS DOUBLE), 6) AS token_frac_refs,
  array_to_string(vocabulary, ', ') AS separated_tokens,
  array_to_string(vocabulary, '|') AS token_vocabulary,
  CASE WHEN len(list_intersect(list_transform(vocabulary, lambda v: lower(v)), list_transform(
      string_split(author, ','), lambda a: regexp_replace(a, '[^\\p{{L}}\\p{{N}}_]', '', 'g')))) > 0
    THEN 'Yes' ELSE 'No' END AS flag,
  round(n_clean / n_refs, 6) AS ref_pge
FROM gated g JOIN clean_counts USING (doc_id) JOIN best USING (doc_id)
WHERE n_clean >= 25 AND n_refs > 25""")
part("results", ["dominated"], """
SELECT doi AS "DOI", * EXCLUDE (doi), n_proc AS total_processed_ref_len,
  n_clean AS cleaned_references_length, n_refs AS total_reference_length
FROM dominated WHERE share >= 0.5""")


def count_window(keys: list[str]) -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"CASE WHEN {present} THEN count(*) OVER (PARTITION BY {', '.join(keys)}) END"


part("prepared", ["results"], "SELECT *, " + ", ".join(
    f"{count_window(keys)} AS {name}" for name, keys in COUNTS.items()) + " FROM results")
part("titled", ["works"], """
SELECT doi AS id, max(title) AS title FROM works WHERE title <> '' GROUP BY doi""")


def pair_parts(prefix: str, source: str) -> None:
    """Title groups, unit weights and scores of all pairs that share a term."""
    g, v, s = f"{prefix}groups", f"{prefix}weights", f"{prefix}scores"
    part(g, [source], f"""
SELECT title AS value, min(id) AS id, count(*) AS copies FROM {source} GROUP BY title""")
    part(f"{prefix}bag", [g], f"""
SELECT id, copies, term, count(*) AS tf FROM (
  SELECT id, copies, unnest(regexp_extract_all(lower(value), '{TERM}')) AS term FROM {g})
GROUP BY id, copies, term""")
    part(v, [f"{prefix}bag", g], f"""
SELECT id, copies, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
FROM (SELECT id, copies, term, tf * (ln((1 + (SELECT sum(copies) FROM {g})) / (1 + df)) + 1) AS w
  FROM {prefix}bag JOIN (SELECT term, sum(copies) AS df FROM {prefix}bag GROUP BY term)
    USING (term))""")
    part(s, [v, g], f"""
SELECT a.id AS id1, b.id AS id2, any_value(a.copies) AS copies1, any_value(b.copies) AS copies2,
  sum(a.weight * b.weight) AS score
FROM {v} a JOIN {v} b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id""")
    part(f"{prefix}self", [g], f"""
SELECT id AS id1, id AS id2, copies AS copies1, copies AS copies2, 1.0::DOUBLE AS score,
  copies * (copies - 1) // 2 AS n_pairs
FROM {g} WHERE copies > 1 AND regexp_matches(value, '{TERM}')""")
    for name, threshold in (("pairs", 0.8), ("half", 0.5)):
        part(f"{prefix}{name}", [s, f"{prefix}self", g], f"""
SELECT p.*, x.value AS title1, y.value AS title2 FROM (
  SELECT *, copies1 * copies2 AS n_pairs FROM {s} WHERE score >= {threshold}
  UNION ALL BY NAME SELECT * FROM {prefix}self) p
JOIN {g} x ON x.id = id1 JOIN {g} y ON y.id = id2""")


pair_parts("", "titled")
part("clean_titled", ["works"], f"""
SELECT doi AS id, title FROM (SELECT doi, {clean_title('title')} AS title FROM works)
WHERE title NOT IN ({listed(fx.STOP_TITLES)})""")
part("clean_titled_full", ["clean_titled"], "SELECT * FROM clean_titled WHERE title <> ''")
pair_parts("clean_", "clean_titled_full")
part("char_bag", ["groups"], """
SELECT id, copies, length(value) AS size, c, count(*) AS n FROM (
  SELECT id, copies, value, unnest(regexp_extract_all(value, '(?s).')) AS c FROM groups)
GROUP BY id, copies, value, c""")
part("vectors", [], """
SELECT value, min(vec_id) AS id, count(*) AS copies FROM (
  SELECT vec_id, embedding::DOUBLE[] AS value FROM embeddings) GROUP BY value""")
part("journals", [], """
SELECT unnest(['P' || source, 'E' || source]) AS issn, 'Quarterly ' || number % 15 AS title,
  total_dois
FROM (SELECT source, regexp_extract(source, '[0-9]+')::INTEGER AS number,
        count(*) * 10 AS total_dois FROM documents GROUP BY source)
WHERE number % 6 <> 5""")
part("people", [], "SELECT DISTINCT 'Autor' || lang AS name FROM documents WHERE lang <> 'en'")
part("toxic", [], "SELECT DISTINCT '10.5555/' || doc_id AS \"DOI\" FROM labels WHERE toxic = 1")

ELECTRONIC_FIRST = (
    "electronic_issn_counts DESC NULLS LAST, print_issn_counts DESC NULLS LAST, "
    "container_title_work_type_counts DESC NULLS LAST"
)
PRINT_FIRST = (
    "print_issn_counts DESC NULLS LAST, electronic_issn_counts DESC NULLS LAST, "
    "container_title_work_type_counts DESC NULLS LAST"
)
JOURNAL_ORDER = (
    "electronic_issn_counts DESC NULLS LAST, container_title_work_type_counts DESC NULLS LAST, "
    "print_issn DESC NULLS LAST, container_title ASC NULLS LAST"
)
part("ranked", ["prepared"], f"""
SELECT container_title, print_issn, electronic_issn, container_title_work_type_counts, member,
  print_issn_counts, electronic_issn_counts
FROM (SELECT *, row_number() OVER (PARTITION BY container_title
        ORDER BY {ELECTRONIC_FIRST}, "DOI") AS place
  FROM (SELECT *, {count_window(['print_issn'])} AS print_issn_counts,
          {count_window(['electronic_issn'])} AS electronic_issn_counts
        FROM prepared WHERE work_type = 'journal-article'))
WHERE place = 1""")
for parts_name, size in (("top_titles", 60), ("report_titles", 60)):
    part(parts_name, ["ranked"], f"""
SELECT DISTINCT * FROM (
  (SELECT * FROM ranked ORDER BY {ELECTRONIC_FIRST}, container_title NULLS LAST LIMIT {size})
  UNION ALL
  (SELECT * FROM ranked ORDER BY {PRINT_FIRST}, container_title NULLS LAST LIMIT {size}))""")
for source, name in (("top_titles", "evidence"), ("report_titles", "report_evidence")):
    part(name, [source], f"""
SELECT *, coalesce(container_title_work_type_counts = electronic_issn_counts, false) AS eq_e,
  coalesce(container_title_work_type_counts = print_issn_counts, false) AS eq_p,
  electronic_issn IS NOT NULL AND count(*) OVER (PARTITION BY electronic_issn) > 1 AS dup_e,
  print_issn IS NOT NULL AND count(*) OVER (PARTITION BY print_issn) > 1 AS dup_p
FROM {source}""")
    part(f"{name}_counts", [name], f"""
SELECT *, CASE WHEN dup_p AND NOT dup_e THEN print_issn_counts
  WHEN dup_e OR eq_e THEN electronic_issn_counts
  WHEN eq_p THEN print_issn_counts ELSE 0 END AS actual_counts FROM {name}""")
    part(f"{name}_unique", [f"{name}_counts"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY electronic_issn, place > 1,
    print_issn IS NOT NULL ORDER BY {JOURNAL_ORDER}) AS other
  FROM (SELECT *, CASE WHEN electronic_issn IS NOT NULL THEN row_number() OVER (
          PARTITION BY electronic_issn ORDER BY {JOURNAL_ORDER}) ELSE 2 END AS place
        FROM {name}_counts))
WHERE place = 1 OR (print_issn IS NOT NULL AND (electronic_issn IS NULL OR other > 1))""")


def columns(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def headed(names, headings) -> str:
    return ", ".join(f'{n} AS "{headings.get(n, n)}"' for n in names)


SELECTS: dict[str, tuple[list[str], str]] = {}


def query(name: str, needs: list[str], sql: str) -> None:
    SELECTS[name] = (needs, sql)


OFTEN = " OR ".join(f"{c} >= {{0}}" for c in fx.BY_ISSN_AND_TITLE)
ARTICLES = columns(fx.ARTICLE_COLUMNS)
N_REFS = "coalesce(n_refs, 0)"

query("read_snapshot", ["works"], """
SELECT doi AS "DOI", work_type AS type, title, container_title, member, '10.5555' AS prefix,
  ref_count AS reference_count, n_refs AS n_references, author FROM works""")
query("read_items", ["works"], """
SELECT doi AS "DOI", work_type AS type, member, n_refs AS n_references FROM works""")
query("read_ignore_lists", [], f"""
SELECT DISTINCT lower(n_name) AS word FROM nation UNION
SELECT lower(regexp_extract(text, '{TERM}')) FROM benchmark""")
ISSN_TEXT = (
    "CASE WHEN print_issn IS NULL AND electronic_issn IS NULL THEN '' "
    "ELSE concat_ws('|', print_issn, electronic_issn) END AS issn"
)
query("read_results", ["results"], f"""
SELECT "DOI", token_vocabulary, token_frac_refs, total_processed_ref_len,
  cleaned_references_length, total_reference_length, work_type, author, flag, member, {ISSN_TEXT},
  title, container_title FROM results""")
REPEATED = f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY title) AS n FROM results
  WHERE work_type = 'journal-article' AND title <> '' AND title NOT IN ({listed(fx.STOP_TITLES)}))
WHERE n > 1"""
query("report_round_trip", ["results"], f"SELECT {columns(fx.DUPLICATE_COLUMNS)} FROM ({REPEATED})")
query("min_refs", ["works"], 'SELECT doi AS "DOI", n_refs AS n_references FROM works WHERE n_refs > 25')
query("processable_refs", ["proc"], """
SELECT '10.5555/' || doc_id AS "DOI", i AS ref_idx, ref_type, text FROM proc""")
query("author_first_refs", ["refs"], """
SELECT '10.5555/' || doc_id AS "DOI", i AS ref_idx, coalesce(author, unstructured) AS text
FROM refs WHERE coalesce(author, unstructured) IS NOT NULL""")
query("share_gate", ["gated"], 'SELECT doi AS "DOI", n_proc AS proc_ref_count, ptge AS proc_ref_ptge FROM gated')
part("raw_share", ["works", "refs"], """
SELECT doi AS "DOI", n_proc AS processable_ref_count, percentage FROM (
  SELECT doi, n_proc, round_even(n_proc::DOUBLE / nullif(ref_count, 0) * 100, 0)::BIGINT AS percentage
  FROM works JOIN (SELECT doc_id, count(*) AS n_proc FROM refs
    WHERE author IS NOT NULL OR unstructured IS NOT NULL GROUP BY doc_id) USING (doc_id))
WHERE percentage > 30 AND n_proc > 5""")
query("processable_share", ["raw_share"], "SELECT * FROM raw_share")
query("project_work", ["works"], f"""
SELECT doi AS "DOI", work_type, author, title, container_title, {ISSN_TEXT}, member, ref_count,
  CASE WHEN n_refs > 0 THEN n_refs END AS total_reference_length FROM works""")
query("author_names", ["works"], 'SELECT doi AS "DOI", author FROM works')
query("has_references", ["works"], 'SELECT doi AS "DOI" FROM works WHERE n_refs > 0')
query("select_columns", ["works"], """
SELECT doi AS "DOI", work_type AS type, member, '10.5555' AS prefix, cited_by FROM works""")
query("deposited_year", [], """
SELECT '10.5555/' || doc_id AS "DOI", 2000 + doc_id % 25 AS deposited_year FROM documents""")
query("article_layout", ["prepared"], "SELECT " + headed(
    [c for c in fx.ARTICLE_COLUMNS if c != "token_counts_by_container_title"],
    fx.ARTICLE_HEADINGS) + " FROM prepared WHERE work_type = 'journal-article'")
query("report_nulls", ["results"], f"""
SELECT "DOI", coalesce(title, '{fx.MISSING}') AS title,
  coalesce(container_title, '{fx.MISSING}') AS container_title,
  coalesce(print_issn, '{fx.MISSING}') AS print_issn, total_reference_length FROM results""")
query("by_id", ["works", "toxic"], """
SELECT doi AS "DOI", work_type AS type, ref_count AS reference_count FROM works
WHERE doi IN (SELECT "DOI" FROM toxic)""")
query("columns_like", ["works"], """
SELECT doi AS "DOI", '10.5555' AS prefix, ref_count AS reference_count, cited_by,
  n_refs AS n_references FROM works""")
query("strip_html", [], f"""
SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (
  SELECT page_id, {visible('html')} AS t FROM pages)""")
query("clean_reference", ["refs"], f"""
SELECT '10.5555/' || doc_id AS "DOI", i AS ref_idx, {clean('text')} AS text
FROM (SELECT doc_id, i, coalesce(author, unstructured) AS text FROM refs) WHERE text IS NOT NULL""")
query("tokenize", [], f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents)""")
for name, kind in (("free_text_stop_words", "unstructured"), ("author_stop_words", "authors")):
    query(name, ["kept"], f"""
SELECT token, count(*) AS n FROM kept WHERE ref_type = '{kind}' GROUP BY token""")
query("strip_digits", [], f"""
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (
  SELECT doc_id, {replaced('text', '[\\p{Nd}]+')} AS t FROM documents)""")
query("squash_names", ["refs"], f"""
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(
  {replaced("replace(author, ' ', '')", '[\\p{Nd}]+')}), '{TERM}')) AS term
  FROM refs WHERE author IS NOT NULL) GROUP BY term""")
query("clean_titles", ["clean_titled"], 'SELECT id AS "DOI", title FROM clean_titled')
query("flat_results", ["results"], """
SELECT "DOI", separated_tokens, container_title, print_issn, electronic_issn, ref_pge FROM results""")
CONTAINED = (
    "CASE WHEN len(list_filter(vocabulary, lambda v: contains(lower({0}), lower(v)))) > 0 "
    "AND {0} <> '' THEN 'Yes' ELSE 'No' END"
)
FLAGS = (
    f"{CONTAINED.format('title')} AS title_flag, "
    f"{CONTAINED.format('container_title')} AS container_title_flag"
)
query("title_flags", ["results"], f'SELECT "DOI", {FLAGS} FROM results')
query("author_flag", ["works"], f"""
SELECT doi AS "DOI", CASE WHEN list_contains(list_transform(string_split(author, ','), lambda a:
  regexp_replace(a, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lower(regexp_extract(title, '{TOKEN}')))
  THEN 'Yes' ELSE 'No' END AS flag FROM works""")
query("with_author", ["results"], """
SELECT "DOI", author, title FROM results WHERE contains(author, 'autoren')""")
query("token_counts", ["counts"], """
SELECT '10.5555/' || doc_id AS "DOI", token, token_count, reference_count FROM counts""")
query("dominant_tokens", ["best"], """
SELECT '10.5555/' || doc_id AS "DOI", reference_count, token_count,
  array_to_string(vocabulary, '|') AS token_vocabulary FROM best""")
query("token_fraction", ["best", "clean_counts"], """
SELECT '10.5555/' || doc_id AS "DOI", array_to_string(vocabulary, '|') AS token_vocabulary,
  round(CAST(CAST(reference_count / n_clean AS FLOAT) AS DOUBLE), 6) AS token_frac_refs,
  n_clean AS cleaned_references_length
FROM best JOIN clean_counts USING (doc_id)
WHERE n_clean >= 25 AND reference_count / n_clean >= 0.1""")
query("dominant_token_works", ["results"], """
SELECT "DOI", token_vocabulary, token_frac_refs, total_processed_ref_len,
  cleaned_references_length, total_reference_length, work_type, author, flag, member, title,
  container_title FROM results""")
query("dominant_token_works_low", ["dominated"], """
SELECT doi AS "DOI", token_vocabulary, token_frac_refs, flag FROM dominated WHERE share >= 0.05""")
ALL_TERMS = f"""
SELECT unnest(regexp_extract_all(lower({replaced('text', '[\\p{Nd}]+')}), '{TERM}')) AS term
FROM documents"""
query("term_counts", ["stop"], f"""
SELECT term, count(*) AS n FROM ({ALL_TERMS})
WHERE term NOT IN (SELECT word FROM stop WHERE ref_type = 'unstructured')
GROUP BY term HAVING count(*) > 9""")
query("vocabulary", [], f"SELECT DISTINCT term FROM ({ALL_TERMS})")
query("reference_profile", ["works", "refs"], """
SELECT doi AS "DOI", count(unstructured) AS unstructured,
  count(i) FILTER (unstructured IS NULL) AS structured, count(r.author) AS authors,
  count(ref_doi) FILTER (unstructured IS NULL AND r.author IS NULL) AS only_doi,
  count(i) FILTER (unstructured IS NULL AND r.author IS NULL AND ref_doi IS NULL) AS other
FROM works LEFT JOIN refs r USING (doc_id) GROUP BY doi""")
query("share_histogram", ["raw_share"], """
SELECT percentage, count(*) AS freq FROM raw_share GROUP BY percentage""")
query("work_type_counts", ["results"], """
SELECT work_type, count(*) AS "DOI", count(author) AS author, count(title) AS title,
  count(print_issn) AS print_issn FROM results GROUP BY work_type""")
query("book_type_counts", ["results"], """
SELECT work_type, count(*) AS "DOI" FROM results
WHERE work_type IN ('book', 'book-chapter', 'book-part') GROUP BY work_type""")
query("work_types", ["results"], "SELECT DISTINCT work_type FROM results")
part("unflagged", ["prepared"], f"""
SELECT * FROM prepared WHERE work_type = 'journal-article' AND flag = 'No'
  AND ({OFTEN.format(2)})""")
query("most_common_tokens", ["unflagged"], "SELECT DISTINCT separated_tokens FROM unflagged WHERE " +
      " OR ".join(f"{c} = (SELECT max({c}) FROM unflagged)" for c in fx.BY_ISSN_AND_TITLE))
query("token_list", ["results"], """
SELECT DISTINCT separated_tokens FROM results WHERE separated_tokens <> 'Autoren'""")
query("fraction_distribution", ["results"], """
SELECT token_frac_refs, count(*) AS n FROM results
WHERE work_type = 'book-chapter' AND separated_tokens = 'Autoren' GROUP BY token_frac_refs""")
query("token_authors", ["results"], """
SELECT author AS sep_author, count(*) AS n FROM results
WHERE work_type = 'journal-article' AND separated_tokens = 'Autoren' AND author IS NOT NULL
GROUP BY author ORDER BY n DESC, author LIMIT 3""")
query("top_repeated_titles", ["pairs"], """
SELECT title1, sum(n_pairs)::BIGINT AS n FROM pairs WHERE round(score, 9) >= 1
GROUP BY title1 ORDER BY n DESC, title1 LIMIT 50""")
for name, keys in COUNTS.items():
    query(name, ["prepared"], f'SELECT "DOI", {", ".join(keys)}, {name} FROM prepared')
query("issn_counts", ["results"], f"""
SELECT "DOI", {count_window(['print_issn'])} AS print_issn_counts,
  {count_window(['electronic_issn'])} AS electronic_issn_counts FROM results""")
query("first_per_token", ["prepared"], """
SELECT separated_tokens, "DOI", token_counts_by_electronic_issn FROM (
  SELECT *, row_number() OVER (PARTITION BY separated_tokens ORDER BY
    token_counts_by_electronic_issn DESC NULLS LAST, token_counts_by_print_issn DESC NULLS LAST,
    token_counts_by_container_title DESC NULLS LAST, "DOI") AS place FROM prepared)
WHERE place = 1""")
query("duplicated_titles", ["works"], """
SELECT doi AS "DOI", title, work_type FROM (
  SELECT *, count(*) OVER (PARTITION BY title) AS n FROM works) WHERE n > 1""")
query("pairs_per_id", ["pairs"], """
SELECT id1, id2, (sum(CASE WHEN id1 = id2 THEN copies1 - 1 ELSE copies2 END)
  OVER (PARTITION BY id1))::BIGINT AS "DOI_counts" FROM pairs""")
query("prepared_frame", ["prepared"], f"""
SELECT "DOI", token_frac_refs, total_processed_ref_len, cleaned_references_length,
  total_reference_length, work_type, author, flag, member, title, container_title, print_issn,
  electronic_issn, separated_tokens, ref_pge, {', '.join(COUNTS)} FROM prepared""")
query("journal_articles", ["prepared"], f"""
SELECT {ARTICLES} FROM prepared WHERE work_type = 'journal-article'""")
for name, flag in (("flagged_articles", "Yes"), ("unflagged_articles", "No")):
    query(name, ["prepared"], f"""
SELECT {ARTICLES} FROM prepared
WHERE work_type = 'journal-article' AND flag = '{flag}' AND ({OFTEN.format(10)})""")
query("unflagged_people", ["unflagged", "people"], f"""
SELECT {ARTICLES} FROM unflagged WHERE separated_tokens IN (SELECT name FROM people)""")
query("duplicate_titles", ["results"], f"SELECT {columns(fx.DUPLICATE_COLUMNS)} FROM ({REPEATED})")
part("done", ["prepared", "people"], f"""
SELECT "DOI" FROM prepared WHERE work_type = 'journal-article' AND ({OFTEN.format(10)})
  AND (flag = 'Yes' OR separated_tokens IN (SELECT name FROM people))""")
query("flagged_or_unflagged", ["done", "results"], """
SELECT "DOI", flag, title FROM results WHERE "DOI" IN (SELECT "DOI" FROM done)""")
query("other_duplicate_titles", ["done", "results"], """
SELECT "DOI", title, container_title FROM (
  SELECT *, count(*) OVER (PARTITION BY title) AS n FROM results
  WHERE work_type = 'journal-article' AND title IS DISTINCT FROM ''
    AND "DOI" NOT IN (SELECT "DOI" FROM done)) WHERE n > 1""")
query("books", ["results"], f"""
SELECT {columns(fx.BOOK_COLUMNS)} FROM results WHERE work_type = 'book'""")
CHAPTERS = f"""
SELECT {columns(fx.CHAPTER_COLUMNS)} FROM (SELECT *, {FLAGS} FROM results)
WHERE work_type = 'book-chapter'"""
query("book_chapters", ["results"], CHAPTERS)
query("titled_not_authored", ["results"], f"""
SELECT * FROM ({CHAPTERS}) WHERE title_flag = 'Yes' AND flag = 'No'""")
for name, kind in (
    ("proceedings_articles", "proceedings-article"),
    ("posted_content", "posted-content"),
    ("other_works", "other"),
):
    query(name, ["results"], f"""
SELECT {columns(fx.WORK_TYPE_COLUMNS[kind])} FROM results WHERE work_type = '{kind}'""")
query("unequal_lengths", ["results"], """
SELECT "DOI", total_processed_ref_len, cleaned_references_length,
  total_processed_ref_len <> cleaned_references_length AS unequal FROM results""")
query("few_left", ["results"], """
SELECT "DOI", total_processed_ref_len, cleaned_references_length FROM results
WHERE total_processed_ref_len <> cleaned_references_length AND cleaned_references_length < 40""")
query("full_coverage", ["results"], 'SELECT "DOI", token_frac_refs FROM results WHERE share >= 1')
query("partial_coverage", ["results"], 'SELECT "DOI", token_frac_refs FROM results WHERE share < 1')
query("flagged_slice", ["results"], """
SELECT "DOI", token_frac_refs, flag FROM results
WHERE share < 1 AND flag = 'Yes' AND work_type = 'journal-article'""")
query("not_journal_slice", ["results"], """
SELECT "DOI", token_frac_refs, work_type FROM results WHERE work_type <> 'journal-article'""")
query("top_works", ["works"], """
SELECT doi AS "DOI", ref_count AS reference_count, cited_by FROM works
ORDER BY ref_count DESC, cited_by DESC, doi LIMIT 10""")
query("references_by_author", ["refs"], """
SELECT '10.5555/' || doc_id AS "DOI", 'ref' || i AS key, author FROM refs
WHERE author IN ('Autoren The and', 'Autoren The', 'The', 'De la', 'Autorfr Le')""")
query("by_token", ["results"], """
SELECT "DOI", separated_tokens, token_frac_refs FROM results
WHERE separated_tokens IN ('Autorfr', 'Autorde')""")
query("journals_ranked", ["ranked"], "SELECT * FROM ranked")
query("top_journals", ["top_titles"], "SELECT * FROM top_titles")
query("issn_evidence", ["evidence"], "SELECT container_title, eq_e, eq_p, dup_e, dup_p FROM evidence")
query("actual_counts", ["evidence_counts"], "SELECT container_title, actual_counts FROM evidence_counts")
query("unique_journals", ["evidence_unique"], """
SELECT container_title, print_issn, electronic_issn FROM evidence_unique""")
LOOKUP = "LEFT JOIN journals j ON j.issn = coalesce(nullif(electronic_issn, ''), nullif(print_issn, ''))"
query("journal_info", ["top_titles", "journals"], f"""
SELECT container_title, electronic_issn, j.title AS journal_title, total_dois
FROM top_titles {LOOKUP}""")
query("journal_report", ["report_evidence_unique", "journals"], "SELECT " + headed(
    fx.JOURNAL_HEADINGS, fx.JOURNAL_HEADINGS) + f""" FROM (
  SELECT actual_counts, coalesce(journal_title, '{fx.MISSING}') AS journal_title, container_title,
    print_issn, electronic_issn, member,
    coalesce(total_dois::VARCHAR, '{fx.MISSING}') AS total_dois,
    coalesce(round(actual_counts / total_dois * 100, 2)::VARCHAR, '{fx.MISSING}') AS doi_pge
  FROM (SELECT *, row_number() OVER (PARTITION BY journal_title
          ORDER BY actual_counts DESC, container_title NULLS LAST) AS first_of_title
        FROM (SELECT u.*, j.title AS journal_title, total_dois
              FROM report_evidence_unique u {LOOKUP}))
  WHERE first_of_title = 1)""")
part("keyed", ["pairs"], """
SELECT id1 AS "DOI", id2 AS "DOI2", round(score, 6) AS score FROM pairs WHERE id1 <> id2""")
query("join_pairs", ["keyed", "works"], """
SELECT k.*, title, member FROM keyed k JOIN works ON works.doi = k."DOI" """)
query("join_partner", ["keyed", "works"], """
SELECT k.*, author AS doi2_author, member AS doi2_member FROM keyed k JOIN works ON works.doi = k."DOI2" """)
query("pair_attributes", ["keyed", "works"], """
SELECT k.*, a.title AS doi1_title, a.author AS doi1_author, b.title AS doi2_title,
  b.author AS doi2_author
FROM keyed k JOIN works a ON a.doi = k."DOI" JOIN works b ON b.doi = k."DOI2" """)
query("without_ids", ["works", "toxic"], """
SELECT doi AS "DOI", member FROM works WHERE doi NOT IN (SELECT "DOI" FROM toxic)""")
query("with_ids", ["works", "toxic"], """
SELECT doi AS "DOI", member FROM works WHERE doi IN (SELECT "DOI" FROM toxic)""")
query("stack", ["results"], """
SELECT "DOI", flag FROM results WHERE flag = 'Yes' UNION ALL
SELECT "DOI", flag FROM results WHERE work_type = 'book'""")
for name, keyword in (("key_difference", "EXCEPT"), ("key_intersection", "INTERSECT")):
    query(name, ["results"], f"""
SELECT electronic_issn FROM results WHERE flag = 'No' AND electronic_issn IS NOT NULL {keyword}
SELECT electronic_issn FROM results WHERE flag = 'Yes'""")
query("tfidf_weights", ["weights"], "SELECT id, term, round(weight, 6) AS weight FROM weights")
PAIR_COLUMNS = "id1, id2, copies1, copies2, round(score, 6) AS score, n_pairs"
query("tfidf_pairs", ["pairs"], f"SELECT {PAIR_COLUMNS}, title1, title2 FROM pairs")
query("tfidf_pairs_half", ["half"], "SELECT id1, id2, round(score, 6) AS score, n_pairs FROM half")
for name, least in (("embedding_pairs", 0.8), ("embedding_pairs_low", 0.3)):
    query(name, ["vectors"], f"""
SELECT id1, id2, copies1, copies2, round(score, 3) AS score, copies1 * copies2 AS n_pairs FROM (
  SELECT a.id AS id1, b.id AS id2, a.copies AS copies1, b.copies AS copies2,
    list_cosine_similarity(a.value, b.value) AS score
  FROM vectors a JOIN vectors b ON a.id < b.id) WHERE score >= {least}
UNION ALL SELECT id, id, copies, copies, 1.0, copies * (copies - 1) // 2
FROM vectors WHERE copies > 1""")
query("score_band", ["pairs"], """
SELECT id1, id2, round(score, 6) AS score FROM pairs WHERE round(score, 9) BETWEEN 0.94 AND 1""")
query("top_pair", ["pairs"], """
SELECT id1, id2, round(score, 6) AS score FROM pairs WHERE id1 <> id2
ORDER BY round(score, 9) DESC, id1, id2 LIMIT 1""")
SELF_PAIRS = """
SELECT id, id, copies, copies, 1.0, copies * (copies - 1) // 2 FROM groups WHERE copies > 1"""
query("jaccard_pairs", ["char_bag", "groups"], f"""
SELECT p.*, x.value AS title1, y.value AS title2 FROM (
  SELECT id1, id2, copies1, copies2, round(shared / (size1 + size2 - shared), 6) AS score,
    copies1 * copies2 AS n_pairs
  FROM (SELECT a.id AS id1, b.id AS id2, a.copies AS copies1, b.copies AS copies2,
      a.size AS size1, b.size AS size2, sum(least(a.n, b.n)) AS shared
    FROM char_bag a JOIN char_bag b ON a.c = b.c AND a.id < b.id GROUP BY ALL)
  WHERE shared / (size1 + size2 - shared) >= 0.8
  UNION ALL {SELF_PAIRS}) p
JOIN groups x ON x.id = id1 JOIN groups y ON y.id = id2""")
# DuckDB compares bytes; a one-to-one mapping of the accented letters to control characters lets
# bytes stand for characters without changing any distance.
ACCENTED = "éÉßÇèñÑÊíêüÖÍÜÈöÓçäÄóàâîôûœæ"
BYTES = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(11, 11 + len(ACCENTED) - 8)])
# The swap distance of SQL also allows edits inside a swapped pair. That matters only where two
# letters are swapped and another is put between them, which no pair of these titles needs.
for name, function in (("edit_pairs", "levenshtein"), ("swap_edit_pairs", "damerau_levenshtein")):
    query(name, ["groups"], f"""
WITH plain AS (SELECT id, copies, length(value) AS size,
  translate(value, '{ACCENTED}', {BYTES}) AS value FROM groups)
SELECT id1, id2, round(score, 6) AS score, n_pairs FROM (
  SELECT a.id AS id1, b.id AS id2, a.copies * b.copies AS n_pairs,
    1 - {function}(a.value, b.value) / greatest(a.size, b.size) AS score
  FROM plain a JOIN plain b ON a.id < b.id
    AND least(a.size, b.size) >= 0.8 * greatest(a.size, b.size) - 1e-9)
WHERE score >= 0.8 - 1e-9
UNION ALL SELECT id, id, 1.0, copies * (copies - 1) // 2 FROM groups WHERE copies > 1""")
query("title_members", ["titled", "groups"], """
SELECT t.id AS member, g.id AS id FROM titled t JOIN groups g ON g.value = t.title""")
def similar(pairs: str, groups: str, titled: str, score: str) -> str:
    """Per work the ids like its own value, and how many works each stands for."""
    return f"""
SELECT m.id AS "DOI", id2 AS "DOI2", {score} AS score, copies1, copies2, t.title AS doi2_title,
  CASE WHEN id1 = id2 THEN copies1 - 1 ELSE copies2 END AS n_partners
FROM {pairs} JOIN {groups} g ON g.id = id1 JOIN {titled} m ON m.title = g.value
  JOIN {titled} t ON t.id = id2"""


DOI_COUNTS = '(sum(n_partners) OVER (PARTITION BY p."DOI"))::BIGINT AS "DOI_counts"'
CONTAINER_COUNTS = """CASE WHEN container_title IS NOT NULL
  THEN (sum(n_partners) OVER (PARTITION BY container_title))::BIGINT END AS container_title_counts"""
query("similar_title_report", ["clean_pairs", "clean_groups", "clean_titled_full", "works"], f"""
SELECT *, {CONTAINER_COUNTS}
FROM (SELECT p."DOI", "DOI2", score, copies1, copies2, n_partners, doi2_title,
    {DOI_COUNTS}, a.title, a.author, a.container_title,
    a.print_issn, a.electronic_issn, a.member, b.author AS doi2_author,
    b.container_title AS doi2_container_title, b.print_issn AS doi2_print_issn,
    b.electronic_issn AS doi2_electronic_issn, b.member AS doi2_member
  FROM ({similar("clean_pairs", "clean_groups", "clean_titled_full", "round(score, 6)")}) p
  JOIN works a ON a.doi = p."DOI" JOIN works b ON b.doi = "DOI2")""")
part("embedded", [], "SELECT '10.5555/' || vec_id AS id, embedding AS title FROM embeddings")
part("embedded_groups", ["embedded"], """
SELECT min(id) AS id, title AS value, count(*) AS copies FROM embedded
WHERE len(list_filter(title, lambda x: x <> 0)) > 0 GROUP BY title""")
part("embedded_pairs", ["embedded_groups"], """
SELECT a.id AS id1, b.id AS id2, a.copies AS copies1, b.copies AS copies2,
  list_cosine_similarity(a.value, b.value) AS score
FROM embedded_groups a JOIN embedded_groups b ON a.id < b.id
WHERE list_cosine_similarity(a.value, b.value) >= 0.45
UNION ALL SELECT id, id, copies, copies, 1.0 FROM embedded_groups WHERE copies > 1""")
query("similar_vector_report", ["embedded_pairs", "embedded_groups", "embedded", "works"], f"""
SELECT "DOI", "DOI2", score, n_partners, "DOI_counts", container_title, {CONTAINER_COUNTS}
FROM (SELECT p."DOI", "DOI2", score, n_partners, {DOI_COUNTS}, a.container_title
  FROM ({similar("embedded_pairs", "embedded_groups", "embedded", "round(score::DOUBLE, 3)")}) p
  JOIN works a ON a.doi = p."DOI" JOIN works b ON b.doi = "DOI2")""")


def statement(needs: list[str], sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in PARTS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in needs:
        visit(name)
    # A name read by several parts is computed once.
    parts = [f"{name} AS MATERIALIZED ({PARTS[name][1].strip()})" for name in ordered]
    inner = sql.strip()
    if parts and inner.startswith("WITH "):
        inner = ", " + inner[len("WITH "):]
    text = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + inner
    return text.replace("@STOP@", stop_rows()) if "@STOP@" in text else text


def oracle_sql() -> dict[str, str]:
    return {name: statement(needs, sql) for name, (needs, sql) in SELECTS.items()}
