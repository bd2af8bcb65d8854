"""Word lists and headings that results depend on literally."""

import calendar

# Domain words dropped from free-text references.
DOMAIN_WORDS = [
    "https", "book", "vgl", "last", "em", "accessed", "phys", "phd", "colloq", "univ", "college",
    "institute", "arxiv", "xxx", "review", "et al", "etal", "studies", "journal", "revue",
    "conference", "annals", "proceedings", "advances", "bulletin", "société", "del", "acta",
    "études", "tijdschrift", "voor", "anales", "журнал", "zeitschrift", "annales", "archiv",
    "thesis", "archive", "cited", "ref", "vol", "rev", "magtechrefsourc", "span", "referans",
    "title", "bibitem", "reference", "class", "comatyponpdfplu", "lusxmlimplaut",
    "sinternalmodelp", "bauthor", "bsnm",
]

# Words dropped from author strings.
AUTHOR_WORDS = [
    "and", "vgl", "et", "al", "magtechrefsourc", "span", "referans", "title", "bibitem", "https",
    "reference", "class", "comatyponpdfplu", "lusxmlimplaut", "sinternalmodelp",
]

# Titles that recur without being copies of one work.
STOP_TITLES = [
    "Preface", "Introduction", "Obituary", "OBITUARY", "Bibliographie", "In Memoriam",
    "Editorial", "In memoriam", "Dedication", "Social administration digest", "Bibliography",
    "IN MEMORIAM", "Obituaries", "Book review", "Back Matter", "References",
    "Environmental digest", "General Assembly", "Autobiography", "OBITUARIES", "Foreword",
    "Introduction to the special issue", "Social Administration Digest", "News", "Book Review",
    "Tribute", "Recommended practices", "Selected bibliography", "Selected Bibliography",
    "Présentation", "Bericht über Patente", "Documentation", "Results on top physics by CMS",
    "Curriculum Vitae", "NOTES", "Notes and Comments", "Notes", "Discussion", "Prologue",
    "Literatur",
]

# Languages whose stop words are dropped from free-text references.
STOP_LANGUAGES = ["english", "spanish", "italian", "german", "french", "russian"]

# Headings of the article, book and chapter reports.
ARTICLE_HEADINGS = {
    "separated_tokens": "most occuring token counted over all processed references",
    "token_frac_refs": "Percentage of references in which the token(s) appears",
    "flag": "author flag",
    "ref_pge": "Percentage of references that are processed compared to the total number of "
    "references in the article",
    "total_reference_length": "Total no. of references",
}

# Headings of the journal report.
JOURNAL_HEADINGS = {
    "actual_counts": "DOI counts",
    "journal_title": "Journal Title in journals route",
    "container_title": "Container Title from DOI",
    "print_issn": "Print ISSN",
    "electronic_issn": "Electronic ISSN",
    "member": "Member",
    "total_dois": "Total No. of DOIs",
    "doi_pge": "Percentage of DOI counts over total number of DOIs",
}

# Columns of the reports, in order.
BY_ISSN_AND_TITLE = [
    "token_counts_by_electronic_issn",
    "token_counts_by_print_issn",
    "token_counts_by_container_title",
]
ARTICLE_COLUMNS = [
    "DOI", "separated_tokens", "token_frac_refs", "author", "flag", "title", "container_title",
    "print_issn", "electronic_issn", "ref_pge", "total_reference_length", *BY_ISSN_AND_TITLE,
    "member",
]
BOOK_COLUMNS = [
    "DOI", "separated_tokens", "token_frac_refs", "author", "flag", "title", "member", "ref_pge",
    "total_reference_length",
]
CHAPTER_COLUMNS = [
    "DOI", "separated_tokens", "token_frac_refs", "author", "title", "container_title", "flag",
    "title_flag", "container_title_flag", "member", "ref_pge", "total_reference_length",
]
CONTAINED_COLUMNS = [
    "DOI", "separated_tokens", "token_frac_refs", "author", "flag", "title", "container_title",
    "member", "ref_pge", "total_reference_length",
]
WORK_TYPE_COLUMNS = {
    "proceedings-article": CONTAINED_COLUMNS,
    "posted-content": BOOK_COLUMNS,
    "other": CONTAINED_COLUMNS,
}
DUPLICATE_COLUMNS = [
    "DOI", "title", "container_title", "print_issn", "electronic_issn", "separated_tokens",
    "flag", "member",
]

# Columns of the similar-title report, and names of the partner's.
PARTNER_NAMES = {
    "author": "doi2_author",
    "container_title": "doi2_container_title",
    "print_issn": "doi2_print_issn",
    "electronic_issn": "doi2_electronic_issn",
    "member": "doi2_member",
}
SIMILAR_TITLE_COLUMNS = [
    "DOI", "title", "author", "container_title", "print_issn", "electronic_issn", "member",
]

# Fixed value: shown in the journal report where a value is missing.
MISSING = "None found"

MONTHS = [name.lower() for name in calendar.month_name if name]
