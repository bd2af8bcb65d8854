"""Secrets in texts: named patterns, and stretches of high entropy.

Everything is an expression over the row of a document, so a scan is one stage without a shuffle.
Patterns give their matches leftmost and without overlap, as pairs of the gap before a match and
the match; the lengths of both add up to places in code points.

Beyond the patterns, every run of key characters is a candidate. A window slides over it, one
character at a time; the counts of its characters change by the one that enters and the one that
leaves, and with them the sum of c*log2(c) that Shannon entropy needs. Windows of at least the
entropy that the candidate's character class asks for are merged into spans. Candidates of an
allow-list (words, numbers, series, placeholders, UUIDs) give none.

Null and empty texts have no spans. Ties of a start are ordered by kind, as listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.functions.gate import once

# Patterns, the group that is measured (0: all), and its least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (f"(?i:{ASSIGN})", 2, 6),
    # Runs end where their class ends, so the least length can be part of these patterns.
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
ENTROPY = "entropy"

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/=_]{{{WINDOW},}}"
# Least bits per character of a window, by the narrowest class that holds the candidate.
CLASSES = [("^[0-9a-fA-F]+$", 3.0), ("^[0-9a-z_=]+$|^[0-9A-Z_=]+$", 3.5), ("", 3.9)]
ALLOWED = [
    "^[A-Za-z/_=+]+$",  # no digit: words and paths
    "^[0-9/_=+]+$",  # no letter: numbers and dates
    r"^(.{1,4})\1+.{0,3}$",  # a short unit repeated
    "(?i)0123456789|1234567890|abcdefghij|qwertyuiop",  # series
    "(?i)example|placeholder|changeme|xxxxxx",  # placeholders
    "^[A-Za-z]+[0-9]{1,4}$",  # a word and a number
]

_SPAN = "struct<start:int,end:int,size:int>"
_EMPTY = f"CAST(array() AS array<{_SPAN}>)"
# Sums of c*log2(c) are kept in whole millionths, so that they stay exact in either direction.
_SCALE = 1_000_000
_FIRST_CODE = ord("+")
_CODES = ord("z") - _FIRST_CODE + 1


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lists(text: str, name: str, pattern: str, group: int) -> list[Column]:
    r"""Gaps, matches and one group of each match, as lists; empty for a text without a match.

    ``\G`` ties each step to the end of the last one, so that the text after the last match is
    read once only.
    """
    step = _quoted(rf"(?s)\G(.*?)({pattern})")
    groups = {"gap": 1, "hit": 2, "part": 2 + group}
    return [
        F.expr(
            f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN regexp_extract_all({text}, {step}, {g}) "
            "ELSE CAST(array() AS array<string>) END"
        ).alias(f"__{name}_{part}")
        for part, g in groups.items()
    ]


def _placed(name: str, least: int) -> Column:
    """Places of the matches in such lists, those with a group of ``least`` characters."""
    gap, hit, part = (f"__{name}_{x}" for x in ("gap", "hit", "part"))
    return F.expr(f"""
        filter(aggregate(
          {gap},
          struct(0 AS i, 0 AS at, {_EMPTY} AS spans),
          (s, g) -> struct(
            s.i + 1 AS i,
            s.at + length(g) + length({hit}[s.i]) AS at,
            concat(s.spans, array(struct(
              s.at + length(g) AS start,
              s.at + length(g) + length({hit}[s.i]) AS end,
              length({part}[s.i]) AS size))) AS spans),
          s -> s.spans), x -> x.size >= {least})""").alias(f"__{name}")


def _windows(run: str) -> str:
    """Spans ``(from, to)`` of candidate ``run`` whose windows have enough entropy.

    Step ``i`` first judges the window that ends before character ``i``, whose counts it was
    given, then lets character ``i`` in and the one a window before it out.
    """
    weight = "array(" + ", ".join(
        f"{round(c * math.log2(c) * _SCALE) if c else 0}L" for c in range(WINDOW + 2)
    ) + ")"
    most = "CASE " + " ".join(
        f"WHEN {run} RLIKE {_quoted(pattern)} THEN "
        f"{round(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)}L"
        for pattern, bits in CLASSES
    ) + " END"
    return f"""
      flatten(transform(
        array(struct(
          transform(regexp_extract_all({run}, '(.)', 1), c -> ascii(c) - {_FIRST_CODE}) AS code,
          {most} AS most)),
        c -> aggregate(
          sequence(0, size(c.code)),
          struct(
            array_repeat(0, {_CODES}) AS n, 0L AS sum,
            CAST(array() AS array<struct<from:int,to:int>>) AS spans),
          (s, i) -> struct(
            CASE WHEN i = size(c.code) THEN s.n ELSE transform(s.n, (n, k) -> n
              + CASE WHEN k = c.code[i] THEN 1 ELSE 0 END
              - CASE WHEN k = get(c.code, i - {WINDOW}) THEN 1 ELSE 0 END) END AS n,
            CASE WHEN i = size(c.code) OR c.code[i] = get(c.code, i - {WINDOW}) THEN s.sum
              ELSE s.sum
                - {weight}[s.n[c.code[i]]] + {weight}[s.n[c.code[i]] + 1]
                + CASE WHEN i < {WINDOW} THEN 0L
                    ELSE {weight}[s.n[get(c.code, i - {WINDOW})] - 1]
                      - {weight}[s.n[get(c.code, i - {WINDOW})]] END END AS sum,
            CASE WHEN i < {WINDOW} OR s.sum > c.most THEN s.spans
              WHEN size(s.spans) > 0 AND element_at(s.spans, -1).to >= i - {WINDOW}
                THEN concat(slice(s.spans, 1, size(s.spans) - 1),
                  array(struct(element_at(s.spans, -1).from AS from, i AS to)))
              ELSE concat(s.spans, array(struct(i - {WINDOW} AS from, i AS to))) END AS spans),
          s -> s.spans)))"""


def _entropy_spans(allowed: list[str]) -> Column:
    """Spans of all candidates that the allow-list lets through, in places of the text."""
    suppressed = " OR ".join(f"r.run RLIKE {_quoted(pattern)}" for pattern in allowed) or "false"
    return F.expr(f"""
        flatten(transform(
          filter(
            transform(__candidate, (p, i) -> struct(p.start AS start, __candidate_hit[i] AS run)),
            r -> NOT ({suppressed})),
          r -> transform({_windows('r.run')}, w -> struct(
            r.start + w.from AS start, r.start + w.to AS end, w.to - w.from AS size))))
    """).alias(f"__{ENTROPY}")


def with_secrets(
    df: DataFrame, text: str = "text", allowed: list[str] = ALLOWED, name: str = "secrets"
) -> DataFrame:
    """All rows and columns of ``df``, with ``secrets``: ``kind, start, end`` of each span.

    Spans are ordered by start, then kind as listed. Places are code points, the end exclusive.
    A stretch of high entropy inside a pattern's span is not listed again. ``name`` names the new
    column; no column of ``df`` may begin with two underscores.
    """
    names = df.columns
    df = df.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    lists, placed = _lists("__text", "candidate", CANDIDATE, 0), [_placed("candidate", 0)]
    for kind, (pattern, group, least) in KINDS.items():
        lists += _lists("__text", kind, pattern, group)
        placed.append(_placed(kind, least))
    df = df.select(*[f"`{n}`" for n in names], once(*lists))
    df = df.select(*[f"`{n}`" for n in names], "__candidate_hit", once(*placed))
    df = df.select("*", once(_entropy_spans(allowed)))
    named = [
        f"transform(__{kind}, x -> struct(x.start AS start, {i} AS place, x.end AS end))"
        for i, kind in enumerate(KINDS)
    ]
    base = f"concat({', '.join(named)})"
    added = f"""transform(
        filter(__{ENTROPY}, e -> NOT exists({base}, b -> b.start <= e.start AND e.end <= b.end)),
        x -> struct(x.start AS start, {len(KINDS)} AS place, x.end AS end))"""
    listed = "array(" + ", ".join(f"'{kind}'" for kind in [*KINDS, ENTROPY]) + ")"
    return df.select(*[f"`{n}`" for n in names], once(F.expr(f"""
        transform(array_sort(concat({base}, {added})), x -> struct(
          {listed}[x.place] AS kind, x.start AS start, x.end AS end))""").alias(name)))


def _written(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def secret_report(docs: DataFrame, allowed: list[str] = ALLOWED) -> DataFrame:
    """Per document the number of matches of each pattern, a digest of them, and all spans."""
    base = f"filter(secrets, x -> x.kind <> '{ENTROPY}')"
    counts = [
        F.expr(f"CAST(size(filter(secrets, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
        for kind in KINDS
    ]
    return with_secrets(docs.select(F.col("doc_id").cast("long"), "text"), allowed=allowed).select(
        "doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"),
        _written("secrets").alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span replaced by ``mark``; spans that overlap become one mark."""
    names = df.columns
    found = with_secrets(df, text, name="__secrets")
    cleaned = f"""
      CASE WHEN size(__secrets) = 0 THEN `{text}` ELSE aggregate(
        __secrets,
        struct(CAST('' AS string) AS done, 0 AS at),
        (s, x) -> CASE WHEN x.end <= s.at THEN s ELSE struct(
          CASE WHEN x.start < s.at THEN s.done
            ELSE concat(s.done, substring(`{text}`, s.at + 1, x.start - s.at), {_quoted(mark)}) END AS done,
          x.end AS at) END,
        s -> concat(s.done, substring(`{text}`, s.at + 1, length(`{text}`)))) END"""
    return found.select(
        *[F.expr(cleaned).alias(n) if n == text else F.col(f"`{n}`") for n in names]
    )
