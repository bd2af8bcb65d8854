"""Quality rules: gradient-boosted trees over statistics of a document.

One pass over Arrow batches measures every whole text with numpy, a batch of texts at a time. The
trees are fitted on the driver from the statistics of a bounded sample of labelled documents. They
are boosted on the logistic loss by histograms, and more symbols, repeated lines, repeated windows
or doubled words can never raise a score: splits that would break this order are not made, and
children keep to the bounds that their parent's split sets. For scoring, all trees lie in five
arrays of nodes and a whole batch of documents walks down all trees at once, level by level.

Defined results: a null or empty text has zero words and fails the base rule. Without labels of
both kinds there are no trees, and the base rule decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import Words, few, mapped, split_of, steps, words_of

MIN_WORDS = 20
WINDOW = 8
# Labelled documents that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 3, 0.2, 48, 2.0, 1.0
# A document goes if the trees find it at least this likely to be bad.
REJECT_AT = 0.6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(ord("A"), ord("Z") + 1))] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

# Statistics that the trees read, and how a score may follow them (-1: never up).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1,
    "repeat_share": -1, "doubled_share": -1, "distinct_share": 0, "digit_share": 0,
    "upper_share": 0, "stops_per_word": 0, "words_per_line": 0, "top_word_share": 0,
}


def _per_text(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_words(code: np.ndarray, words: Words, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``window`` words that its text holds more than once.

    Windows are numbered exactly: the number of a run of words is made from those of its halves.
    ``window`` is a power of two.
    """
    n = len(code)
    marked = np.zeros(n, bool)
    if n < window:
        return marked
    number, width = code.astype(np.int64), 1
    while width < window:
        number = _numbered(number[:-width] * (number.max() + 1) + number[width:])
        width *= 2
    text = words.documents()
    inside = np.flatnonzero(text[: len(number)] == text[window - 1:])
    _, at, times = np.unique(
        text[inside] * (number.max() + 1) + number[inside], return_inverse=True, return_counts=True
    )
    begins = inside[times[at] > 1]
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, begins, 1)
    np.add.at(depth, begins + window, -1)
    return np.cumsum(depth[:-1]) > 0


def _line_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text, its lines with a word, and those of them equal to an earlier line."""
    n_texts = len(words.base) - 1
    breaks = np.flatnonzero(words.data == 0x0A)
    start = np.unique(np.concatenate([words.base[:-1], breaks + 1]))
    start = start[start < len(words.data)]
    end = np.concatenate([start[1:], [len(words.data)]])
    # A line ends before its line feed.
    end = end - ((end > start) & (words.data[end - 1] == 0x0A)) if len(start) else end
    filled = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[filled], end[filled]
    text = np.searchsorted(words.base, start, "right") - 1
    code, _ = Words(words.data, words.base, start, end, words.first).encoded()
    if not len(code):
        return np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    distinct = np.unique(text * (int(code.max()) + 1) + code)
    unique = np.bincount(distinct // (int(code.max()) + 1), minlength=n_texts)
    lines = np.bincount(text, minlength=n_texts)
    return lines, lines - unique


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and features of each text."""
    words = words_of(texts)
    n = words.counts().astype(np.int64)
    data, base = words.data, words.base
    characters = _per_text((data & 0xC0) != 0x80, base)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    word_chars = characters - _per_text(space[data], base)
    symbols = _per_text(_SYMBOL[data], base)
    lines, dup_lines = _line_counts(words)
    code, _ = words.encoded()
    repeat = _per_text(repeated_words(code, words), words.first)
    text = words.documents()
    doubled = np.zeros(len(code), bool)
    doubled[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
    pairs, times = np.unique(
        text * (int(code.max(initial=0)) + 1) + code, return_counts=True
    )
    owner = pairs // (int(code.max(initial=0)) + 1)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, owner, times)
    some, chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    features = {
        "log_words": np.log1p(n), "word_length": word_chars / some,
        "symbols_per_word": symbols / some, "dup_line_share": dup_lines / np.maximum(lines, 1),
        "repeat_share": repeat / some, "doubled_share": _per_text(doubled, words.first) / some,
        "distinct_share": np.bincount(owner, minlength=len(n)) / some,
        "digit_share": _per_text(_DIGIT[data], base) / chars,
        "upper_share": _per_text(_UPPER[data], base) / chars,
        "stops_per_word": _per_text(_STOP[data], base) / some,
        "words_per_line": n / np.maximum(lines, 1), "top_word_share": most / some,
    }
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeat, "features": np.stack([features[f] for f in FEATURES], 1),
    }


class Trees(NamedTuple):
    """All nodes of all trees; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of features."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            less = x[row, self.feature[node]] <= self.limit[node]
            node = np.where(less, self.below[node], self.above[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(1))))


def fit_trees(x: np.ndarray, label: np.ndarray, order: np.ndarray) -> Trees:
    """Boosted trees; ``order`` is -1, 0 or 1 for each feature."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
    rate = label.mean()
    start = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []
    roots, score = [], np.full(len(x), start)

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = None
        if depth < DEPTH:
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                size = len(cuts) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], hessian[rows], size))[:-1]
                gr, hr = g - gl, h - hl
                wl = np.clip(-gl / (hl + RIDGE), low, high)
                wr = np.clip(-gr / (hr + RIDGE), low, high)
                gain = -(gl * wl + (hl + RIDGE) * wl**2 / 2) - (gr * wr + (hr + RIDGE) * wr**2 / 2)
                fine = (hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & (order[f] * (wr - wl) >= 0)
                if fine.any():
                    at = int(np.argmax(np.where(fine, gain, -np.inf)))
                    if best is None or gain[at] > best[0]:
                        best = gain[at], f, at, wl[at], wr[at]
        here = len(nodes)
        weight = float(np.clip(-g / (h + RIDGE), low, high))
        nodes.append([0, 0.0, here, here, weight * RATE])
        if best is not None and best[0] > g * g / (h + RIDGE) / 2 + 1e-6:
            _, f, at, wl, wr = best
            middle = (wl + wr) / 2
            left, right = (low, high), (low, high)
            if order[f]:
                left, right = ((low, middle), (middle, high)) if order[f] > 0 else ((middle, high), (low, middle))
            less = binned[rows, f] <= at
            nodes[here][:2] = [f, float(edges[f][at])]
            nodes[here][2] = grow(rows[less], depth + 1, *left)
            nodes[here][3] = grow(rows[~less], depth + 1, *right)
        return here

    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-score))
        gradient, hessian = chance - label, chance * (1 - chance)
        first = len(nodes)
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
        tree = _packed(nodes, [first], 0.0)
        margin = tree.probability(x)
        score = score + np.log(margin / (1 - margin))
    return _packed(nodes, roots, start)


def _packed(nodes: list[list[float]], roots: list[int], start: float) -> Trees:
    table = np.array(nodes, np.float64).reshape(-1, 5)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots), start)


def sure_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label``, one row per labelled document; contradictory labels are left out."""
    return (
        labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("other"))
        .filter(F.col("label") == F.col("other")).drop("other")
    )


def sample_features(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, dealt by a hash of their id."""
    sure = sure_labels(labels, "quality").filter(split_of(F.col("doc_id"), 3) != 1)
    chosen = few(sure, sure.count(), rows, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"
    )
    found = mapped(
        texts, "text",
        lambda step: {
            "doc_id": step.column("doc_id"), "label": step.column("label"),
            "x": pa.array(list(statistics(step.column("text"))["features"]), pa.list_(pa.float64())),
        },
        "doc_id long, label int, x array<double>",
    ).orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(2 * rows).toPandas()
    if found.empty:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.stack(found["x"].to_list()), found["label"].to_numpy(np.float64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from labelled documents; none without both labels."""
    x, label = sample_features(docs, labels, rows)
    if len(np.unique(label)) < 2:
        return None
    return fit_trees(x, label, np.array(list(FEATURES.values())))


def apply_rules(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``score`` (chance of being good) and ``kept``."""

    def run(step: pa.RecordBatch) -> dict:
        found = statistics(step.column("text"))
        n, repeat = found["n_words"], found["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeat > 30 * n)
        score = trees.probability(found["features"]) if trees else np.ones(len(n))
        return {
            "doc_id": step.column("doc_id"), "n_words": n, "word_chars": found["word_chars"].astype(np.int64),
            "n_symbols": found["n_symbols"].astype(np.int64), "n_dup_lines": found["n_dup_lines"].astype(np.int64),
            "n_repeat_words": repeat.astype(np.int64), "base_failed": failed, "score": score,
            "kept": ~failed & (score > 1 - REJECT_AT),
        }

    return mapped(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, score double, kept boolean",
    )


def kept_documents(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of ``docs``, with all columns, that the rules keep."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            found = statistics(step.column("text"))
            n = found["n_words"]
            failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > 30 * n)
            score = trees.probability(found["features"]) if trees else np.ones(len(n))
            yield step.filter(pa.array(~failed & (score > 1 - REJECT_AT)))

    return docs.mapInArrow(run, schema)
