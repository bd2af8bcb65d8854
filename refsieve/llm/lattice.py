"""Likelihood of texts by a lattice of subwords.

An existing vocabulary of pieces gives every piece a weight by its score. All ways to cut a word
into pieces form a lattice; the forward recursion, in logarithms, adds the probabilities of all of
them up. Pieces do not cross words, so the probability of a document is the product over its words.
A word that training texts hold is one more arc through its lattice: with ``c`` of ``N`` training
tokens and ``V`` distinct ones, a word has

    P(word) = (c + V * lattice(word)) / (N + V)

so what is known of whole words and what pieces say of new ones share one mass (Witten-Bell).

Counting is a shuffle of words that are counted in their tasks before. Each distinct word of the
corpus gets its lattice once. Documents are scored in two ways that give one sum: words with at
least one of ``FREQUENT`` training tokens - so at most ``FREQUENT`` words, whatever the corpus -
are shipped to the tasks; the others are joined by word, counted per document, and no such word is
frequent enough to make a hot key.

Defined results: a null text is an empty one, which has just its end token. Rows of one id are
documents of their own; a missing id is split like an empty text. Rows are told apart by their
place in the scan, so ``docs`` must be a stored table. Without training texts the base score is 0
per token and known words are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import mapped, split_of, words_of
from refsieve.llm.storage import freed_early
from refsieve.session import stored

# Words that hold this share of the training tokens are scored without a join: 1 / FREQUENT.
FREQUENT = 100_000
# Characters of a word up to which words are worked on together.
SHORT = 48
SPACE = "▁"


class Pieces:
    """A vocabulary with weights; ``known`` maps pieces to log10 weights, their beginnings to None."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """``pieces`` with scores. A score below another means a piece used less: weights fall
        with the rank of the score (Zipf), and add up to 1."""
        ranks = {score: rank for rank, score in enumerate(sorted({s for _, s in pieces}, reverse=True), 1)}
        total = math.log10(sum(1 / ranks[score] for _, score in pieces) or 1)
        self.known: dict[str, float | None] = {}
        self.bytes = [math.log10(1 / (len(pieces) + 256)) - total] * 256
        for piece, score in pieces:
            weight = -math.log10(ranks[score]) - total
            if len(piece) == 6 and piece.startswith("<0x"):
                self.bytes[int(piece[3:5], 16)] = -math.log10(len(pieces)) - total
                continue
            self.known[piece] = weight
            for end in range(1, len(piece)):
                self.known.setdefault(piece[:end], None)

    def arcs(self, text: str) -> list[tuple[int, int, float]]:
        """All pieces in a text as ``start, end, weight``; bytes where a character is no piece."""
        known, out, n = self.known, [], len(text)
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                weight = known.get(text[i:j], 0.0)
                if weight is None:
                    continue
                if weight == 0.0:
                    break
                single |= j == i + 1
                out.append((i, j, weight))
            if not single:
                out.append((i, i + 1, sum(self.bytes[b] for b in text[i].encode("utf-8", "replace"))))
        return out

    def log10(self, words: list[str]) -> np.ndarray:
        """Log10 of the summed probability of all segmentations of each word."""
        out = np.zeros(len(words))
        texts = [SPACE + word for word in words]
        short = [i for i, text in enumerate(texts) if len(text) <= SHORT]
        for i in set(range(len(texts))) - set(short):
            out[i] = self._forward(texts[i])
        if short:
            out[short] = self._forward_all([texts[i] for i in short])
        return out

    def _forward(self, text: str) -> float:
        alpha = [-math.inf] * (len(text) + 1)
        alpha[0] = 0.0
        for i, j, weight in sorted(self.arcs(text), key=lambda arc: arc[0]):
            a, b = alpha[j], alpha[i] + weight
            high, low = (a, b) if a > b else (b, a)
            alpha[j] = high if low == -math.inf else high + math.log10(1 + 10 ** (low - high))
        return alpha[-1]

    def _forward_all(self, texts: list[str]) -> np.ndarray:
        """The same recursion, one end position of all texts at a time."""
        flat = [(j, w, i, weight) for w, text in enumerate(texts) for i, j, weight in self.arcs(text)]
        table = np.array(flat, np.float64)
        end, word, start = (table[:, k].astype(np.int64) for k in range(3))
        order = np.lexsort((word, end))
        end, word, start, weight = end[order], word[order], start[order], table[order, 3] * math.log(10)
        alpha = np.full((len(texts), SHORT + 2), -np.inf)
        alpha[:, 0] = 0
        cuts = np.searchsorted(end, np.arange(1, SHORT + 2))
        for at in range(1, SHORT + 1):
            a, b = cuts[at - 1], cuts[at]
            if a == b:
                continue
            own = word[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            alpha[own[first], at] = np.logaddexp.reduceat(alpha[own, start[a:b]] + weight[a:b], first)
        return alpha[np.arange(len(texts)), [len(t) for t in texts]] / math.log(10)


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model and their scores, without control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i))
    ]


def _rows(docs: DataFrame, parts: int, held: int) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (split_of(F.col("doc_id"), parts) == held).alias("held_out"), "text",
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: every word of all texts with its number in training texts."""

    def run(step: pa.RecordBatch) -> dict:
        words = words_of(step.column("text"), lower=True)
        code, distinct = words.encoded()
        trains = ~step.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(code[trains[words.documents()]], minlength=len(distinct))
        return {"word": distinct.cast(pa.large_string()).cast(pa.string()), "c": pa.array(counts.astype(np.int64))}

    return mapped(docs.select("held_out", "text"), "text", run, "word string, c long").groupBy("word").agg(
        F.sum("c").alias("c")
    )


def with_lattice(counted: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``word, c, lattice``: log10 of each word's summed segmentations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Pieces(pieces)
        for frame in frames:
            frame["lattice"] = model.log10(frame["word"].tolist())
            yield frame

    return counted.mapInPandas(run, "word string, c long, lattice double")


def score_documents(
    docs: DataFrame, pieces: list[tuple[str, float]], parts: int = 7, held: int = 2, frequent: int = FREQUENT,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    docs = _rows(docs, parts, held)
    with freed_early(docs.sparkSession):
        counted = stored(word_counts(docs), "words")
        model = stored(with_lattice(counted, pieces), "word-model")
        ends = docs.filter(~F.col("held_out")).count()
        known, total = model.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
        n, v = total + ends, known + (ends > 0)
        often = model.filter((F.col("c") > 0) & (F.col("c") * frequent >= n)).toPandas()
        table = {
            word.encode(): (_base(c, n, v), _mixture(c, lattice, n, v))
            for word, c, lattice in zip(often["word"], often["c"].tolist(), often["lattice"].tolist())
        }
        end = _base(ends, n, v), math.log10(max(ends, 1) / max(n + v, 1)), int(ends > 0)
        partial = stored(_partial(docs, table, end), "partial-scores")

    rare = partial.filter(F.col("word").isNotNull()).select("row", "word", "times").join(model, "word")
    width = float(n + v + 1)
    mixed = F.when(F.col("c") > 0, F.log10(F.col("c") + max(v, 1) * F.pow(F.lit(10.0), F.col("lattice")))).otherwise(
        F.col("lattice") + math.log10(max(v, 1))
    ) - math.log10(max(n + v, 1))
    rare = rare.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
        F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10((F.col("c") + 1) / F.lit(width))).alias("base_score"),
        (F.col("times") * mixed).alias("score"),
    )
    heads = partial.filter(F.col("word").isNull()).select(*rare.columns)
    return heads.unionByName(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")


def _base(c: int, n: int, v: int) -> float:
    return math.log10((c + 1) / (n + v + 1))


def _mixture(c: int, lattice: float, n: int, v: int) -> float:
    return math.log10(c + v * 10**lattice) - math.log10(n + v)


def _partial(docs: DataFrame, table: dict[bytes, tuple[float, float]], end: tuple[float, float, int]) -> DataFrame:
    """A row per document with the sums over frequent words and the end, and a row per other word."""

    def run(step: pa.RecordBatch) -> dict:
        words = words_of(step.column("text"), lower=True)
        code, distinct = words.encoded()
        terms = [table.get(word) for word in distinct.to_pylist()]
        often = np.array([t is not None for t in terms], bool)
        values = np.array([t or (0.0, 0.0) for t in terms], np.float64).reshape(-1, 2)
        text, size = words.documents(), step.num_rows
        hit = often[code]
        base, score = (np.bincount(text[hit], values[code[hit], k], size) + end[k] for k in (0, 1))
        n_known = np.bincount(text[hit], minlength=size) + end[2]
        rare, times = np.unique(text[~hit] * max(len(distinct), 1) + code[~hit], return_counts=True)
        owner, word = rare // max(len(distinct), 1), rare % max(len(distinct), 1)
        rows = step.column("row")

        def after(heads: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
            return pa.concat_arrays([pa.array(heads, kind), pa.nulls(len(rare), kind)])

        return {
            "row": pa.concat_arrays([rows, rows.take(pa.array(owner))]),
            "word": pa.concat_arrays([
                pa.nulls(size, pa.large_string()), distinct.cast(pa.large_string()).take(pa.array(word)),
            ]).cast(pa.string()),
            "times": pa.concat_arrays([pa.nulls(size, pa.int64()), pa.array(times.astype(np.int64))]),
            "doc_id": pa.concat_arrays([step.column("doc_id"), pa.nulls(len(rare), pa.int64())]),
            "held_out": pa.concat_arrays([step.column("held_out"), pa.nulls(len(rare), pa.bool_())]),
            "n_tokens": after(words.counts().astype(np.int64) + 1, pa.int64()),
            "n_known": after(n_known.astype(np.int64), pa.int64()),
            "base_score": after(base, pa.float64()), "score": after(score, pa.float64()),
        }

    return mapped(
        docs, "text", run,
        "row long, word string, times long, doc_id long, held_out boolean, n_tokens long, "
        "n_known long, base_score double, score double",
    )
