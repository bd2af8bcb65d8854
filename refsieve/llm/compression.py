"""Quality by compression: two zstandard dictionaries, one of good and one of bad text.

Dictionaries are built from blocks of a bounded sample of labelled documents. A text is cut into
blocks of equal size and every block is compressed alone, with either dictionary and without one,
so that a long text leans on the dictionaries as much as a short one. The difference of the two
sizes, over the size without a dictionary, says which text it resembles. A logistic calibration on
labelled documents that gave no block turns it, with how far the text compresses at all, into a
score from 0 to 1.

Fitting reads at most ``SAMPLE_ROWS`` labelled rows of each label and ``BLOCKS_PER_TEXT`` blocks of
each; all of that is what the driver holds. Scoring is one pass over all whole texts.

Defined results: null and empty texts have one empty block. Contradictory labels are left out.
Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import few, mapped, split_of, texts_only
from refsieve.llm.rules import sure_labels
from refsieve.session import stored

SAMPLE_ROWS, BLOCKS_PER_TEXT = 2_000, 3
BLOCK, DICTIONARY, LEVEL = 2_048, 65_536, 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def blocks_of(text: bytes) -> list[bytes]:
    """Blocks of nearly equal size, none above ``BLOCK`` bytes; an empty text is one empty block."""
    n = max(1, -(-len(text) // BLOCK))
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple:
    """Compressors with the good, the bad and no dictionary, kept by each worker."""
    plain = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    made = [zstandard.ZstdCompressor(compression_params=plain)]
    for content in (good, bad):
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(compression_params=plain)
        made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=plain))
    return made[1], made[2], made[0]


def features(text: bytes, good: bytes, bad: bytes) -> list[float]:
    """Normalised difference, sizes over length, and length of a text."""
    blocks = blocks_of(text)
    with_good, with_bad, plain = (sum(len(c.compress(b)) for b in blocks) for c in _compressors(good, bad))
    length = len(text) + 1
    return [
        (with_bad - with_good) / plain, min(with_good, with_bad) / length, plain / length, np.log1p(len(text)),
        (with_bad - with_good) / length,
    ]


def _matrix(texts: pa.Array, model_good: bytes, model_bad: bytes) -> np.ndarray:
    found = [features(t or b"", model_good, model_bad) for t in texts.cast(pa.binary()).to_pylist()]
    return np.array(found, np.float64).reshape(-1, 5)


def _expand(x: np.ndarray, mean, scale) -> np.ndarray:
    """Scaled features, their squares and an intercept."""
    z = np.clip((x - np.array(mean)) / np.array(scale), -6, 6)
    return np.hstack([z, z**2, np.ones((len(z), 1))])


def score_of(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_expand(x, model.mean, model.scale) @ np.array(model.weights), -30, 30)))


def _logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights by Newton steps, halved while they do not lower the loss; both labels weigh the same."""
    share = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    penalty = ridge * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float((share * np.logaddexp(0, np.where(label > 0, -1, 1) * (x @ w))).sum() + w @ penalty @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (share * (p - label)) + penalty @ w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + penalty
        step, before = np.linalg.solve(hessian, gradient), loss(w)
        while loss(w - step) > before and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(good: list[bytes], bad: list[bytes]) -> list[bytes]:
    """One dictionary of each class, trained on as many bytes and of one size.

    Where there is too little to train on, the blocks themselves are the dictionary.
    """
    most = min(sum(map(len, good)), sum(map(len, bad)))
    size = max(4_096, min(DICTIONARY, most // 8))
    made = []
    for blocks in (good, bad):
        ends = np.cumsum([len(b) for b in blocks])
        blocks = blocks[: int(np.searchsorted(ends, most)) + 1]
        try:
            made.append(zstandard.train_dictionary(size, blocks).as_bytes())
        except zstandard.ZstdError:
            made.append(b"".join(blocks)[-size:])
    return made


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text, label, builds`` of the sample, dealt by a hash of the id in two halves."""
    sure = sure_labels(labels, "quality").filter(split_of(F.col("doc_id"), 3) != 1)
    counts = dict(tuple(row) for row in sure.groupBy("label").count().collect())
    chosen = [few(sure.filter(F.col("label") == v), counts.get(v, 0), rows, "doc_id") for v in (0, 1)]
    both = chosen[0].unionByName(chosen[1]).withColumn("builds", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0)
    return texts_only(docs).join(F.broadcast(both), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Dictionaries and calibration from labelled documents of the training part."""
    sample = _sample(docs, labels, rows)

    def cut(step: pa.RecordBatch) -> dict:
        label, block = [], []
        for value, text in zip(step.column("label").to_pylist(), step.column("text").cast(pa.binary()).to_pylist()):
            some = blocks_of(text or b"")
            picked = some[:: -(-len(some) // BLOCKS_PER_TEXT)]
            block += picked
            label += [value] * len(picked)
        return {"label": pa.array(label, pa.int32()), "block": pa.array(block, pa.binary())}

    found = mapped(sample.filter("builds"), "text", cut, "label int, block binary")
    # Of an id with many rows no more than the bound comes to the driver, and that in one table.
    found = stored(found.orderBy(F.xxhash64("block"), "block", "label").limit(2 * rows * BLOCKS_PER_TEXT), "blocks")
    found = found.orderBy(F.xxhash64("block"), "block", "label").toPandas()
    held = [[bytes(b) for b in found["block"][found["label"] == v] if len(b)] for v in (1, 0)]
    if not (held[0] and held[1]):
        return None
    good, bad = _dictionaries(*held)
    rest = mapped(
        sample.filter("NOT builds"), "text",
        lambda step: {
            "doc_id": step.column("doc_id"), "label": step.column("label"),
            "x": pa.array(list(_matrix(step.column("text"), good, bad)), pa.list_(pa.float64())),
        },
        "doc_id long, label int, x array<double>",
    ).orderBy(F.xxhash64("doc_id", "x"), "doc_id").limit(2 * rows).toPandas()
    label = rest["label"].to_numpy(np.float64)
    if len(np.unique(label)) < 2:
        return None
    x = np.stack(rest["x"].to_list())
    mean, scale = tuple(x.mean(0)), tuple(x.std(0) + 1e-9)
    return Model(good, bad, mean, scale, tuple(_logistic(_expand(x, mean, scale), label)))


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(step: pa.RecordBatch) -> dict:
        if model is None:
            score = np.full(step.num_rows, 0.5)
        else:
            score = score_of(_matrix(step.column("text"), model.good, model.bad), model)
        return {
            "doc_id": step.column("doc_id"), "held_out": step.column("held_out"), "score": score,
            "predicted": (score >= 0.5).astype(np.int32),
        }

    marked = texts_only(docs).select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return mapped(marked, "text", run, "doc_id long, held_out boolean, score double, predicted int")
