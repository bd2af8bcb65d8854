"""Language of texts by a bidirectional gated recurrent network over bytes.

A text is cut into stretches of bytes; the network reads each from both ends, starting anew, and
gives every position probabilities of the languages from both states. The document's probability
is the mean over all its positions. All stretches of a batch of texts run side by side, one byte at
a time, so a step is a few products of small matrices; what a byte adds to the gates is a table.

Training is backpropagation through time in numpy, on the driver, over stretches of a bounded
sample: at most ``SAMPLE_ROWS`` documents of each language, dealt by a hash of their id. The
network starts from a fixed seed, so the same sample gives the same network.

Defined results: a text that is null or has no letter is ``und`` with score 0. With one language to
learn it is the answer for all others; with none everything is ``und``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import few, mapped, split_of

UNKNOWN = "und"
SAMPLE_ROWS = 400
HIDDEN, STRETCH = 8, 128
STEPS, BATCH, TRAIN_BYTES, RATE = 350, 96, 48, 0.02
# Stretches that run side by side.
LANES = 2_048


class Network(NamedTuple):
    """``table[byte]`` holds the three gates' input of each direction, bias included."""

    table: list[np.ndarray]
    gates: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _start(languages: int, hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        [some(256, 3 * hidden, scale=0.3) for _ in range(2)],
        [some(hidden, 2 * hidden, scale=hidden**-0.5) for _ in range(2)],
        [some(hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
        some(2 * hidden, languages, scale=(2 * hidden) ** -0.5), np.zeros(languages, np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(codes: np.ndarray, table: np.ndarray, gates: np.ndarray, state: np.ndarray, keep: bool):
    """States after each byte of ``codes`` (time by lane); with ``keep`` what training needs too."""
    time, lanes = codes.shape
    hidden = state.shape[0]
    h = np.zeros((lanes, hidden), np.float32)
    states = np.empty((time, lanes, hidden), np.float32)
    kept = []
    for t in range(time):
        inputs = table[codes[t]]
        zr = _sigmoid(inputs[:, : 2 * hidden] + h @ gates)
        z, r = zr[:, :hidden], zr[:, hidden:]
        reset = r * h
        new = np.tanh(inputs[:, 2 * hidden:] + reset @ state)
        if keep:
            kept.append((h, z, r, reset, new))
        h = h + z * (new - h)
        states[t] = h
    return states, kept


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _back(codes, kept, gates, state, above):
    """Gradients of one direction, last byte first; ``above`` is what each state gets from the output."""
    time, lanes = codes.shape
    hidden = state.shape[0]
    d_table = np.zeros((256, 3 * hidden), np.float32)
    d_gates, d_state = np.zeros_like(gates), np.zeros_like(state)
    later = np.zeros((lanes, hidden), np.float32)
    for t in range(time - 1, -1, -1):
        h, z, r, reset, new = kept[t]
        g = above[t] + later
        d_new = g * z * (1 - new**2)
        d_z = g * (new - h) * z * (1 - z)
        d_reset = d_new @ state.T
        d_r = d_reset * h * r * (1 - r)
        d_zr = np.hstack([d_z, d_r])
        d_state += reset.T @ d_new
        d_gates += h.T @ d_zr
        np.add.at(d_table, codes[t], np.hstack([d_zr, d_new]))
        later = g * (1 - z) + d_reset * r + d_zr @ gates.T
    return d_table, d_gates, d_state


def train(
    texts: list[bytes], labels: np.ndarray, languages: int, steps: int = STEPS, hidden: int = HIDDEN, seed: int = 11,
) -> Network:
    """A network fitted to random stretches of the texts, every language as often, by Adam."""
    net, rng = _start(languages, hidden, seed), np.random.default_rng(seed + 1)
    flat = [*net.table, *net.gates, *net.state, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    per_language = [np.flatnonzero(labels == k) for k in range(languages)]
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    for step in range(1, steps + 1):
        label = rng.integers(languages, size=BATCH)
        codes = np.zeros((TRAIN_BYTES, BATCH), np.uint8)
        for lane, k in enumerate(label):
            text = arrays[rng.choice(per_language[k])]
            at = int(rng.integers(max(1, len(text) - TRAIN_BYTES + 1)))
            piece = text[at: at + TRAIN_BYTES]
            codes[: len(piece), lane] = piece
        ahead, kept = _read(codes, net.table[0], net.gates[0], net.state[0], True)
        behind, kept_b = _read(codes[::-1], net.table[1], net.gates[1], net.state[1], True)
        both = np.concatenate([ahead, behind[::-1]], 2)
        p = _softmax(both @ net.out + net.bias)
        p[:, np.arange(BATCH), label] -= 1
        p /= p.shape[0] * BATCH
        d_out = np.einsum("tbh,tbk->hk", both, p)
        above = p @ net.out.T
        forward = _back(codes, kept, net.gates[0], net.state[0], above[:, :, :hidden])
        backward = _back(codes[::-1], kept_b, net.gates[1], net.state[1], above[::-1, :, hidden:])
        grads = [forward[0], backward[0], forward[1], backward[1], forward[2], backward[2], d_out, p.sum((0, 1))]
        rate = RATE * (1 - step / (steps + 1)) + 1e-4
        for value, grad, m, s in zip(flat, grads, first, second):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def _cuts(size: int, stretch: int) -> np.ndarray:
    n = max(1, -(-size // stretch))
    return np.arange(n + 1) * size // n


def position_sums(texts: pa.Array, net: Network, stretch: int = STRETCH) -> np.ndarray:
    """Per text, the sum over its positions of the probabilities of each language."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    pieces = np.maximum(1, -(-size // stretch))
    owner = np.repeat(np.arange(len(size)), pieces)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[owner] + turn * size[owner] // pieces[owner]
    length = offsets[owner] + (turn + 1) * size[owner] // pieces[owner] - start
    sums = np.zeros((len(size), len(net.bias)))
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    for at in range(0, len(order), LANES):
        lanes = order[at: at + LANES]
        time = int(length[lanes].max())
        step = np.arange(time)[:, None]
        inside = step < length[lanes]
        place = np.where(inside, start[lanes] + step, start[lanes])
        # Read from the end, a short stretch begins at its own last byte.
        mirrored = np.where(inside, start[lanes] + length[lanes] - 1 - step, start[lanes])
        ahead, _ = _read(data[place], net.table[0], net.gates[0], net.state[0], False)
        behind, _ = _read(data[mirrored], net.table[1], net.gates[1], net.state[1], False)
        half = len(net.out) // 2
        back = np.where(inside, length[lanes] - 1 - step, 0)
        scores = ahead @ net.out[:half] + net.bias
        scores += np.take_along_axis(behind @ net.out[half:], back[:, :, None], 0)
        p = _softmax(scores) * inside[:, :, None]
        np.add.at(sums, owner[lanes], p.sum(0))
    return sums


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], Network | None]:
    """Languages in order, and a network that tells them apart, from the training documents."""
    known = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
        & (split_of(F.col("doc_id").cast("long"), 3) != 1)
    )
    counts = dict(tuple(row) for row in known.groupBy("lang").count().collect())
    languages = sorted(counts)
    if not languages:
        return [], None
    pieces = _stretches(known)
    parts = [
        few(pieces.filter(F.col("lang") == name), counts[name], rows, "doc_id", "piece") for name in languages
    ]
    sample = pd.concat([part.toPandas() for part in parts])
    labels = np.array([languages.index(name) for name in sample["lang"]])
    return languages, train([bytes(t) for t in sample["piece"]], labels, len(languages))


def _stretches(part: DataFrame, most: int = 4_096) -> DataFrame:
    """A stretch of at most ``most`` bytes from the middle of each text."""
    bytes_ = F.col("text").cast("binary")
    size = F.octet_length("text")
    start = F.greatest(F.lit(1), F.floor((size - most) / 2) + 1).cast("int")
    return part.select("doc_id", "lang", F.substring(bytes_, start, F.lit(most)).alias("piece"))


def predict(docs: DataFrame, languages: list[str], net: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    names = pa.array([*languages, UNKNOWN], pa.string())

    def run(step: pa.RecordBatch) -> dict:
        letters = step.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        best, score = np.full(step.num_rows, len(languages)), np.zeros(step.num_rows)
        if net is not None:
            sums = position_sums(step.column("text"), net)
            share = sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)
            best[letters] = share.argmax(1)[letters]
            score[letters] = np.clip(share.max(1)[letters], 0, 1)
        return {
            "doc_id": step.column("doc_id"), "held_out": step.column("held_out"),
            "lang_pred": names.take(pa.array(best)), "score": score,
        }

    doc_id = F.col("doc_id").cast("long")
    marked = docs.select(
        doc_id.alias("doc_id"), (split_of(doc_id, 3) == 1).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text",
    )
    return mapped(marked, "text", run, "doc_id long, held_out boolean, lang_pred string, score double")
