"""What the operators of this subpackage share: words, splits by id, and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.session import stored

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Text bytes that one step of a Python worker holds at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(doc_id: Column, parts: int) -> Column:
    """Part of a document by the CRC of its id as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def few(df: DataFrame, n: int, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` of the ``n`` rows of ``df``, dealt by a hash of ``keys``.

    A cut of the hash first leaves about four times as many, so that sorting them takes the same
    however large ``df`` is.
    """
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << 31))
    share = min(1.0, 4 * rows / max(n, 1))
    return df.filter(mark < int(share * (1 << 31)) + 1).orderBy(mark, *keys).limit(rows)


def texts_only(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of a table of documents, whatever else it holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def free_name(name: str, *taken: str) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` has."""
    while name in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row, written once, and the name of its column.

    The numbers follow how files are split, and that may change from one scan to the next; so rows
    that are joined by number read the one copy that has it.
    """
    row = free_name("row", *docs.columns)
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd"), row


class Words(NamedTuple):
    """Words of a batch of texts, as places in one buffer of bytes.

    ``first[i]:first[i + 1]`` are the words of text ``i``; word ``w`` is
    ``data[start[w]:end[w]]``; ``base[i]`` is where text ``i`` begins.
    """

    data: np.ndarray
    base: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.base) - 1), self.counts())

    def array(self) -> pa.Array:
        """The words as an Arrow array."""
        size = self.end - self.start
        offsets = np.concatenate([[0], np.cumsum(size)])
        inside = np.repeat(self.start - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.Array.from_buffers(
            pa.large_binary(), len(size),
            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[inside])],
        )

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Number of each word among the distinct words, and these."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none. ``lower`` lower-cases A-Z."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    data, base = data[offsets[0]: offsets[-1]], offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    filled = base[:-1] < base[1:]
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[base[:-1][filled]] = False
    after[base[1:][filled] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Words(data, base, start, end, np.searchsorted(start, base))


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, cut where their texts reach ``most`` bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mapped(
    df: DataFrame, text: str, function: Callable[[pa.RecordBatch], dict], schema: str, most: int = STEP_BYTES
) -> DataFrame:
    """Rows that ``function`` makes of each step of ``df``; it returns columns by name."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, text, most):
            made = function(step)
            yield pa.RecordBatch.from_arrays([pa.array(made[n]) for n in names], names)

    return df.mapInArrow(run, schema)
