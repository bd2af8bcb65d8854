"""Repeated spans of bytes, found by suffix arrays.

A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller
id. Equal strings are neighbours in a suffix array, and their common prefix says so; the task here
is to bring suffixes together that may be equal, without shuffling one row per byte.

Every window has an anchor, the place of the least hash of ``gram`` bytes in it, so equal windows
have equal anchors. Successive windows under one anchor are a path, at most twice a window long.

1. Documents are written once, in groups of about ``GROUP_BYTES``, and are named by group and place
   in it from then on. A long text is a group of its own and is read in overlapping pieces.
2. Which anchors are found in more than one document, with what stands around them? Two places
   that share a window share half of its other bytes before the anchor, or half of them behind it.
   Groups deal the hashes of both halves, packed five bytes each, over buckets; a bucket answers
   with a bit per hash. This only rules out: a path let through by a collision costs time.
3. Paths of the remaining anchors become rows, without their bytes, and are counted by anchor and hash of
   their bytes, so that copies of a path are one row with its least id.
4. The different paths of an anchor are read from their groups and go to the tasks of their
   anchors, where suffix arrays of a bounded size say for each window which least id has it
   (``suffixes``: two-stage sorting, then common prefixes of neighbours). Anchors with more than
   ``MOST_PATHS`` different paths, such as the ends of a line that a third of all documents share,
   are dealt by their windows' bytes instead, and these counted.
5. What was found goes back to all copies of a path, and to the documents.

Defined results: a null or empty text has no bytes, no spans, and the digest of an empty text. Rows
of one id are no smaller than each other, so they take nothing from each other. A row without an id
is neither smaller nor larger than any: it keeps all and takes nothing. Columns beside ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import steps
from refsieve.llm.storage import freed_early, small_batches
from refsieve.llm.suffixes import common_prefixes, suffix_order
from refsieve.llm.windows import mixed
from refsieve.session import stored

WINDOW, GRAM = 50, 16
# Text bytes of a group; of a piece of a long text.
GROUP_BYTES = 1 << 20
# Bytes of packed anchors of a bucket; of one anchor.
BUCKET_BYTES, CODE_BYTES = 8 << 20, 5
# Different paths of an anchor that meet in one suffix array; bytes of such an array.
MOST_PATHS, ARRAY_BYTES = 4_096, 1 << 18
# Rows that a worker gets at once: documents, groups, paths.
DOCUMENT_ROWS, GROUP_ROWS = 2_000, 4

_U = np.uint64
_PLACE = _U((1 << 24) - 1)
NO_CODE = _U(0)
# A path's place in its group: text, first byte and number of windows in one long.
_TEXT, _FIRST = 37, 6


class Found(NamedTuple):
    """Paths of a group: the text and byte they begin at, their windows, anchor and hash.

    ``before`` and ``behind`` are codes of the anchor with half of a window's other bytes on one
    side, or ``NO_CODE`` where the text ends there.
    """

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    path: np.ndarray
    before: np.ndarray
    behind: np.ndarray


def grouped(docs: DataFrame) -> DataFrame:
    """``grp, ids, texts``: whole texts in groups of about ``GROUP_BYTES``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text", GROUP_BYTES):
            ends = pa.array([0, step.num_rows], pa.int32())
            texts = pc.fill_null(step.column("text").cast(pa.binary()), b"")
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, step.column("doc_id")), pa.ListArray.from_arrays(ends, texts)],
                ["ids", "texts"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession, DOCUMENT_ROWS):
        packed = slim.mapInArrow(run, "ids array<bigint>, texts array<binary>")
        return stored(packed.withColumn("grp", F.monotonically_increasing_id()), "groups", "zstd")


def _bytes_of(texts: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a group, and where each text begins, with the end of the last."""
    values = texts.values.cast(pa.large_binary())
    base = np.frombuffer(values.buffers()[1], np.int64)[values.offset: values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[base[0]: base[-1]], base - base[0]


def _found(data: np.ndarray, base: np.ndarray, window: int, gram: int) -> Found:
    """Paths of texts that lie one after another in ``data``; ``first`` counts from its begin."""
    n = len(data)
    wide = 1 << (window.bit_length() - 1)
    pad = np.concatenate([data, np.zeros(2 * window + 16, np.uint8)])
    m = len(pad) // 8 - 1
    run = np.empty(8 * m, _U)
    for k in range(8):
        run[k::8] = np.frombuffer(pad, "<u8", m, k)
    size, grams = 8, None
    while True:
        if size == gram:
            grams = run
        if size == wide:
            break
        run = mixed(run[:-size], run[size:])
        size *= 2
    # The least hash, the first of equals: places are below the bits that are compared.
    least = (grams[:n] & ~_PLACE) | np.arange(n, dtype=_U)
    width, size = window - gram + 1, 1
    while 2 * size <= width and len(least) > size:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]
    least = (least & _PLACE).astype(np.int64)[: max(n - window + 1, 0)]
    size = np.diff(base)
    inside = np.zeros(n + 1, np.int8)
    long_ = size >= window
    np.add.at(inside, base[:-1][long_], 1)
    np.add.at(inside, base[1:][long_] - window + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[: len(least)].astype(bool)
    begin = inside.copy()
    begin[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    stop = inside & np.append(begin[1:] | ~inside[1:], True)[: len(inside)]
    first, count = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    count = count - first
    # Four runs of hashes cover up to two windows.
    last = count + window - 1 - wide
    parts = [run[first + last * k // 3] for k in range(4)]
    path = mixed(mixed(parts[0], parts[1]), mixed(mixed(parts[2], parts[3]), count.astype(_U)))
    text = np.searchsorted(base, first, "right") - 1
    anchor = least[first]
    half = (window - gram + 1) // 2

    def code(at: np.ndarray, seed: int) -> np.ndarray:
        """Code of the anchor and ``half`` bytes at one side, which begin at ``at`` together."""
        within = (at >= base[text]) & (at + gram + half <= base[text + 1])
        at = np.where(within, at, 0)
        found = np.full(len(at), seed, _U)
        for k in [*range(0, half, gram), half]:
            found = mixed(found, grams[at + k])
        return np.where(within, (found >> _U(64 - 8 * CODE_BYTES)) | _U(1), NO_CODE)

    return Found(text, first, count, grams[anchor], path, code(anchor - half, 1), code(anchor, 2))


def found_paths(data: np.ndarray, base: np.ndarray, window: int, gram: int) -> Found:
    """Paths of a group's texts; ``first`` is the byte of the text. A long text is read in pieces."""
    if len(data) <= 4 * GROUP_BYTES:
        found = _found(data, base, window, gram)
        return found._replace(first=found.first - base[found.text])
    parts = []
    for text, (begin, end) in enumerate(zip(base[:-1].tolist(), base[1:].tolist())):
        for at in range(begin, max(end - window + 1, begin), GROUP_BYTES):
            piece = data[at: min(at + GROUP_BYTES + window - 1, end)]
            part = _found(piece, np.array([0, len(piece)]), window, gram)
            parts.append(part._replace(text=part.text + text, first=part.first + (at - begin)))
    return Found(*(np.concatenate(x) for x in zip(*parts)))


def _named(row: dict, window: int, gram: int) -> tuple[Found, np.ndarray]:
    """Paths of a group whose document has an id, and these ids."""
    found = found_paths(*_bytes_of(row["texts"]), window, gram)
    ids = row["ids"].values
    known = ~np.asarray(ids.is_null())[found.text] if len(found.text) else np.zeros(0, bool)
    found = Found(*(x[known] for x in found))
    return found, np.asarray(ids.fill_null(0))[found.text]


def _packed_codes(found: Found, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a group by bucket and value; whether several of its documents have one; its bucket."""
    rank = np.unique(ids, return_inverse=True)[1].astype(_U)
    codes, rank = np.concatenate([found.before, found.behind]), np.concatenate([rank, rank])
    codes, rank = codes[codes != NO_CODE], rank[codes != NO_CODE]
    # Codes and documents of a group fit into one number.
    pairs = np.unique((codes << _U(24)) | rank) >> _U(24)
    codes, times = np.unique(pairs, return_counts=True)
    bucket = (codes % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return codes[order], times[order] > 1, bucket[order]


def _to_bytes(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // CODE_BYTES, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, CODE_BYTES)
    return out.view("<u8").ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with their lists as they are, a dictionary of scalars each."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def bucket_count(groups: DataFrame, window: int, gram: int) -> int:
    """Buckets of about ``BUCKET_BYTES`` for two codes of each path: two paths a window's room for grams."""
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    total = groups.agg(F.sum(size)).first()[0] or 0
    return 1 + int(4 * total / (window - gram + 2) * CODE_BYTES) // BUCKET_BYTES


def shared_anchors(groups: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """``grp, shared``: per bucket, bits that say which codes of the group other documents have too."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "bucket", "once", "often"]
        for row in _rows(batches):
            codes, several, bucket = _packed_codes(*_named(row, window, gram), buckets)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(bucket))
            once = [_to_bytes(codes[a:b][~several[a:b]]) for a, b in zip(cuts, ends)]
            often = [_to_bytes(codes[a:b][several[a:b]]) for a, b in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["grp"].as_py()] * len(cuts), pa.int64()), pa.array(bucket[cuts], pa.int64()),
                 pa.array(once, pa.binary()), pa.array(often, pa.binary())], names,
            )

    def answer(table: pa.Table) -> pa.Table:
        once = [_from_bytes(x) for x in table.column("once").to_pylist()]
        often = [_from_bytes(x) for x in table.column("often").to_pylist()]
        every = np.sort(np.concatenate([*once, *often, *often]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        flat = np.concatenate(once)
        at = np.minimum(np.searchsorted(twice, flat), max(len(twice) - 1, 0))
        hit = twice[at] == flat if len(twice) else np.zeros(len(flat), bool)
        ends = np.cumsum([len(x) for x in once])[:-1]
        return pa.table({
            "grp": table.column("grp"), "bucket": table.column("bucket"),
            "bits": pa.array([np.packbits(x).tobytes() for x in np.split(hit, ends)], pa.binary()),
        })

    packed = groups.mapInArrow(pack, "grp long, bucket long, once binary, often binary")
    bits = packed.groupBy("bucket").applyInArrow(answer, "grp long, bucket long, bits binary")
    return bits.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("shared"))


def paths(groups: DataFrame, shared: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """``anchor, path, doc_id, grp, spot``: paths of which several documents have a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "path", "doc_id", "grp", "spot"]
        for row in _rows(batches):
            found, ids = _named(row, window, gram)
            codes, several, bucket = _packed_codes(found, ids, buckets)
            hit = several.copy()
            for part in row["shared"].as_py():
                own = (bucket == part["bucket"]) & ~several
                hit[own] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=int(own.sum())).astype(bool)
            left = np.isin(found.before, codes[hit]) | np.isin(found.behind, codes[hit])
            spot = (found.text << _TEXT) | (found.first << _FIRST) | found.count
            grp = np.full(len(ids), row["grp"].as_py())
            columns = [found.anchor.view(np.int64), found.path.view(np.int64), ids, grp, spot]
            yield pa.RecordBatch.from_arrays([pa.array(c[left]) for c in columns], names)

    return groups.join(shared, "grp").mapInArrow(run, "anchor long, path long, doc_id long, grp long, spot long")


def counted(found: DataFrame) -> DataFrame:
    """``anchor, path, least, most, grp, spot``: different paths, their least and greatest id, one place.

    All values of ``first`` come from the row that was first, so both halves of the place agree.
    """
    return found.groupBy("anchor", "path").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.first("grp").alias("grp"), F.first("spot").alias("spot"),
    )


def segments(groups: DataFrame, different: DataFrame, window: int) -> DataFrame:
    """``anchor, path, least, held, segment``: bytes of paths whose anchor has several of them.

    ``held`` is the number of different paths of the anchor.
    """
    anchors = different.groupBy("anchor").agg(
        F.count("*").alias("held"), F.min("least").alias("low"), F.max("most").alias("high")
    ).filter("held > 1 AND low < high").select("anchor", "held")
    wanted = different.join(anchors, "anchor").groupBy("grp").agg(
        F.collect_list(F.struct("anchor", "path", "least", "held", "spot")).alias("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "path", "least", "held", "segment"]
        for row in _rows(batches):
            data, base = _bytes_of(row["texts"])
            fields = row["wanted"].values.flatten()
            spot = np.asarray(fields[4])
            begin = base[spot >> _TEXT] + ((spot >> _FIRST) & ((1 << (_TEXT - _FIRST)) - 1))
            size = (spot & ((1 << _FIRST) - 1)) + window - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            inside = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
            segment = pa.Array.from_buffers(
                pa.binary(), len(spot), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[inside])]
            )
            yield pa.RecordBatch.from_arrays([*fields[:4], segment], names)

    return groups.join(wanted, "grp").mapInArrow(
        run, "anchor long, path long, least long, held long, segment binary"
    )


def earlier_windows(data: np.ndarray, ends: np.ndarray, least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of every window that a segment with a smaller ``least`` has too.

    ``ends`` are the places in ``data`` where segments end, with a 0 before.
    """
    wanted = np.zeros(len(data) + 1, np.int64)
    wanted[ends[:-1]] += 1
    wanted[ends[1:] - window + 1] -= 1
    order = suffix_order(data, np.cumsum(wanted[:-1]) > 0, window)
    equal = common_prefixes(data, order, window) >= window
    owner = np.searchsorted(ends, order, "right") - 1
    begin = np.flatnonzero(np.append(True, ~equal)[: len(order)])
    if not len(begin):
        return owner, order
    first = np.minimum.reduceat(least[owner], begin)
    size = np.diff(np.append(begin, len(order)))
    gone = np.repeat(first, size) < least[owner]
    return owner[gone], order[gone] - ends[owner[gone]]


def in_arrays(found: DataFrame, window: int) -> DataFrame:
    """``anchor, path, gone``: offsets of a path's windows that an earlier document has.

    Anchors meet whole in one suffix array; several of them share one, up to ``ARRAY_BYTES``.
    """
    names = ["anchor", "path", "gone"]

    def solved(table: pa.Table) -> pa.RecordBatch:
        segment = table.column("segment").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(segment).to_numpy())]).astype(np.int64)
        data = np.frombuffer(b"".join(segment.to_pylist()), np.uint8)
        owner, offset = earlier_windows(data, ends, table.column("least").to_numpy(), window)
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        which = pa.array(owner[cuts])
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(cuts, len(owner)), pa.int32()), pa.array(offset, pa.int32())
        )
        return pa.RecordBatch.from_arrays(
            [table.column("anchor").combine_chunks().take(which), table.column("path").combine_chunks().take(which), lists], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            while held.num_rows:
                anchor = held.column("anchor").to_numpy()
                size = np.cumsum(pc.binary_length(held.column("segment")).to_numpy())
                at = int(np.searchsorted(size, ARRAY_BYTES))
                if at >= len(anchor) - 1:
                    break
                # Up to the end of the anchor that reaches the bytes, if that end is here.
                more = np.flatnonzero(anchor[at + 1:] != anchor[at])
                if not len(more):
                    break
                at += int(more[0]) + 1
                yield solved(held.slice(0, at))
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield solved(held)

    slim = found.select("anchor", "path", "least", "segment")
    return slim.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "anchor long, path long, gone array<int>"
    )


def by_windows(found: DataFrame, window: int) -> DataFrame:
    """The same as ``in_arrays`` for anchors with many paths: their windows are counted by their bytes."""
    places = F.sequence(F.lit(0), F.octet_length("segment") - window)
    each = found.select("anchor", "path", "least", "segment", F.explode(places).alias("place")).select(
        "anchor", "path", "least", "place", F.substring("segment", F.col("place") + 1, F.lit(window)).alias("bytes")
    )
    first = each.groupBy("anchor", "bytes").agg(F.min("least").alias("first"))
    return each.join(first, ["anchor", "bytes"]).filter("first < least").groupBy("anchor", "path").agg(
        F.collect_list(F.col("place").cast("int")).alias("gone")
    )


def spans(found: DataFrame, different: DataFrame, earlier: DataFrame) -> DataFrame:
    """``grp, spans``: per group, windows to remove as ``text, first, count``."""
    what = different.join(earlier, ["anchor", "path"], "left").filter("least < most OR gone IS NOT NULL").select(
        "anchor", "path", "least", "gone"
    )
    text = F.shiftright("spot", _TEXT).cast("int")
    first = F.shiftright("spot", _FIRST).bitwiseAND((1 << (_TEXT - _FIRST)) - 1).cast("int")
    count = F.col("spot").bitwiseAND((1 << _FIRST) - 1).cast("int")
    whole = F.array(F.struct(text.alias("text"), first.alias("first"), count.alias("count")))
    single = F.transform("gone", lambda o: F.struct(text.alias("text"), (first + o).alias("first"), F.lit(1).alias("count")))
    return found.join(what, ["anchor", "path"]).select(
        "grp", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(single).alias("parts")
    ).filter("parts IS NOT NULL").groupBy("grp").agg(F.flatten(F.collect_list("parts")).alias("spans"))


def _without(row: dict, window: int, digest: bool) -> pa.RecordBatch:
    data, base = _bytes_of(row["texts"])
    depth = np.zeros(len(data) + 1, np.int64)
    if row["spans"].is_valid:
        text, first, count = (np.asarray(f).astype(np.int64) for f in row["spans"].values.flatten())
        begin = base[text] + first
        depth += np.bincount(begin, minlength=len(depth))
        depth -= np.bincount(begin + count + window - 1, minlength=len(depth))
    gone = np.cumsum(depth[:-1]) > 0
    starts = gone.copy()
    inner = base[(base > 0) & (base < len(data))]
    starts[1:] &= ~gone[:-1]
    starts[inner] = gone[inner]
    removed, runs = (np.concatenate([[0], np.cumsum(x)])[base] for x in (gone, starts))
    kept, left = data[~gone].tobytes(), base - removed
    texts = [kept[a:b] for a, b in zip(left[:-1], left[1:])]
    return pa.RecordBatch.from_arrays(
        [row["ids"].values, pa.array(np.diff(base)), pa.array(np.diff(removed)), pa.array(np.diff(runs)),
         pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else texts, pa.string() if digest else pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the ``kept`` bytes of every document.

    With ``digest`` the SHA-256 of ``kept`` comes in its place, as ``kept_sha256``. ``gram`` is a power
    of two, at least 8 and less than ``window``, with less than 64 places for a gram in a window.
    """
    if gram < 8 or gram & (gram - 1) or gram >= window or window - gram > 62:
        raise ValueError(f"no paths with a window of {window} and grams of {gram} bytes")
    spark = docs.sparkSession
    groups = grouped(docs)
    buckets = bucket_count(groups, window, gram)
    with freed_early(spark), small_batches(spark, GROUP_ROWS):
        shared = stored(shared_anchors(groups, window, gram, buckets), "shared-anchors")
        found = stored(paths(groups, shared, window, gram, buckets), "byte-paths")
        different = stored(counted(found), "different-paths")
        segment = stored(segments(groups, different, window), "segments")
    with freed_early(spark):
        narrow = in_arrays(segment.filter(F.col("held") <= MOST_PATHS), window)
        wide = by_windows(segment.filter(F.col("held") > MOST_PATHS), window)
        earlier = stored(narrow.unionByName(wide), "earlier-windows")
        marked = stored(spans(found, different, earlier), "byte-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _without(row, window, digest)

    left = "kept_sha256 string" if digest else "kept binary"
    with freed_early(spark), small_batches(spark, GROUP_ROWS):
        return stored(groups.join(marked, "grp", "left").select("ids", "texts", "spans").mapInArrow(
            run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {left}"
        ), "kept-bytes")
