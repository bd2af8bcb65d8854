"""Repeated spans of words, by compaction of a de Bruijn graph.

Every window of ``window`` words is an edge of the graph, from its first words to its last ones; a
word goes if a repeated edge covers it. Edges are many, so they are compacted before they meet:
windows of a text that share an anchor, the least hash of a few words in them, follow each other as
a path without a branch of its own, and equal windows always lie under equal anchors.

1. Each path is one row: hashes of its anchor and of all its words, and where it lies.
2. Paths are counted. A path found twice or more is repeated as a whole, all its edges with it. An
   anchor with several different paths is a branching; there, single paths may still share edges.
3. Places of repeated paths, and of paths at branchings, are joined back to their documents.
4. Paths at branchings are expanded into edges: all single ones, and of each repeated one the place
   it has in the document that comes first. Edges are counted, and joined back to single paths.
5. Documents drop the words that repeated paths and edges cover.

Source coordinates verify what hashes say: at every place the words are hashed again with another
seed, and a path counts as repeated only if all its places agree; else it is expanded into edges,
which carry both hashes as their key.

Rows are told apart by a number that is written once, with id and text. Intermediates are written to
the shared folder.

Defined results: a null or empty text has no words, nothing removed, and the digest of an empty
text. Rows of one id are documents of their own, and copies of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import Words, mapped, numbered, texts_only, words_of
from refsieve.llm.storage import freed_early
from refsieve.llm.windows import anchored_paths, run_hashes, spans_hash, word_hashes
from refsieve.session import stored

WINDOW, GRAM = 35, 8
SEEDS = (1, 2)
SINGLE, WHOLE, LEADING = 1, 0, 2


def _wide(window: int) -> int:
    return 1 << (window.bit_length() - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def paths(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``row, first, count, anchor, path, proof``: all paths of all texts, with both hashes."""
    wide = _wide(window)

    def run(step: pa.RecordBatch) -> dict:
        words = words_of(step.column("text"))
        hashes = [word_hashes(words, seed) for seed in SEEDS]
        found = anchored_paths(hashes[0], words, window, gram)
        size = found.count + window - 1
        path, proof = (_signed(spans_hash(run_hashes(h, wide), wide, found.first, size)) for h in hashes)
        text = np.searchsorted(words.first, found.first, "right") - 1
        return {
            "row": step.column("row").take(pa.array(text)), "path": path, "proof": proof,
            "first": pa.array((found.first - words.first[text]).astype(np.int32)),
            "count": pa.array(found.count.astype(np.int32)), "anchor": _signed(found.anchor),
        }

    return mapped(
        docs.select("row", "text"), "text", run,
        "row long, path long, proof long, first int, count int, anchor long",
    )


def path_kinds(found: DataFrame) -> DataFrame:
    """``anchor, path, whole, branching, least_row`` of paths that have something repeated.

    ``whole``: found more than once, with one proof. ``branching``: its anchor has a path that is
    not whole.
    """
    each = found.groupBy("anchor", "path").agg(
        F.count("*").alias("n"), F.min("row").alias("least_row"),
        F.min("proof").alias("low"), F.max("proof").alias("high"),
    ).withColumn("whole", (F.col("n") > 1) & (F.col("low") == F.col("high")))
    each = stored(each.select("anchor", "path", "n", "whole", "least_row"), "paths-counted")
    anchors = each.groupBy("anchor").agg(
        F.sum("n").alias("total"), F.max(~F.col("whole")).alias("branching")
    ).filter("total > 1")
    return each.join(anchors, "anchor").filter("whole OR branching").select(
        "anchor", "path", "whole", "branching", "least_row"
    )


def marks(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """``row, marks``: per document its paths that matter, as ``first, count, kind``."""
    kind = (
        F.when(~F.col("whole"), SINGLE)
        .when(F.col("branching") & (F.col("row") == F.col("least_row")), LEADING).otherwise(WHOLE)
    )
    return found.join(kinds, ["anchor", "path"]).select(
        "row", F.struct("first", "count", kind.cast("int").alias("kind")).alias("mark")
    ).groupBy("row").agg(F.collect_list("mark").alias("marks"))


def _flat_marks(step: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows of the step that list entries belong to, and the entries' fields."""
    lists = step.column(name)
    owner = lists.value_parent_indices().to_numpy(zero_copy_only=False)
    values = lists.flatten()
    if not pa.types.is_struct(values.type):
        return owner, {"": values.to_numpy(zero_copy_only=False)}
    return owner, {
        field.name: values.field(i).to_numpy(zero_copy_only=False) for i, field in enumerate(values.type)
    }


def edges(docs: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """``edge, proof, row, place, times``: edges of the paths at branchings."""
    wide = _wide(window)

    def run(step: pa.RecordBatch) -> dict:
        words = words_of(step.column("text"))
        hashes = [word_hashes(words, seed) for seed in SEEDS]
        owner, mark = _flat_marks(step, "marks")
        open_ = mark["kind"] != WHOLE
        owner, first, count, kind = (x[open_] for x in (owner, mark["first"], mark["count"], mark["kind"]))
        total = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        place = np.arange(total[-1]) - np.repeat(total[:-1] - first, count)
        owner = np.repeat(owner, count)
        start = words.first[owner] + place
        size = np.full(len(start), window, np.int64)
        edge, proof = (_signed(spans_hash(run_hashes(h, wide), wide, start, size)) for h in hashes)
        return {
            "edge": edge, "proof": proof, "row": step.column("row").take(pa.array(owner)),
            "place": pa.array(place.astype(np.int32)),
            "times": pa.array(np.repeat(np.where(kind == LEADING, 2, 1), count).astype(np.int32)),
        }

    texts = docs.select("row", "text").join(marked.filter(F.exists("marks", lambda m: m["kind"] != WHOLE)), "row")
    return mapped(texts, "text", run, "edge long, proof long, row long, place int, times int")


def repeated_edges(found: DataFrame) -> DataFrame:
    """``row, places``: per document the windows of single paths that are found elsewhere."""
    often = found.groupBy("edge", "proof").agg(F.sum("times").alias("n")).filter("n > 1").select("edge", "proof")
    return found.filter("times = 1").join(often, ["edge", "proof"]).groupBy("row").agg(
        F.collect_list("place").alias("places")
    )


def _covered(words: Words, step: pa.RecordBatch, window: int) -> np.ndarray:
    depth = np.zeros(len(words.start) + 1, np.int64)
    owner, mark = _flat_marks(step, "marks")
    whole = mark["kind"] != SINGLE
    first = words.first[owner[whole]] + mark["first"][whole]
    np.add.at(depth, first, 1)
    np.add.at(depth, first + mark["count"][whole] + window - 1, -1)
    owner, place = _flat_marks(step, "places")
    first = words.first[owner] + place[""]
    np.add.at(depth, first, 1)
    np.add.at(depth, first + window, -1)
    return np.cumsum(depth[:-1]) > 0


def _kept_texts(words: Words, gone: np.ndarray) -> list[bytes]:
    out, data = [], words.data
    for i in range(len(words.base) - 1):
        a, b = words.first[i], words.first[i + 1]
        keep = ~gone[a:b]
        pieces = zip(words.start[a:b][keep].tolist(), words.end[a:b][keep].tolist())
        raw = data[words.base[i]: words.base[i + 1]].tobytes()
        base = int(words.base[i])
        out.append(b" ".join([raw[s - base: e - base] for s, e in pieces]))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the ``kept`` words of every document, joined by spaces.

    With ``digest`` the SHA-256 of ``kept`` comes in its place, as ``kept_sha256``.
    """
    docs, _ = numbered(texts_only(docs))
    with freed_early(docs.sparkSession):
        found = stored(paths(docs, window, gram), "paths")
        kinds = stored(path_kinds(found), "path-kinds")
        marked = stored(marks(found, kinds), "marks")
        single = stored(edges(docs, marked, window), "edges")
        places = stored(repeated_edges(single), "edge-places")

    def run(step: pa.RecordBatch) -> dict:
        words = words_of(step.column("text"))
        gone = _covered(words, step, window)
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = _kept_texts(words, gone)
        return {
            "doc_id": step.column("doc_id"), "n_words": pa.array(words.counts().astype(np.int64)),
            "n_removed": pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)),
            name: pa.array([hashlib.sha256(k).hexdigest() for k in kept] if digest
                           else [k.decode("utf-8", "replace") for k in kept], pa.string()),
        }

    name = "kept_sha256" if digest else "kept"
    gone = marked.join(places, "row", "left")
    return mapped(
        docs.join(gone, "row", "left").drop("row"), "text", run,
        f"doc_id long, n_words long, n_removed long, {name} string",
    )
