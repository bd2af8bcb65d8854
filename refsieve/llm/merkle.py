"""A Merkle manifest of a dataset, with a witness per row, built by appending.

Leaves are digests of rows. Those of one language are a tree, in the order of their ids, and the
roots of the languages are the leaves of the tree above. In every tree, each two consecutive nodes
become their digest, a last one without a partner the digest of itself, until one node remains.

Witnesses grow as the tree does. A ``Frontier`` holds the open subtrees of what was appended, and
for each leaf in them its partial witness: the siblings met so far. When a subtree's sibling is
complete, the two close into one, and the witnesses of the leaves on both sides take the other's
root. No leaf is visited again from the root down.

1. Leaves get their places by a range sort (``order.placed``), and are dealt in aligned blocks of
   ``2 ** HEIGHT``. One task appends the leaves of a block, in a step of bounded memory, and gives
   the root of the block and the partial witness of each leaf.
2. Roots of blocks are appended in blocks of their own, and so on until each tree has one root;
   this takes ``log(n) / HEIGHT`` rounds, two of them for 16 million leaves. Then the roots of
   the languages are appended likewise.
3. The witness of a leaf is its own partial witness, followed by that of its block, of the block's
   block, and of its language. Every row is folded anew from its leaf, or from the leaf of a tampered
   row, through its witness, and the outcome compared with the root.

Defined results: a null column is ``-`` in the leaf. Rows without a language are a tree of their own,
the first. Rows without an id come first in their tree; rows of one id follow the digests of their
leaves, and equal rows are as many leaves, each with its own witness. A row without an id or
without ``n_chars`` is never tampered with. A tree of one leaf has it as its root, and an empty
witness. An empty table gives no rows. Only the five columns of a document count, others never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.llm.order import placed
from refsieve.session import stored

# A block has 2 ** HEIGHT leaves.
HEIGHT = 12
# Rows whose id has a CRC divisible by this are tampered with.
TAMPERED = 7
LEFT, RIGHT, ALONE = b"l", b"r", b"-"


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Frontier:
    """Open subtrees of the digests appended so far, and the partial witness of each.

    ``witness[i]`` and ``sides[i]`` hold, level by level, the siblings of leaf ``i`` and where they
    stand; a level without a sibling has a side and no digest.
    """

    def __init__(self):
        self.open: list[tuple[int, str, int]] = []  # height, digest, first leaf
        self.witness: list[bytearray] = []
        self.sides: list[bytearray] = []

    def append(self, digest: str) -> None:
        """Put a leaf to the right; closes every subtree whose sibling this completes."""
        self.open.append((0, digest, len(self.witness)))
        self.witness.append(bytearray())
        self.sides.append(bytearray())
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._close()

    def _close(self) -> None:
        (height, left, first), (_, right, second) = self.open[-2:]
        for begin, end, digest, side in ((first, second, right, RIGHT), (second, len(self.witness), left, LEFT)):
            raw = bytes.fromhex(digest)
            for i in range(begin, end):
                self.witness[i] += raw
                self.sides[i] += side
        self.open[-2:] = [(height + 1, joined(left, right), first)]

    def _raise(self) -> None:
        height, digest, first = self.open[-1]
        for i in range(first, len(self.witness)):
            self.sides[i] += ALONE
        self.open[-1] = (height + 1, joined(digest), first)

    def finish(self, height: int | None = None) -> str:
        """Root of all leaves, of a tree of at least ``height``: the last node of a level may be alone."""
        while len(self.open) > 1:
            if self.open[-1][0] < self.open[-2][0]:
                self._raise()
            else:
                self._close()
        while height is not None and self.open[-1][0] < height:
            self._raise()
        return self.open[0][1]


def folded(digest: str, witness: bytes, sides: bytes) -> str:
    """Root that follows from a leaf and its witness."""
    at = 0
    for side in sides.decode():
        if side == "-":
            digest = joined(digest)
            continue
        sibling, at = witness[at: at + 32].hex(), at + 32
        digest = joined(sibling, digest) if side == "l" else joined(digest, sibling)
    return digest


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` or its size in bytes, a colon and itself."""
    parts = [
        F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in fields
    ]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, tampered``: digests of all rows; ``tampered`` is null where nothing was changed."""
    def text(name: str) -> Column:
        return F.col(name).cast("string")

    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    before, after = [text("doc_id"), text("source"), text("lang")], [text("text")]
    changed = (F.crc32(text("doc_id")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), text("lang"))).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf_digest(*before, text("n_chars"), *after)).alias("digest"),
        F.when(changed, F.unhex(leaf_digest(*before, more, *after))).alias("tampered"),
        # Tells equal rows apart, so that a range sort can part them.
        F.monotonically_increasing_id().alias("copy"),
    )


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Each node's partial witness within its block; the first node of a block carries its root.

    ``nodes`` has ``tree, place, n, digest`` and columns that are handed through; the result has
    ``block`` and the columns of the witness besides.
    """
    kept = [f for f in nodes.schema.fields if f.name != "n"]
    names = [f.name for f in kept]

    def grown(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        frontier = Frontier()
        for digest in table.column("digest").to_pylist():
            frontier.append(digest.hex())
        # A block of several in its tree is as high as all of them.
        root = frontier.finish(height if table.column("n")[0].as_py() > 1 << height else None)
        made = table.select(names)
        size = len(frontier.sides)
        return made.append_column("witness", pa.array([bytes(w) for w in frontier.witness], pa.binary())).append_column(
            "sides", pa.array([s.decode() for s in frontier.sides], pa.string())
        ).append_column("root", pa.array([bytes.fromhex(root)] + [None] * (size - 1), pa.binary())).append_column(
            "block", pa.array([p >> height for p in table.column("place").to_pylist()], pa.int64())
        )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return nodes.withColumn("_block", F.shiftright("place", height)).groupBy("tree", "_block").applyInArrow(
        lambda table: grown(table.drop_columns(["_block"])),
        f"{schema}, witness binary, sides string, root binary, block long",
    )


def _grown(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Rounds of blocks, from ``nodes`` to one root per tree; each round's table is written."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    rounds = []
    while not rounds or most > 1:
        rounds.append(stored(_blocks(nodes, height), f"{name}-{len(rounds)}"))
        size = 1 << height
        most = -(-most // size)
        nodes = _roots(rounds).select("tree", F.col("block").alias("place"), F.col("root").alias("digest"))
        nodes = nodes.join(nodes.groupBy("tree").agg(F.count("*").alias("n")), "tree")
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """Rows that carry the roots of the last round's blocks."""
    return rounds[-1].filter("root IS NOT NULL")


def _followed(rows: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``rows`` (``tree, block, witness, sides``) with their witnesses extended by those of ``rounds``."""
    for later in rounds:
        upper = later.select(
            "tree", F.col("place").alias("block"), F.col("block").alias("_next"),
            F.col("witness").alias("_more"), F.col("sides").alias("_sides"),
        )
        rows = rows.join(upper, ["tree", "block"]).withColumns({
            "witness": F.concat("witness", "_more"), "sides": F.concat("sides", "_sides"), "block": F.col("_next"),
        }).drop("_more", "_sides", "_next")
    return rows


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``doc_id, digest, tampered, subroot, top, witness, sides``: every row with its whole witness.

    Digests are binary; ``top`` is the root of all.
    """
    rows = placed(leaves(docs), "tree", ["doc_id", "digest", "copy"], "leaves").drop("copy")
    rounds = _grown(rows, height, "witnesses")
    subroots = _roots(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    above = _grown(placed(subroots, "tree", ["name"], "subroots"), height, "upper-witnesses")
    top = _roots(above).select("tree", F.col("root").alias("top"))
    languages = _followed(above[0], above[1:]).join(top, "tree").select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "top",
        F.col("witness").alias("_more"), F.col("sides").alias("_sides"),
    )
    whole = _followed(rounds[0].drop("root"), rounds[1:])
    return whole.join(languages, "tree").select(
        "doc_id", "digest", "tampered", "subroot", "top",
        F.concat("witness", "_more").alias("witness"), F.concat("sides", "_sides").alias("sides"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of a manifest."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = batch.to_pydict()
            leaf, subroot, root = ([d.hex() for d in rows_[c]] for c in ("digest", "subroot", "top"))
            given = [x if t is None else t.hex() for x, t in zip(leaf, rows_["tampered"])]
            ends = [folded(*row) for row in zip(given, rows_["witness"], (s.encode() for s in rows_["sides"]))]
            proof = [joined(w.hex()) for w in rows_["witness"]]
            same = [a == b for a, b in zip(ends, root)]
            made = [batch.column("doc_id"), leaf, subroot, root, proof, ends, same]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names)

    return rows.mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )


def manifest_report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every row's digests, its proof, and whether the (tampered) row folds to the root."""
    return verified(manifest(docs, height))
