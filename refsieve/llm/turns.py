"""Repair of the role structure of conversations, by a suffix-shared automaton of their signatures.

A conversation's signature is one letter per row: the initial of its role, upper case where the
row's text is truncated, ``d`` where the row must go (blank or duplicate), ``x`` for roles beyond
system, user and assistant. Many conversations have one signature, and many signatures end alike.

A node of the automaton is what follows a row, up to the end. What repair costs from there, and which
edits are best, depends on that and on the state of the grammar alone, so both are found once per
node and state: a node's four states take their best edit from the node after it. Signatures that
end alike share these nodes, whichever conversations they come from.

1. Rows are sorted by conversation and turn over ranges, written once, and numbered (``order.in_order``).
2. Rows seen earlier are told by the least number of each role and text of a conversation. Slim
   rows (number, letter) become pieces of at most ``PIECE`` rows, and pieces signatures.
3. Distinct signatures, written backwards, are sorted over ranges. Neighbours then share the longest
   ends; a task walks them with a stack of nodes, pops to the shared end and pushes what is new, so
   that it holds no more than its longest signature.
4. Edits go back to the pieces. A piece's texts are read with its edits and become a stretch of the
   repaired text; a conversation of one piece is digested at once, stretches of longer ones are
   sorted and digested as they stream.

No task holds a conversation's texts, however many turns it has; only its letters and edits, which the
result holds too.

Defined results: nulls count as one space in every column, so a null text is blank and a null role
is beyond the grammar; a null turn comes first and counts neither for gaps nor for turns. Rows of
one turn follow role, then the first 64 characters of their text, then a hash of it. An empty role is no pair with its neighbours and beyond the grammar.
A conversation without rows after damage has zeros, no edits, and the digest of an empty text; a
conversation without an id is one conversation. Extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.llm.order import in_order
from refsieve.llm.storage import small_batches
from refsieve.session import stored

# Rows of a piece of a conversation; their texts are held at once.
PIECE = 1_024
# Rows, and stretches of rows, whose texts a worker gets at once.
ROWS, STRETCHES = 1_024, 16
SPACE = " \t\n\x0b\x0c\r"

# States of the grammar ``(s?(ua)+)?``: at the start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
# The role that an insertion or a new role takes in each state, and the state after it.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


class Best(NamedTuple):
    """Least cost from a node and a state, and the first edit of the best ones."""

    cost: int
    edit: str
    state: int


Node = tuple[Best | None, Best | None, Best | None, Best | None]


def _inserted(found: list[Best | None]) -> Node:
    """Insertions before what ``found`` does; two of them lead through all states."""
    for _ in range(2):
        found = [
            min((b for b in (
                best, found[to] and Best(found[to].cost + INSERT, "I", to)) if b is not None), default=None)
            for best, to in ((found[s], AFTER[WANTED[s], s]) for s in range(4))
        ]
    return tuple(found)


END = _inserted([Best(0, "", START), None, None, Best(0, "", ASSISTANT)])


def node_before(letter: str, after: Node) -> Node:
    """The node of a row and of all that follows it."""
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    found: list[Best | None] = []
    for state in range(4):
        options = [Best(after[state].cost + DELETE, "D", state)]
        if role != "d":
            to = AFTER[WANTED[state], state]
            options.append(Best(after[to].cost + REROLE + extra, "R", to))
            if (role, state) in AFTER:
                to = AFTER[role, state]
                options.append(Best(after[to].cost + extra, "K", to))
        # Options differ in their first edit, which settles ties between whole audits.
        found.append(min(options))
    return _inserted(found)


def edits_along(nodes: list[Node]) -> tuple[int, str]:
    """Cost and audit of the signature whose nodes these are, the last node first."""
    state, at, out = START, len(nodes) - 1, []
    cost = nodes[at][START].cost
    while True:
        _, edit, to = nodes[at][state]
        if not edit:
            return cost, "".join(out)
        out.append(edit)
        state = to
        at -= edit != "I"


def audited(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of distinct signatures; nodes are shared along sorted ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, ends = [END], ""
        for batch in batches:
            made = []
            for backwards in batch.column("backwards").to_pylist():
                shared = 0
                most = min(len(ends), len(backwards))
                # Whole stretches first, letter by letter where they part.
                while shared + 64 <= most and ends[shared: shared + 64] == backwards[shared: shared + 64]:
                    shared += 64
                while shared < most and ends[shared] == backwards[shared]:
                    shared += 1
                del nodes[shared + 1:]
                for letter in backwards[shared:]:
                    nodes.append(node_before(letter, nodes[-1]))
                ends = backwards
                made.append((backwards[::-1], *edits_along(nodes)))
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                ["signature", "cost", "audit"],
            )

    backwards = signatures.select(F.reverse("signature").alias("backwards")).distinct()
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(
        run, "signature string, cost long, audit string"
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after the damage that a CRC of conversation and turn names."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", ""))
        .otherwise(text("text")).alias("text"),
        F.when(kind == 3, 2).when(kind == 0, 0).otherwise(1).alias("times"),
        F.monotonically_increasing_id().alias("copy"),
    ).filter("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), "times")))


def _key(conv: Column) -> Column:
    """A conversation's id as a text that is never null."""
    return F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("+"), conv.cast("string")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``conv, turn, role, text``) in order, with number ``at``, ``key`` of the conversation
    and ``piece``, its stretch of at most ``PIECE`` rows."""
    rows = rows.withColumns({
        "key": _key(F.col("conv")),
        # Long texts stay out of the bounds of ranges.
        "mark": F.xxhash64("text"), "other": F.xxhash64(F.lit(7), "text"), "start": F.substring("text", 1, 64),
    })
    rows = in_order(
        rows, ["key", "turn", "role", "start", "mark", "other", "copy", "times"], "turns"
    ).drop("start", "copy", "times")
    return rows.withColumn("piece", F.shiftrightunsigned("at", PIECE.bit_length() - 1))


def letters(rows: DataFrame) -> DataFrame:
    """``key, piece, at, turn, initial, fault, letter`` of numbered rows."""
    first = rows.groupBy("key", "role", "mark", "other").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    slim = rows.select("key", "piece", "at", "turn", initial.alias("initial"), last.alias("last"))
    fault = (
        F.when(F.col("last") == "", "blank").when(F.col("new").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    )
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return slim.join(first, "at", "left").withColumn("fault", fault).withColumn(
        "letter", F.when(F.col("fault").isin("blank", "duplicate"), "d")
        .when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    ).drop("last", "new")


def _counts(slim: DataFrame) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated`` of each conversation."""
    by_turn = slim.groupBy("key", "turn").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    return by_turn.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )


def _illegal(initials: Column) -> Column:
    """Neighbours in a list of initials that are no legal pair."""
    pairs = F.zip_with(
        F.slice(initials, 1, F.greatest(F.size(initials) - 1, F.lit(0))),
        F.slice(initials, 2, F.greatest(F.size(initials) - 1, F.lit(0))),
        lambda a, b: F.concat(a, b),
    )
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def signatures(slim: DataFrame) -> DataFrame:
    """``key, signature, illegal, pieces`` (``piece, n`` in order) of each conversation."""
    each = F.sort_array(F.collect_list(F.struct("at", "letter", "initial")))
    pieces = slim.groupBy("key", "piece").agg(each.alias("rows")).select(
        "key", F.struct(
            "piece", F.size("rows").alias("n"), F.array_join("rows.letter", "").alias("letters"),
            F.element_at("rows.initial", 1).alias("first"), F.element_at("rows.initial", -1).alias("last"),
            _illegal(F.col("rows.initial")).alias("illegal"),
        ).alias("part"),
    )
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    # Two pieces meet in one pair more: the last initial before and the first one after.
    size = F.size("parts")
    between = F.zip_with(
        F.slice("parts", 1, size - 1), F.slice("parts", 2, size - 1),
        lambda a, b: (~F.concat(a["last"], b["first"]).isin("su", "ua", "au")).cast("long"),
    )
    total = F.aggregate(F.concat(between, F.col("parts.illegal")), F.lit(0).cast("long"), lambda x, n: x + n)
    return whole.select(
        "key", F.array_join("parts.letters", "").alias("signature"), total.alias("illegal"),
        F.transform("parts", lambda p: F.struct(p["piece"].alias("piece"), p["n"].alias("n"))).alias("pieces"),
    )


def _cut(audits: DataFrame) -> DataFrame:
    """``key, piece, place, parts, state, edits``: the edits that belong to each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "piece", "place", "parts", "state", "edits"]
        for batch in batches:
            made = []
            for row in batch.select(["key", "pieces", "signature", "audit"]).to_pylist():
                state, at, done = START, 0, 0
                last = len(row["pieces"]) - 1
                for place, part in enumerate(row["pieces"]):
                    begin, before, end = at, state, done + part["n"]
                    while at < len(row["audit"]) and (done < end or place == last):
                        edit = row["audit"][at]
                        if edit in "IR":
                            state = AFTER[WANTED[state], state]
                        elif edit == "K":
                            state = AFTER[row["signature"][done].lower(), state]
                        done, at = done + (edit != "I"), at + 1
                    made.append((row["key"], part["piece"], place, last + 1, before, row["audit"][begin:at]))
            columns = list(zip(*made)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return audits.mapInArrow(run, "key string, piece long, place long, parts long, state int, edits string")


def repaired_rows(roles: list[str], texts: list[str], state: int, edits: str) -> list[tuple[str, str]]:
    """Roles and texts that ``edits`` make of rows, from a state of the grammar on."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        new = WANTED[state]
        if edit == "I":
            out.append((ROLES[new], ""))
        else:
            out.append((roles[at] if edit == "K" else ROLES[new], texts[at]))
            new = roles[at][0] if edit == "K" else new
            at += 1
        state = AFTER[new, state]
    return out


def stretches(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``key, place, parts, n, stretch``: repaired rows of each piece, as lines; ``n`` rows are left."""

    names = ["key", "place", "parts", "n", "stretch"]

    def repaired(head: dict, roles: list[str], texts: list[str]) -> tuple:
        left = repaired_rows(roles, texts, head["state"], head["edits"])
        lines = "\n".join(f"{role}:{text}" for role, text in left).encode()
        return head["key"], head["place"], head["parts"], len(left), lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, roles, texts = None, [], []
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if head is None or (row["key"], row["piece"]) != (head["key"], head["piece"]):
                    if head is not None:
                        made.append(repaired(head, roles, texts))
                    head, roles, texts = row, [], []
                roles.append(row["role"])
                texts.append(row["text"])
            yield table(made)
        if head is not None:
            yield table([repaired(head, roles, texts)])

    def table(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*made)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    joined = rows.select("key", "piece", "at", "role", "text").join(cuts, ["key", "piece"])
    return joined.repartition("key", "piece").sortWithinPartitions("key", "piece", "at").drop("at").mapInArrow(
        run, "key string, place long, parts long, n long, stretch binary"
    )


def digests(parts: DataFrame) -> DataFrame:
    """``key, repaired_sha256``: stretches of a conversation are digested in order, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "repaired_sha256"]
        key = digest = None
        empty = True
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    if digest is not None:
                        made.append((key, digest.hexdigest()))
                    key, digest, empty = row["key"], hashlib.sha256(), True
                if row["n"]:
                    digest.update(row["stretch"] if empty else b"\n" + row["stretch"])
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names)

    single = parts.filter("parts = 1").select("key", F.sha2("stretch", 256).alias("repaired_sha256"))
    several = parts.filter("parts > 1").select("key", "place", "n", "stretch")
    return single.unionByName(several.repartition("key").sortWithinPartitions("key", "place").mapInArrow(
        run, "key string, repaired_sha256 string"
    ))


def repair(conversations: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What became of each conversation of ``conversations``, and the repaired stretches.

    ``rows`` are the rows to repair (``conv, turn, role, text, copy, times``). The first table has
    ``conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit``, the second is that of
    :func:`stretches`.
    """
    kept = numbered(rows)
    slim = stored(letters(kept), "turn-letters")
    signed = stored(signatures(slim), "signatures")
    audits = stored(signed.join(audited(signed), "signature"), "audits")
    spark = rows.sparkSession
    with small_batches(spark, ROWS):
        parts = stored(stretches(kept, _cut(audits)), "stretches")
    every = conversations.select(F.col("conv_id")).distinct().withColumn("key", _key(F.col("conv_id")))
    found = every.join(_counts(slim), "key", "left").join(
        audits.select("key", "illegal", "cost", "audit"), "key", "left"
    )
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", "key", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
    ), parts


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, faults, least cost, edits and the digest of the repaired text of every conversation."""
    found, parts = repair(conversations, damaged(conversations))
    with small_batches(conversations.sparkSession, STRETCHES):
        digest = stored(digests(parts), "repaired-digests")
    return found.join(digest, "key", "left").drop("key").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    )
