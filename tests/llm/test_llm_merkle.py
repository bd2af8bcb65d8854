"""The Merkle manifest against a tree built level by level."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from refsieve.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, witness int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    fields = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i: i + 2]) for i in range(0, len(last), 2)])
    return levels


def witness(levels, i):
    """Per level, the nodes of the run before and after the own one."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[i - i % 2: i - i % 2 + 2]
        out.append((run[: i % 2], run[i % 2 + 1:]))
        i //= 2
    return out


def brute_force(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        levels[name] = levels_of([leaf(r) for r in trees[name]])
    top = levels_of([levels[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            path = witness(levels[name], i) + witness(top, at)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            end = leaf(row, 1 if hit else 0)
            for before, after in path:
                end = h(*before, end, *after)
            proof = h(*[x for before, after in path for x in before + after])
            out.append((row[0], leaf(row), levels[name][-1][0], top[-1][0], proof, end, end == top[-1][0]))
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "é" * rng.randint(1, 9), "word " * rng.randint(1, 2000)])
        rows.append((rng.choice([i, i, i, None]), rng.choice(["s", None, ""]), rng.choice(["en", "en", "en", "fr", None, "", "é"]),
                     rng.choice([None, len(text or ""), 5]), text, "own", 1))
    return rows + rows[:9] + rows[:3] + [(7, "s", "lonely", 3, "one", "own", 2)]


@pytest.mark.parametrize("n, height", [(300, 2), (300, 5), (40, 12), (1, 3), (0, 3)])
def test_manifest_equals_a_tree_built_by_levels(spark, n, height):
    rows = random_rows(n + height, n)
    found = [tuple(r) for r in merkle.manifest_report(spark.createDataFrame(rows, SCHEMA), height).collect()]
    assert Counter(found) == Counter(brute_force(rows))
    assert n < 40 or {r[-1] for r in found} == {True, False}


def test_an_empty_table_has_no_manifest(spark):
    assert merkle.manifest_report(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_one_language_over_many_partitions(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("en").alias("lang"),
        F.lit(4).alias("n_chars"), F.lit("text").alias("text"),
    ).repartition(7)
    found = merkle.manifest_report(docs, 4).collect()
    rows = [(i, None, "en", 4, "text") for i in range(3000)]
    assert Counter(map(tuple, found)) == Counter(brute_force(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 77])
def test_witnesses_are_whole_after_every_append(n):
    """What is finished after any number of appends proves every leaf so far."""
    digests = [h(str(i)) for i in range(n)]
    frontier = merkle.Frontier()
    for digest in digests:
        frontier.append(digest)
    assert len(frontier.open) == bin(n).count("1")
    levels = levels_of(digests)
    root = frontier.finish()
    assert root == levels[-1][0]
    for i, digest in enumerate(digests):
        proof = bytes(frontier.witness[i])
        assert merkle.folded(digest, proof, bytes(frontier.sides[i])) == root
        assert proof.hex() == "".join(x for before, after in witness(levels, i) for x in before + after)
