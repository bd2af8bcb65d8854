"""Operators that compare or mix documents, against brute force; the pipeline; the SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import check_oracle
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from refsieve.llm import mixing, queries, secrets, simhash, substrings, topk
from refsieve.llm.components import components
from refsieve.session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_docs(spark, rows):
    return stored(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA), "given")


def random_docs(spark, seed, n=120):
    """Documents that share passages, with copies, repeated and missing ids, null and empty texts."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(20, 90))] for _ in range(10)]
    rows = [(1, None, "s"), (2, "", None), (3, " ".join(["a"] * 100), "t"), (None, "no id at all", "s")]
    for i in range(4, n):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            cut = rng.randrange(len(p))
            words += rng.choice([p, p[cut:], p[:cut], rng.choices("abcdefghij", k=rng.randint(1, 40)), ["x"] * rng.randint(1, 50)])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), rng.choice(["s", "t", "u", None])))
    rows += [rows[10], rows[10], (None, rows[20][1], "u")]
    return rows, kept_docs(spark, rows)


# --- repeated spans -----------------------------------------------------------------------------


def without_repeats(rows, window):
    texts = [WORD.findall(t or "") for _, t, _ in rows]
    runs = Counter(tuple(w[i: i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if runs[tuple(words[i: i + window])] > 1:
                gone.update(range(i, i + window))
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, gram", [(35, 8), (12, 4)])
def test_repeated_spans_equal_brute_force(spark, window, gram):
    rows, docs = random_docs(spark, window)
    got = substrings.without_repeats(docs, window, gram, digest=True).collect()
    assert sorted(map(tuple, got), key=str) == without_repeats(rows, window)
    kept = substrings.without_repeats(docs, window, gram)
    assert kept.columns == ["doc_id", "n_words", "n_removed", "kept"] and kept.count() == len(rows)


def test_equal_hashes_of_unequal_paths_are_not_trusted(spark):
    rows = [(1, 7, 1, 0, 3, 5), (2, 7, 2, 0, 3, 5), (3, 8, 1, 0, 3, 6), (4, 8, 1, 0, 3, 6)]
    found = spark.createDataFrame(rows, "row long, path long, proof long, first int, count int, anchor long")
    kinds = {r.path: (r.whole, r.branching) for r in substrings.path_kinds(found).collect()}
    assert kinds == {7: (False, True), 8: (True, False)}


def test_no_documents_have_no_repeats(spark):
    docs = kept_docs(spark, [])
    assert substrings.without_repeats(docs).count() == 0 and simhash.near_report(docs).count() == 0
    assert mixing.Mix(docs).report().count() == 0


# --- near-copies --------------------------------------------------------------------------------


def fingerprint(text, width=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i: i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius=2):
    """Number of the group of each value, by comparing all."""
    values, group = np.array(values, np.uint64), list(range(len(values)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_groups_equal_brute_force(spark):
    rows, docs = random_docs(spark, 4)
    words = rows[30][1].split()
    rows += [(500 + k, " ".join(words * 8 + ["q"] * k), "s") for k in range(6)]
    docs = kept_docs(spark, rows)
    prints = [fingerprint(t) for _, t, _ in rows]
    least = defaultdict(lambda: None)
    groups = linked(prints)
    for (doc_id, _, _), g in zip(rows, groups):
        if doc_id is not None and (least[g] is None or doc_id < least[g]):
            least[g] = doc_id
    expected = [(i, f"{p:016x}", least[g]) for (i, _, _), p, g in zip(rows, prints, groups)]
    assert sorted(map(tuple, simhash.near_report(docs).collect()), key=str) == sorted(expected, key=str)
    kept = simhash.one_per_group(docs, width=3)
    assert kept.columns == docs.columns and kept.count() == len(set(groups))


@pytest.mark.parametrize("bucket_rows", [32, 4096])
def test_large_buckets_lose_no_link(spark, bucket_rows):
    rng = random.Random(3)
    values = {rng.getrandbits(64)}
    while len(values) < 1200:
        x = rng.choice(sorted(values)[-40:])
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(22, 64)
        values.add(x)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.fingerprint_links(frame, 2, bucket_rows)
    roots = {r.node: r.root for r in components(links).collect()}
    mine = [roots.get(v, v) for v in signed]
    groups = linked(values)
    assert len(set(zip(mine, groups))) == len(set(mine)) == len(set(groups))


def test_index_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    values = np.unique(np.concatenate([values, values[:300] ^ np.uint64(5), values[:100] ^ np.uint64(1 << 60)]))
    index = simhash.GrayIndex(values)
    found = {(int(a), int(b)) for x, y in index.pairs(2) for a, b in zip(x, y)}
    v = index.values
    every = {
        (i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= 2) + i + 1
    }
    assert found == every
    leaves = len(index.levels[0].mask)
    assert len(index.near_leaves(2)[0]) < 0.5 * leaves * (leaves + 1) / 2


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 60)] + [(1000, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {j: 7 for j in range(8, 60)}


# --- top k --------------------------------------------------------------------------------------


def best_of_all(rows, k):
    def whole(x):
        if not x or any(v is None or not np.isfinite(v) for v in x):
            return None
        return [int(np.floor(256 * v)) for v in x]

    valid = [(i, whole(x)) for i, x in rows if whole(x)]
    out = []
    for q, (query_id, x) in enumerate(valid):
        if query_id is None or query_id % 50:
            continue
        scores = sorted(
            ((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for c, (i, y) in enumerate(valid) if c != q)
        )[:k]
        out += [(query_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scores, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [1024, 16])
def test_top_k_equals_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(0, 0.3, 12), 2).tolist()) for i in range(1, 160)]
    rows += [(50, rows[49][1]), (50, rows[60][1]), (100, None), (150, [0.1, None]), (200, [float("nan")] * 12)]
    rows += [(250, []), (None, rows[10][1]), (300, rows[10][1]), (300, rows[10][1]), (350, [1.0, 2.0]), (7, rows[6][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    found = topk.top_k(frame, lambda v: v % 50 == 0, candidates_per_cell=cell, queries_per_cell=4)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()), key=str) == best_of_all(rows, 5)
    few = topk.top_k(frame.limit(0), lambda v: v % 50 == 0)
    assert few.count() == 0


def test_scores_beyond_doubles_are_exact():
    big = 2**40
    columns = np.array([[big, big + 1, 3], [1, 1, big]], np.int64)
    found = list(topk.search(np.array([[big, 1]], np.int64), np.array([-1]), columns, np.arange(3), np.ones(3, np.int64), 2, 1))
    assert [int(s) for s in found[0][2]] == [big * (big + 1) + 1, big * big + 1]


# --- mixing -------------------------------------------------------------------------------------


def test_seats_go_to_the_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        votes = [rng.randint(0, 50) for _ in range(rng.randint(1, 8))]
        if not sum(votes):
            continue
        seats, most = rng.randint(0, 40), [rng.randint(0, 30) for _ in votes]
        got, plain = mixing.sainte_lague(votes, seats, most), [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i, v in enumerate(votes) if v and plain[i] < most[i]]
            if not open_:
                break
            best = max(open_, key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
            plain[best] += 1
        assert sum(got) == sum(plain)
        assert sorted(v / (2 * g + 1) for v, g in zip(votes, got)) == sorted(v / (2 * g + 1) for v, g in zip(votes, plain))


def test_targets_reshare_what_is_above_the_cap():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1], 1.5, 2.0) == [0, 15]


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    names = ["b", "a", None, "é", "c"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(names)) for i in range(600)] + [(None, None, "a"), (5, "x y", "b"), (5, "x y", "b")]
    docs = kept_docs(spark, rows)
    found = mixing.Mix(docs).report().toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all()
    by = found.groupby(["target", "source_size"])[["taken", "size"]].sum().reset_index()
    assert len(by) == 5 and (by["size"] == by["source_size"]).all()
    assert (abs(by["taken"] / by["target"] - 1) < 0.02).all()
    again = mixing.Mix(docs.repartition(5)).report().toPandas()
    order = ["doc_id", "size", "source_size", "taken"]
    first, second = (x.fillna(-1).sort_values(order)[order].values.tolist() for x in (found, again))
    assert first == second


def test_mixed_texts_hold_the_taken_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.randint(0, 300))), f"s{i % 3}") for i in range(60)]
    docs = kept_docs(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.Mix(docs).report().collect()}
    words = defaultdict(list)
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] += r.text.split()
    for doc_id, text, _ in rows:
        held = Counter(words[doc_id])
        assert sum(held.values()) == taken[doc_id] and max(held.values(), default=0) <= 2
        assert set(held) <= set(text.split())


# --- the pipeline and the registry --------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        seen[name] = docs
    first, second, third, fourth, last = seen.values()
    assert all(x.columns == given.columns for x in (first, second, third, fourth))
    prints = [fingerprint(r.text, 3) for r in first.collect()]
    assert second.count() == len(set(linked(prints))) < first.count() < given.count()
    assert third.count() == second.count()
    assert secrets.secret_report(third).filter("n_access + n_hex > 0").count() == 0
    assert last.count() == fourth.count() and last.filter("NOT exact").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_pipeline_takes_odd_rows(spark, sf_dir):
    rows, docs = random_docs(spark, 9)
    names = ("row", "_row", "__row", "__ranges", "__pass", "pass", "ranges", "secrets", "size", "taken", "fp", "tokens", "label", "kept", "first", "x")
    docs = docs.withColumns({name: F.lit("own") for name in names}).withColumn("score", F.lit(None).cast("double"))
    for frame in (stored(docs, "odd"), stored(docs.limit(0), "none")):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, frame = frame, stored(stage(spark, frame, sf_dir), "odd-stage")
            assert i == 4 or frame.columns == before.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    check_oracle.KINDS.update(INTEGER="int", BOOLEAN="boolean")
    status, detail = check_oracle.compare(
        spark, check_oracle.connect(sf_dir), name, queries.QUERIES[name], queries.ORACLE[name], sf_dir
    )
    assert status == "ok", detail


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_returns_a_row_per_document(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
