import math
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from refsieve.operators import characters, copies, embeddings, hashed_vectors, prefix_join, tfidf
from workload import queries, views


def titles():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "of", "the", "ünder", "x"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)]
    made += ["alpha beta gamma", "alhpa beta gamma", "alpha beta gamam", "gamma beta alpha"] * 3
    made += ["!!", "!!", "a", "the the the", "ab" * 200, "ab" * 201]
    return [(f"d{i:03}", t) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(titles(), "DOI string, title string")


def groups():
    found = {}
    for doi, title in titles():
        found.setdefault(title, []).append(doi)
    return {min(dois): (title, len(dois)) for title, dois in found.items()}


def brute(score, threshold):
    """Expected ``(id1, id2) -> (score, n_pairs)`` over distinct titles, and copies."""
    known, wanted = groups(), {}
    for a, b in combinations(sorted(known), 2):
        value = score(known[a][0], known[b][0])
        if value >= threshold - 1e-12:
            wanted[a, b] = (round(value, 6), known[a][1] * known[b][1])
    return wanted


def collected(pairs):
    rows = pairs.collect()
    near = {
        (r["id1"], r["id2"]): (round(r["score"], 6), r["n_pairs"]) for r in rows if r["id1"] != r["id2"]
    }
    assert len(near) == sum(r["id1"] != r["id2"] for r in rows)
    return near, {r["id1"]: r["n_pairs"] for r in rows if r["id1"] == r["id2"]}


def copied(worded=lambda title: True):
    return {i: n * (n - 1) // 2 for i, (t, n) in groups().items() if n > 1 and worded(t)}


def multiset_jaccard(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def edit_distance(a, b, swaps):
    """By a full table; a swap may have edits between its two characters."""
    table = {(-1, j): j + 1 for j in range(-1, len(b))} | {(i, -1): i + 1 for i in range(len(a))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y))
            if swaps:
                k, m = a.rfind(y, 0, i), b.rfind(x, 0, j)
                if k >= 0 and m >= 0:
                    best = min(best, table[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            table[i, j] = best
    return table[len(a) - 1, len(b) - 1]


def cosine_function():
    all_titles = [t for _, t in titles()]
    bags = {t: Counter(re.findall(r"\w{2,}", t.lower())) for t in all_titles}
    frequency = Counter(term for t in all_titles for term in bags[t])
    idf = {k: math.log((1 + len(all_titles)) / (1 + n)) + 1 for k, n in frequency.items()}

    def cosine(a, b):
        x, y = ({k: n * idf[k] for k, n in bags[t].items()} for t in (a, b))
        length = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(k, 0) for k, v in x.items()) / length if length else 0.0

    return cosine


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.99])
def test_tfidf_pairs_equal_brute_force(frame, threshold):
    near, same = collected(tfidf.tfidf_pairs(frame, threshold))
    assert near == brute(cosine_function(), threshold)
    assert same == copied(lambda t: re.search(r"\w\w", t))


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_jaccard_pairs_equal_brute_force(frame, threshold):
    near, same = collected(characters.jaccard_pairs(frame, threshold))
    assert near == brute(multiset_jaccard, threshold)
    assert same == copied()


@pytest.mark.parametrize("swaps", [True, False])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_edit_pairs_equal_brute_force(frame, threshold, swaps):
    def score(a, b):
        if abs(len(a) - len(b)) > (1 - threshold) * max(len(a), len(b)) + 1:
            return 0.0
        return 1 - edit_distance(a, b, swaps) / max(len(a), len(b))

    near, same = collected(characters.edit_pairs(frame, threshold, transpositions=swaps))
    assert near == brute(score, threshold)
    assert same == copied()


def test_hot_tokens_are_split_without_losing_pairs(frame, monkeypatch):
    whole = collected(tfidf.tfidf_pairs(frame, 0.5))
    monkeypatch.setattr(prefix_join, "ROWS_PER_BLOCK", 2)
    assert collected(tfidf.tfidf_pairs(frame, 0.5)) == whole


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_tfidf_candidates_never_leave_their_cells(frame, monkeypatch, threshold):
    """Candidates were shuffled to make them distinct, and again with both vectors."""
    monkeypatch.setattr(prefix_join, "ROWS_PER_BLOCK", 3)
    monkeypatch.setattr(tfidf, "TERMS_PER_BUCKET", 20)
    pairs = tfidf.tfidf_pairs(frame, threshold)
    assert "keys=[id1" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert collected(pairs)[0] == brute(cosine_function(), threshold)


def test_pair_counts_add_up_to_all_work_pairs(frame):
    cosine = cosine_function()
    total = sum(
        cosine(a, b) >= 0.8 - 1e-12 for (_, a), (_, b) in combinations(titles(), 2)
    )
    assert tfidf.tfidf_pairs(frame, 0.8).agg(F.sum("n_pairs")).collect()[0][0] == total


def test_members_list_every_work_once(frame):
    rows = copies.members(frame, "title").collect()
    assert sorted(r["member"] for r in rows) == [d for d, _ in titles()]
    known = groups()
    assert {r["id"] for r in rows} == set(known)


def test_bands_and_best_pair(frame):
    pairs = tfidf.tfidf_pairs(frame, 0.5)
    scores = [r["score"] for r in tfidf.score_band(pairs).collect()]
    assert scores and all(s >= 0.94 - 1e-9 for s in scores)
    best = tfidf.top_pair(pairs).collect()
    assert len(best) == 1 and round(best[0]["score"], 6) == 1.0


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    near = centres[rng.integers(0, 6, 150)] + 0.3 * rng.normal(size=(150, 8))
    return np.round(np.vstack([near, np.repeat(near[:1], 70, axis=0), np.zeros((2, 8))]), 3)


@pytest.mark.parametrize("threshold", [-0.2, 0.4, 0.8])
@pytest.mark.parametrize("block_rows", [16, 4096])
def test_embedding_pairs_equal_brute_force(spark, threshold, block_rows):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pairs = embeddings.embedding_pairs(frame, threshold, pivots=9, block_rows=block_rows).collect()
    kept = vectors().astype(np.float32).astype(float)[:-2]
    unit = kept / np.linalg.norm(kept, axis=1, keepdims=True)
    above = np.triu(unit @ unit.T >= threshold - 1e-12, 1).sum()
    assert sum(r["n_pairs"] for r in pairs) == above
    assert len({(r["id1"], r["id2"]) for r in pairs}) == len(pairs)
    assert all(r["id1"] <= r["id2"] for r in pairs)
    for r in pairs[:50]:
        if r["id1"] != r["id2"]:
            assert r["score"] == pytest.approx(float(unit[r["id1"]] @ unit[r["id2"]]), abs=6e-4)


def test_hashed_candidates_find_nearly_all_pairs_and_no_others(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 24))
    made = np.repeat(centres, 4, 0) + 0.35 * rng.standard_normal((600, 24))
    made[10] = made[11]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(900, [0.0] * 24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    exact = embeddings.embedding_pairs(frame, 0.8)
    whole = {(r["id1"], r["id2"]): r for r in exact.collect()}
    found = {(r["id1"], r["id2"]): r for r in hashed_vectors.hashed_embedding_pairs(frame, 0.8).collect()}
    assert all(whole[key] == row for key, row in found.items())
    assert len(whole) > 400 and len(found) >= 0.9 * len(whole)
    assert found[10, 10]["n_pairs"] == 1 and all(unit[a] @ unit[b] >= 0.8 for a, b in found)


def test_share_of_pairs_that_meet_follows_the_angle():
    # Without guests two vectors meet where no plane parts them.
    for cosine in (0.5, 0.9):
        side = 1 - math.acos(cosine) / math.pi
        assert hashed_vectors.meeting_share(6, cosine, 0) == pytest.approx(side**6, abs=0.015)
    assert hashed_vectors.meeting_share(6, 0.8, 3) > hashed_vectors.meeting_share(6, 0.8, 0)
    assert hashed_vectors.tables_for(10, 0.8, 0.97) > hashed_vectors.tables_for(10, 0.8, 0.8)
    assert hashed_vectors.bits_for(0) == 4 and hashed_vectors.bits_for(10**12) == 24


def test_no_vectors_no_pairs(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert embeddings.embedding_pairs(frame).count() == 0
    assert hashed_vectors.hashed_embedding_pairs(frame).count() == 0


def test_no_cell_holds_more_than_two_blocks(spark):
    entry = F.array(F.struct(F.lit(500).alias("freq"), F.lit("the").alias("token")))
    records = spark.range(500).select(F.format_string("d%03d", "id").alias("id"), entry.alias("prefix"))
    cells = prefix_join.prefix_cells(records, [], rows_per_block=50).groupBy("token", "low", "high")
    sizes = [r[0] for r in cells.agg(F.count("*")).select(F.col("count(1)")).collect()]
    assert len(sizes) == 11 * 12 // 2 and max(sizes) <= 2 * 50 * 2
    pairs = prefix_join.candidate_pairs(records, [], lambda a, b: F.lit(True), rows_per_block=50)
    assert pairs.count() == 500 * 499 // 2


def test_similar_title_report_counts_every_pair_of_works(spark, frame):
    from refsieve.plans import titles as plan

    articles = frame.select(
        "DOI", "title", F.lit("A").alias("author"), F.col("title").substr(1, 1).alias("container_title"),
        F.lit("p").alias("print_issn"), F.lit("e").alias("electronic_issn"), F.lit("m").alias("member"),
    )
    pairs = tfidf.tfidf_pairs(frame)
    report = plan.similar_title_report(articles, pairs, frame).collect()
    known = groups()
    works = {doi: (title, min(d for d, t in titles() if t == title)) for doi, title in titles()}
    listed = Counter()
    for row in pairs.collect():
        for doi, (title, group) in works.items():
            if group == row["id1"]:
                listed[doi] += sum(1 for other, (_, g) in works.items() if g == row["id2"] and other != doi)
    counts = {r["DOI"]: r["DOI_counts"] for r in report}
    assert counts == {doi: n for doi, n in listed.items() if n}
    assert sum(r["n_partners"] for r in report) == sum(listed.values())
    container = Counter()
    for doi, n in listed.items():
        container[works[doi][0][:1]] += n
    assert {r["container_title"]: r["container_title_counts"] for r in report} == {k: n for k, n in container.items() if n}
    assert len(report) <= len(works) * max(len(known), 1)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_vectors_do_not_depend_on_batches(spark, frame, monkeypatch, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(prefix_join, "ROWS_PER_BLOCK", 5)
    try:
        near, _ = collected(tfidf.tfidf_scores(frame, 0.5))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert near == brute(cosine_function(), 0.5)


def test_vectors_travel_as_numbers_and_pairs_without_titles(spark, frame):
    """Vectors were shuffled with their words, and both titles were joined to every pair, though never read."""
    pairs = tfidf.tfidf_scores(frame, 0.8)
    assert pairs.columns == ["id1", "id2", "copies1", "copies2", "score", "n_pairs"]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan
    groups = copies.collapse(frame, "title")
    terms = tfidf._numbered_terms(groups)
    cells = tfidf._in_cells(tfidf._weighted_terms(groups, terms), terms, 0.8)
    assert not [f.name for f in cells.schema if "string" in f.dataType.simpleString() and f.name != "id"]


def test_title_is_the_first_sentence_with_a_term(spark, tmp_path):
    texts = ["One two. Three", "..\n a. b\n  cd e . fg", "a b. c", "", None, "x" * 9 + "\n", ". é ü. Ünder 😀 é", "a " * 20_000 + "zz."]
    rows = [(i * 19 * 17 * 12 + 1, t, "en", "src1", 1) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    whole, light = (
        views.works(spark, str(tmp_path), references=flag).select("DOI", "title", "author", "issn-type").orderBy("DOI").collect()
        for flag in (True, False)
    )
    assert whole == light and sum(r["title"] is not None and r["title"][0] is not None for r in whole) == 5
    plan = queries._articles(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
