"""Two-stage suffix sorting and the removal of repeated bytes, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from refsieve.llm import suffixes

SCHEMA = "doc_id long, text string, anchor string, grp long, path int"


def random_bytes(rng, n):
    kind = rng.randrange(4)
    if kind == 0:
        return bytes(rng.choices(b"ab", k=n))
    if kind == 1:
        return bytes(rng.randrange(256) for _ in range(n))
    if kind == 2:
        return (bytes(rng.choices(b"abc", k=rng.randint(1, 9))) * n)[:n]
    return b"".join(rng.choice([b"aaaa", b"\x00", b"\x00\x00", b"\xff\xff", b"abcab", b"zz"]) for _ in range(n))[:n]


@pytest.mark.parametrize("seed", range(300))
def test_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    raw = random_bytes(rng, rng.choice([0, 1, 2, 30, 200, 700]))
    data = np.frombuffer(raw, np.uint8)
    depth = rng.choice([50, 12, 8, 3])
    wanted = np.array([rng.random() < rng.choice([1, 0.5]) for _ in raw], bool)
    order = suffixes.suffix_order(data, wanted, depth)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    cut = [raw[i: i + depth] for i in order]
    # Behind the end of all there are zeros, which no window of a text reaches.
    ends = [c + b"\x00" * (depth - len(c)) for c in cut]
    assert ends == sorted(ends)
    shared = suffixes.common_prefixes(data, order, depth)
    for a, b, found in zip(ends, ends[1:], shared.tolist()):
        assert found == next((k for k in range(depth) if a[k] != b[k]), depth)


@pytest.mark.parametrize("raw", [b"", b"a", b"aa", b"ab", b"ba", b"mississippi", b"aabbaabb"])
def test_rising_suffixes(raw):
    found = suffixes.rising(np.frombuffer(raw, np.uint8)).tolist()
    assert found == [raw[i:] < raw[i + 1:] for i in range(len(raw))]


def brute_force(rows, window):
    texts = [((i if i is None else int(i)), (t or "").encode()) for i, t in rows]
    least = {}
    for doc_id, raw in texts:
        if doc_id is not None:
            for i in range(len(raw) - window + 1):
                cut = raw[i: i + window]
                least[cut] = min(least.get(cut, doc_id), doc_id)
    out = []
    for doc_id, raw in texts:
        gone = bytearray(len(raw))
        if doc_id is not None:
            for i in range(len(raw) - window + 1):
                if least[raw[i: i + window]] < doc_id:
                    gone[i: i + window] = b"\x01" * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def random_rows(seed, n):
    """Texts that share passages, with near copies, runs of one letter, repeated and missing ids."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdé ", k=rng.randint(30, 200))) for _ in range(8)] + ["z" * 120, "xy" * 90]
    rows = [(1, None), (2, ""), (None, pool[0]), (None, pool[0])]
    for i in range(3, n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            cut = rng.randrange(len(p))
            text += rng.choice([p, p[cut:], p[:cut], "".join(rng.choices("abcdefgh", k=rng.randint(1, 70)))])
        rows.append((rng.choice([i, i, n - i, 7]), text))
    return [(i, t, "own", 1, 2) for i, t in rows + rows[10:20]]


@pytest.mark.parametrize("window, gram, most, group", [(50, 16, 4096, 1 << 20), (50, 16, 3, 1000), (33, 8, 5, 200), (20, 16, 4096, 60)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, window, gram, most, group):
    from refsieve.llm import bytespans

    monkeypatch.setattr(bytespans, "MOST_PATHS", most)
    monkeypatch.setattr(bytespans, "GROUP_BYTES", group)
    monkeypatch.setattr(bytespans, "BUCKET_BYTES", 2000)
    rows = random_rows(window + most, 150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in bytespans.without_repeats(docs, window, gram, digest=True).collect()]
    assert Counter(found) == Counter(brute_force([r[:2] for r in rows], window))


def test_pieces_of_a_long_text_have_all_its_windows(monkeypatch):
    from refsieve.llm import bytespans

    rng = random.Random(9)
    sizes = [0, 49, 50, 7_000, 3, 1_000, 300, 349]
    data = np.array(rng.choices(b"abcdefg", k=sum(sizes)), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)])
    whole = bytespans.found_paths(data, base, 50, 16)
    monkeypatch.setattr(bytespans, "GROUP_BYTES", 300)
    cut = bytespans.found_paths(data, base, 50, 16)
    assert len(cut.first) > len(whole.first)

    def windows(found):
        return sorted((t, f + i, a) for t, f, n, a, *_ in zip(*(x.tolist() for x in found)) for i in range(n))

    assert windows(whole) == windows(cut)
    assert [w[:2] for w in windows(whole)] == [(t, i) for t, n in enumerate(sizes) for i in range(n - 49)]


def test_a_long_text_among_others(spark, monkeypatch):
    from refsieve.llm import bytespans

    monkeypatch.setattr(bytespans, "GROUP_BYTES", 300)
    rng = random.Random(8)
    long_ = "".join(rng.choices("abcdefgh ", k=9_000))
    rows = [(2, long_), (1, long_[137:4400]), (3, long_[2990:3080]), (4, "x" * 5_000), (5, "x" * 3_000)]
    docs = spark.createDataFrame([(i, t, "own", 1, 2) for i, t in rows], SCHEMA)
    found = [tuple(r) for r in bytespans.without_repeats(docs, digest=True).collect()]
    assert Counter(found) == Counter(brute_force(rows, 50))


def test_kept_bytes_and_no_rows(spark):
    from refsieve.llm import bytespans

    text = "a line that is more than fifty bytes long, twice over: é"
    docs = spark.createDataFrame([(1, text, "", 1, 2), (2, "x" + text + "y", "", 1, 2)], SCHEMA)
    assert {r.doc_id: r.kept for r in bytespans.without_repeats(docs).collect()} == {1: text.encode(), 2: b"xy"}
    assert bytespans.without_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bytespans.without_repeats(docs, 50, 12)
