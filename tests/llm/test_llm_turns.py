"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from refsieve.llm import turns

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, key string, at int, cost int, piece int"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def text_of(x):
    return " " if x is None else str(x)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows):
    """Least ``(cost, audit, repaired rows)``, by recursion over rows and the last role."""

    @cache
    def best(at, last, room):
        options = []
        if at == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if room:
            for new in ("user", "assistant"):
                if (last, new[0]) in STEP:
                    cost, audit, rest = best(at, new[0], room - 1)
                    options.append((cost + 2, "I" + audit, ((new, ""),) + rest))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, rest = best(at + 1, last, 3)
            options.append((cost + 3, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for new, price, edit in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if (last, new[:1]) in STEP:
                        cost, audit, rest = best(at + 1, new[:1], 3)
                        options.append((cost + price + more, edit + audit, ((new, text),) + rest))
        return min(options, default=(10 ** 6, "", ()))

    return best(0, "", 3)


def brute_force(rows):
    after = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        kept, seen, signed = after.get(conv, []), set(), []
        for _, role, text in kept:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            signed.append((role, text, fault))
        own = [t for t, _, _ in kept if t is not None]
        faults = Counter(f for _, _, f in signed)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(signed, signed[1:])]
        cost, audit, left = cheapest(tuple(signed)) if signed else (0, "", ())
        lines = "\n".join(f"{r}:{t}" for r, t in left)
        out.append((conv, max(own) - min(own) + 1 - len(set(own)) if own else 0, faults["blank"], faults["duplicate"],
                    faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256(lines.encode()).hexdigest()))
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        role = "u"
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "assist"])
            text = rng.choice(["Yes.", "No!", "a b", "", None, " \n", "ends ? \t", f"own {turn}.", f"own {turn}.", f"é {turn}?"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text, "k", 1, 2, 3))
    return rows + rows[:20] + [rows[3]] * 30


@pytest.mark.parametrize("piece, n", [(1024, 250), (2, 80)])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, piece, n):
    monkeypatch.setattr(turns, "PIECE", piece)
    rows = random_rows(n, n)
    found = [tuple(r) for r in turns.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert Counter(found) == Counter(brute_force(rows))


def test_an_empty_table_has_no_conversations(spark):
    assert turns.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_long_conversation(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"turn {i}{rng.choice('.x')}", "k", 1, 2, 3) for i in range(400)]
    rows += [(2, 0, "user", "word " * 100_000 + ".", "k", 1, 2, 3), (2, 1, "assistant", "Yes.", "k", 1, 2, 3)]
    found = [tuple(r) for r in turns.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(found) == Counter(brute_force(rows))


def test_nodes_depend_on_what_follows_alone():
    rng = random.Random(5)
    for _ in range(2000):
        letters = "".join(rng.choices("suaxSUAXd", k=rng.randint(0, 9)))
        nodes = [turns.END]
        for letter in reversed(letters):
            nodes.append(turns.node_before(letter, nodes[-1]))
        faults = {"d": "blank"}
        rows = tuple((x.lower(), "t", faults.get(x, "truncated" if x.isupper() else "")) for x in letters)
        assert turns.edits_along(nodes) == cheapest(rows)[:2]
