"""The conversation trie against plain Python, with shards of a few nodes so that spines are merged again and again."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tabweave.llm.balanced_parens import Minima, Parentheses
from tabweave.llm.conversation_trie import prefix_trie, turn_sequences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """rows of (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    sequences = {c: tuple(x for _, x in sorted(t)) for c, t in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        own = (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += own
    ids = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(str((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], ids(k))) for k in list(members))


def made(seed, n, turns=6, choice=3):
    rng = random.Random(seed)
    say = lambda: rng.choice(["one two", "", None, "three  four five\n", "é x\x1fy"][:choice])
    rows = [(c * 7 - 30, rng.choice([None, 5, 5, t]), rng.choice(["user", None, "assistant"]), say()) for c in range(n) for t in range(rng.randint(1, turns))]
    return rows + rows[:3]


LONG = [(1, t, "user", f"w {t}") for t in range(700)] + [(c, t, "user", f"w {t}" if t < 400 + c else "other end") for c in (2, 3, 4) for t in range(500)]
CASES = {
    "mixed": made(1, 150),
    "no two alike": made(2, 60, 4, 5) + [(1000 + c, 0, "user", f"text {c}") for c in range(60)],
    "copies": made(3, 20) + [(2000 + c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(4000 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)],
    "long": LONG + made(4, 10),
    "one": [(5, None, None, None)],
    "without an id": [(None, 1, "user", "x"), (-1, 1, "user", "x" * 100_000)],
}
SCHEMA = "conv_id long, turn long, role string, text string, digest int, words int, turns int, depth int, `key` int, `shard` int"


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize(("nodes", "fan_in"), [(4, 2), (40, 3), (1 << 18, 64)])
def test_equals_plain(spark, name, nodes, fan_in):
    df = spark.createDataFrame([(*r, *[1] * 6) for r in CASES[name]], SCHEMA)
    assert sorted(str(tuple(r)) for r in prefix_trie(turn_sequences(df), nodes, fan_in).collect()) == plain(CASES[name])


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(turn_sequences(df)).collect() == []


def test_conversations_without_turns_are_members_of_the_root(spark):
    df = spark.createDataFrame([(3, []), (1, []), (2, [("a" * 32, 2)])], "conv_id long, turns array<struct<digest: string, words: long>>")
    found = sorted(tuple(r)[:7] for r in prefix_trie(df).collect())
    assert found == [(1, 0, None, 3, 1, 1, 0), (2, 1, 1, 1, 0, 1, 0)]


def test_parentheses_of_random_trees():
    rng = random.Random(7)
    for n in (1, 2, 63, 64, 65, 5000):
        for deep in (1, 3, 1000):
            depths = [0]
            while len(depths) < n:
                depths.append(rng.randint(max(1, depths[-1] + 1 - deep), depths[-1] + 1))
            beyond = [next((j for j in range(i + 1, n) if depths[j] <= depths[i]), n) for i in range(n)]
            tree = Parentheses(np.array(depths))
            closes = tree.find_close()
            assert (np.arange(n) + (closes - tree.opens + 1) // 2).tolist() == beyond
            leaf = [i + 1 == n or depths[i + 1] <= depths[i] for i in range(n)]
            assert tree.leaves_within(closes).tolist() == [sum(leaf[i : beyond[i]]) for i in range(n)]


def test_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 333)
    begin = rng.integers(0, 332, 500)
    end = np.minimum(begin + rng.integers(1, 100, 500), 333)
    assert Minima(values, 5000).least(begin, end).tolist() == [values[a:b].min() for a, b in zip(begin, end, strict=True)]
