"""Near copies by similarity against brute force."""

import itertools
import random

import pytest

from foundling.llm import near


def similarity(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y)


def test_near_copies_meet_and_others_do_not(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts, family = [], []
    for f in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(8):
            own = list(base)
            own[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(own))
            family.append(f)
    assert all(similarity(a, b) > 0.8 for a, b in zip(texts, texts[1:]) if family[texts.index(a)] == family[texts.index(b)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.root for r in near.classes(docs).select("row.doc_id", "root").collect()}
    for i, f in enumerate(family):
        for j, g in enumerate(family):
            assert (got[i] == got[j]) == (f == g)


def by_all_pairs(texts):
    """The components of all pairs with a segment of one differing bit at most and close enough fingerprints."""
    marks = [[int(v) & (1 << 64) - 1 for v in near.fingerprint(t.encode())] for t in texts]

    def segments(m):
        return [m[s // 2] >> near.WIDTH * (s % 2) & (1 << near.WIDTH) - 1 for s in range(near.SEGMENTS)]

    own = [segments(m) for m in marks]
    indexed = len(marks[0]) - near.LONGS
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if any((x ^ y).bit_count() <= 1 for x, y in zip(own[i], own[j])):
            if sum((x ^ y).bit_count() for x, y in zip(marks[i][indexed:], marks[j][indexed:])) <= near.APART:
                root[top(j)] = top(i)
    sets = {}
    for i in range(len(texts)):
        sets.setdefault(top(i), set()).add(i)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("steps", [[1, 4, 9], [9, 14, 20], [12, 30]])
def test_crowded_cells_give_the_components_of_all_pairs(spark, steps):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts, base = [], [rng.choice(words) for _ in range(120)]
    for _ in range(120):
        base = list(base)
        for _ in range(rng.choice(steps)):
            base[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in near.classes(docs).select("row.doc_id", "root").collect():
        out.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, out.values())) == by_all_pairs(texts)


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (4, "one TWO"), (None, "x"), (7, "a b c d e f"), (8, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS root")
    got = near.classes(docs).select("row.doc_id", "row.node", "root").collect()
    assert len(got) == len(rows)
    roots = {}
    for r in got:
        roots.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(lambda x: sorted(x, key=str), roots.values()), key=str) == sorted([[1, 2, 3], [4, 4], [None], [7], [8]], key=str)
    assert near.classes(docs.limit(0)).count() == 0
