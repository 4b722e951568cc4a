import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foundling.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(marks):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in marks:
        for b in marks:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                root[find(b)] = find(a)
    return {m: find(m) for m in marks}


TEXTS = [None, "", "  \t\n", "one", "One", "two words", "é È A", "a b c d", "a b c d", "A\x0bB\x0cC d", "w x y z", "x " * 5000,
         " ".join(str(i % 7) for i in range(3000))]


def test_fingerprints_follow_the_rule():
    for t in TEXTS:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)
    long = " ".join(str(i) for i in range(1000))
    assert simhash.fingerprint(long.encode(), block=7) == slow_fingerprint(long)


@pytest.mark.parametrize("crowd", [1, 3, 16])
def test_links_keep_every_component(spark, crowd):
    rng = random.Random(7)
    marks = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            marks.add(centre)
    centre = rng.getrandbits(64)
    marks |= {centre ^ (1 << b) for b in range(64)} | {0, 1, 2**63, 2**63 + 1}
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    links = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), crowd).collect()
    for a, b in links:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    from foundling.llm.components import stars

    found = {r.node: r.root for r in stars(spark.createDataFrame([(a, b) for a, b in links], "a long, b long")).collect()}
    want = slow_roots(signed)
    groups, mine = {}, {}
    for m in signed:
        groups.setdefault(want[m], set()).add(m)
        mine.setdefault(found.get(m, m), set()).add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_documents(rows_of_text):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") * 3 for _ in range(400)) for _ in range(5)]
    texts += [texts[-1] + " tail", texts[-2].upper()]
    ids = list(range(10, 10 + len(texts)))
    ids[-1] = ids[-2]  # a repeated id
    out = simhash.classes(rows_of_text(texts, ids)).select("row.doc_id", "fp", "component_id").collect()
    assert len(out) == len(texts)
    marks = [int(np.uint64(slow_fingerprint(t)).astype(np.int64)) for t in texts]
    roots = slow_roots(sorted(set(marks)))
    least = {}
    for i, m in zip(ids, marks, strict=True):
        least[roots[m]] = min(i, least.get(roots[m], i))
    assert sorted((r.doc_id, r.fp, r.component_id) for r in out) == sorted((i, m, least[roots[m]]) for i, m in zip(ids, marks, strict=True))
    assert simhash.classes(rows_of_text([])).count() == 0


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    def under_broadcasts(df):
        """The parts of the plan, as it ran, that were broadcast."""
        lines, parts = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
        lines = lines[:next((i for i, x in enumerate(lines) if "Initial Plan" in x), len(lines))]
        deep = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                stop = next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))
                parts.append("\n".join(lines[i:stop]))
        return parts

    seen, kept = [], simhash.freeze
    monkeypatch.setattr(simhash, "freeze", lambda df: (kept(df), seen.append(df))[0])
    centre = random.Random(1).getrandbits(64)
    signed = [(int(np.uint64(m).astype(np.int64)),) for m in {centre ^ (1 << b) for b in range(64)} | set(range(200))]
    links = simhash.links(spark.createDataFrame(signed, "fp long").groupBy("fp").agg(F.count(F.lit(1))).select("fp"))
    assert links.count() and len(links.collect()) and len(seen) == 1
    assert not [p for df in (*seen, links) for p in under_broadcasts(df) if "Generate" in p]
