"""Near copies of the pipeline by the exact similarity, for each kind of change."""

import random

from test_near import similarity

import corpus_pipeline


def test_pairs_at_the_limit_meet_whatever_the_change(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    pairs = []
    while len(pairs) < 180:
        n = rng.choice([150, 300])
        base = [rng.choice(words) for _ in range(n)]
        own, kind = list(base), len(pairs) % 3
        if kind == 0:
            for _ in range(rng.randint(n // 70, n // 40)):
                own[rng.randrange(n)] = rng.choice(words)
        elif kind == 1:
            k, at = rng.randint(n // 20, n // 8), rng.randrange(n // 2)
            own[at:at + k] = [rng.choice(words) for _ in range(k)]
        else:
            own += [rng.choice(words) for _ in range(rng.randint(n // 9, n // 3))]
        a, b = " ".join(base), " ".join(own)
        if 0.75 <= similarity(a, b) < 0.86 and a != b:
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.alike(spark, docs, "").collect()}
    near = [2 * i for i, (a, b) in enumerate(pairs) if similarity(a, b) >= 0.8]
    assert len(near) > 60
    strangers = {i for i in range(0, 2 * len(pairs), 2)}
    assert strangers <= kept  # the first of each pair stays: no two pairs meet
    met = [i in kept and i + 1 not in kept for i in near]
    assert sum(met) >= 0.98 * len(near), [[sum(met[j] for j, i in enumerate(near) if i // 2 % 3 == k), sum(i // 2 % 3 == k for i in near)] for k in range(3)]


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (4, "one TWO"), (None, "x"), (7, "a b c d e f"), (8, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in corpus_pipeline.alike(spark, docs, "").collect()), key=str) == [1, 4, 7, 8, None]
    assert corpus_pipeline.alike(spark, docs.limit(0), "").count() == 0


def test_nodes_by_a_shuffle_join(spark, monkeypatch):
    """More nodes than may go to every task: the same documents stay."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t + end) for i, (t, end) in enumerate((t, e) for t in texts for e in ("", " more", ""))], "doc_id long, text string")
    once = sorted(r.doc_id for r in corpus_pipeline.alike(spark, docs, "").collect())
    monkeypatch.setattr(corpus_pipeline.copies, "FEW", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.alike(spark, docs, "").collect()) == once == list(range(0, 90, 3))


def test_few_links_take_few_tasks(spark):
    """Rounds on a few links have tasks by their number, not as many as the shuffle has partitions."""
    from foundling.llm.components import stars

    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = stars(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 22), (22, 21)], "a long, b long"))
        assert found.rdd.getNumPartitions() == 1
        assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(1, 10)} | {(21, 20), (22, 20)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
