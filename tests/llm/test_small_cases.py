"""Edge cases and brute-force comparisons of the smaller operators."""

import hashlib
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foundling.llm import bpe, fixity, licences, mixing, sharding, substrings, topk, toxicity


def test_sharding(rows_of_text, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE", 16)  # several classes and several tasks of a class
    rng = random.Random(5)
    texts = [None, "", "", "x" * 900] + ["".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += texts[4:60] * 3
    out = sharding.shard(rows_of_text(texts), per_task=40).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    assert len(out) == len(texts)
    homes, bytes_, slots = {}, Counter(), {}
    for r in out:
        assert r.size == len(r.text or "") + 1
        assert homes.setdefault(r.text, r.shard) == r.shard
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(bytes_) == 16 and max(bytes_.values()) - min(bytes_.values()) <= 200
    assert sharding.shard(rows_of_text([])).count() == 0


def test_mixing(rows_of_text):
    rng = random.Random(6)
    texts = [None, "", "a b"] + [" ".join("w" for _ in range(rng.randint(1, 60))) for _ in range(300)]
    sources = [rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]) for _ in texts]
    out = (
        mixing.mix(rows_of_text(texts, sources=sources)).select("row.source", "row.text", F.col("size").alias("n"), "source_size", "target", "copies"))
    taken, total, goal = Counter(), Counter(), {}
    for r in out.collect():
        assert r.n == len((r.text or "").split()) and 0 <= r.copies <= 2
        taken[r.source] += r.n * r.copies
        total[r.source] += r.n
        goal[r.source] = r.target
    assert abs(sum(goal.values()) - 1.5 * sum(total.values())) < 1e-6
    assert all(goal[s] <= 2 * total[s] + 1e-9 and abs(taken[s] - goal[s]) <= 60 for s in goal)
    # sharing again and again gives the same targets
    names = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, want = set(), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        open_ = [s for s in names if s not in full]
        want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if want[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert goal[s] == pytest.approx(2 * total[s] if s in full else want[s])
    assert mixing.mixed(rows_of_text([])).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", "b" * (i % 50)) for i in range(300)] + [(None, None, None), (7, "http://x/7", "again"), (-5, "u", "")]
    left = spark.createDataFrame(rows, "k long, url string, html string").select("k", fixity.record(F.col("url"), F.col("html")).alias("r"))
    assert fixity.audit(left, left, key="k", record="r").count() == 0
    changed = [(k, u, "Z" if k == 41 else h) for k, u, h in rows if k not in (100, 7)] + [(5000, "n", "n"), (7, "http://x/7", "b" * 7)]
    right = spark.createDataFrame(changed, "k long, url string, html string").select("k", fixity.record(F.col("url"), F.col("html")).alias("r"))
    found = {r.key: r for r in fixity.audit(left, right, key="k", record="r").collect()}
    assert {k: r.status for k, r in found.items()} == {41: "changed", 100: "missing", 7: "changed", 5000: "added"}
    assert (found[7].left_records, found[7].right_records) == (2, 1)
    sizes = {r.k: r.n for r in left.groupBy("k").agg(F.sum(F.octet_length("r")).alias("n")).collect()}
    assert found[100].first_byte == sum(n for k, n in sizes.items() if k is not None and k < 100)
    empty = left.limit(0)
    assert fixity.audit(empty, empty, key="k", record="r").count() == 0
    assert {r.status for r in fixity.audit(left.limit(3), empty, key="k", record="r").collect()} == {"missing"}
    with pytest.raises(TypeError):
        fixity.audit(left.withColumn("k", F.col("k").cast("string")), left, key="k", record="r")


def test_fixity_descends_below_differing_nodes_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fixity, "differing", lambda level, last, real=fixity.differing: (seen.append(level.count()), real(level, last))[1])
    left = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("r"), F.col("id")).alias("r"), F.lit("x").alias("node"), F.lit(1).alias("side"))
    assert fixity.audit(left, left, key="k", record="r").count() == 0 and seen == [2, 0]
    seen.clear()
    right = left.withColumn("r", F.when(F.col("k") == 777, "?").otherwise(F.col("r")))
    found = fixity.audit(left, right, key="k", record="r").collect()
    assert [(r.key, r.status, r.first_byte, r.end_byte) for r in found] == [(777, "changed", sum(len(f"r{i}") for i in range(777)), sum(len(f"r{i}") for i in range(778)))]
    assert max(seen) <= 2 * fixity.FANOUT  # of 10,000 leaves


def test_warc_record(spark):
    made = spark.range(2).select(fixity.record(F.lit("http://x/"), F.lit("é"), F.lit("2024-05-06T07:08:09Z")).cast("string").alias("r")).collect()
    head, body = made[0].r.split("\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
    assert made[0].r == made[1].r and body == "é\r\n\r\n" and fields["Content-Length"] == "2" and fields["WARC-Date"] == "2024-05-06T07:08:09Z"
    assert str(uuid.UUID(fields["WARC-Record-ID"][10:-1])) == fields["WARC-Record-ID"][10:-1]


def test_licences(rows_of_text):
    texts = [None, "", "Released under the MIT License.", "general public license general public license", "the MIT\nLicense and Apache-License",
             "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "Licensed under CC BY-NC 4.0.",
             "granted permission charge free hereby", "É MIT lİcense"]
    out = {r.doc_id: r for r in licences.scan(rows_of_text(texts)).select("row.doc_id", "*").collect()}
    assert [(out[i].n_base, out[i].first_word, out[i].last_word, out[i].base_labels, out[i].labels) for i in range(len(texts))] == [
        (0, None, None, "", ""), (0, None, None, "", ""), (1, 3, 3, "mit", "mit"), (2, 0, 3, "gpl", "gpl"), (2, 1, 4, "apache,mit", "apache,mit"),
        (0, None, None, "", "mit"), (0, None, None, "", "cc-by-nc"), (0, None, None, "", ""), (0, None, None, "", ""),
    ]
    assert out[4].n_words == 6 and all(0 <= r.score <= 1 for r in out.values())
    assert licences.scan(rows_of_text([])).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (None, rows[0][1]), rows[5], (1000, [0.0] * 6), (1050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0, block=64, query_block=3).collect()
    vectors = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()}
    want = []
    for q in (q for q in vectors if q % 50 == 0):
        best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("crowd", [3, 65536])
def test_substrings(rows_of_text, crowd):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(12)
    texts = [None, "", prose(3), "a" * 300, "ab" * 40, prose(50), prose(50)] + [prose(rng.randint(0, 9)) + shared + prose(rng.randint(0, 9)) for _ in range(8)]
    texts += [texts[5], prose(20) + line + prose(20) + line + prose(9), line, "\x00" * 90 + "x" + "\x00" * 95]
    size = 40
    got = {r.key: r for r in substrings.cut(rows_of_text(texts), length=size, gram=8, crowd=crowd, batch_rows=5).collect()}
    assert len(got) == len({t or "" for t in texts})
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    for d in data:
        hit = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                hit[i + 1:i + 1 + size] = True
        r = got[hashlib.sha256(d).digest()[:16]]
        assert bytes(r.kept) == bytes(b for b, h in zip(d, hit[1:-1], strict=True) if not h)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(d), int(hit.sum()), int((np.diff(hit.astype(int)) == 1).sum()))
    assert substrings.cut(rows_of_text([])).count() == 0


def test_deep_shallow_order():
    rng = random.Random(10)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [b"a" * 200, b"a" * 199, b"a" * 200 + b"b", b""]
    group = np.array([rng.randint(0, 2) for _ in strings])
    order, same = substrings.deep_shallow(strings, group, depth=8)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings, strict=True))
    for i, j, n in zip(order, order[1:], same[1:], strict=False):
        assert n == (substrings.common(strings[i], strings[j]) if group[i] == group[j] else 0)


def test_bpe(rows_of_text):
    import tiktoken

    from foundling.llm.queries import tokenizer

    path, pattern = tokenizer()
    table = bpe.ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})
    texts = [None, "", " ", "it's   fine\n\n  x", "<|endoftext|>", "naïve 𝄞 日本語 ١٢٣", "a" * 5000, "the the the " * 300, "\x00\t\r\n"] * 2
    out = bpe.encode(rows_of_text(texts), path, pattern, block=40).select("row.doc_id", "ids", "decoded").collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.ids == own.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(rows_of_text([]), path, pattern).count() == 0


def test_toxicity(spark, rows_of_text):
    rng = random.Random(11)
    plain = ["mild", "river", "stone", "walks", "green", "early"]
    texts, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        body = [" ".join(rng.choice(plain) for _ in range(6)) + "." for _ in range(5)]
        if bad:
            body[2] = "river grubnik" + rng.choice(["", "a", "os"]) + " stone."
        texts.append(" ".join(body))
        marks.append((i, 1, int(bad)))
    docs = rows_of_text(texts + [None, "", "grubnik. " * 30000])
    labels = spark.createDataFrame(marks + [(3, 1, None), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).select("row.doc_id", "score", "offending").collect()}
    assert all((out[i].score >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(240))
    assert out[0].offending[0].sentence == 2 and out[240].score == out[241].score == 0 and out[242].score > 0.99
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).select("score").collect()} == {0.0}
