"""Passages of 51 to 65 words in otherwise different texts."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from foundling.llm import substrings
from foundling.llm.queries import QUERIES


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(8)

    def some(n, low=3, high=8):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high))) for _ in range(n))

    sizes = [51, 52, 55, 58, 61, 65]
    planted = [some(n, 4, 6) for n in sizes] + [some(n, 3, 4) for n in sizes]
    short = some(40, 5, 5)  # over 200 bytes, not over fifty words
    texts = [f"{some(90)} {p} {some(70)}" for p in [*planted, short] for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        if i >= 2 * len(planted):
            assert out[i] == text
        else:
            start = text.index(planted[i // 2])
            end = start + len(planted[i // 2])
            # neighbouring signs may be equal by chance
            assert planted[i // 2][:30] not in out[i] and out[i][:start - 8] == text[:start - 8] and out[i].endswith(text[end + 8:])


@pytest.mark.parametrize(("crowd", "step"), [(65536, 1 << 20), (3, 1 << 20), (65536, 150), (3, 150)])
def test_two_lengths_in_one_run(spark, monkeypatch, crowd, step):
    monkeypatch.setattr(substrings, "STEP", step)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(60), prose(11)
    texts = [None, "", prose(3), "a" * 300, "ab" * 40, *[prose(50)] * 2, *[prose(7)] * 2, short, "\x00" * 90 + "x" + "\x00" * 95]
    texts += [prose(rng.randint(0, 9)) + rng.choice([long, short, long[40:110]]) + prose(rng.randint(0, 9)) for _ in range(12)] + [prose(20) + short + prose(20) + short + prose(9)]
    texts += [f"{prose(9)}{i}one two ten six may day cat{i}{prose(9)}" for i in range(2)]
    sizes, least = (40, 24), 6
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {bytes(r.key): r for r in substrings.cut(docs, length=sizes[0], gram=8, crowd=crowd, batch_rows=5, also=sizes[1], also_words=least).collect()}
    data = [(t or "").encode() for t in texts]
    assert len(got) == len(set(data))
    more = 0
    for k, size in enumerate(sizes):
        seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
        for d in data:
            hit = bytearray(len(d))
            for i in range(len(d) - size + 1):
                if seen[d[i:i + size]] > 1:
                    hit[i:i + size] = b"\x01" * size
            runs = [m.span() for m in re.finditer(rb"\x01+", bytes(hit))]
            r = got[hashlib.sha256(d).digest()[:16]]
            if k:
                long_ = [b - a for a, b in runs if len(d[a:b].split()) >= least]
                assert (r.n_passages, r.n_passage_bytes) == (len(long_), sum(long_))
                more += bool(long_) and not r.n_removed
            else:
                assert (r.n_bytes, r.n_removed, r.n_spans) == (len(d), sum(hit), len(runs)) and [(x.a, x.b) for x in r.spans] == runs
                assert bytes(r.kept) == bytes(b for b, h in zip(d, hit, strict=True) if not h)
    assert more  # passages that the long strings don't see


def test_op4_tells_passages_of_over_fifty_words(spark, tmp_path):
    rng = random.Random(12)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 6))) for _ in range(n))
    shared, short = some(52), some(45)
    texts = [f"{some(80)} {p} {some(60)}" for p in (shared, short, shared, short)] + [some(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op4_deep_shallow_substrings"](spark, str(tmp_path)).collect()}
    assert [got[i].n_passages for i in range(5)] == [1, 0, 1, 0, 0]
    assert [got[i].n_removed for i in range(5)] == [0] * 5  # under 400 bytes
    assert abs(got[0].n_passage_bytes - len(shared)) < 8
