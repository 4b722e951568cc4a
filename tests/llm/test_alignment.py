"""Token alignment against a plain walk over whole texts, and the matrices against numpy."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from foundling.llm import alignment


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as public

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def brute(texts, files):
    """The contract's columns for each text, and overlap links, by loops over bytes and groups."""
    t = alignment.Tokenizers(*files)
    found, holders = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a = t.a.encode(" " + text, add_special_tokens=False).ids
        b = t.b.encode(text)
        data = (" " + text).encode()
        bytes_a, bytes_b = [t.bytes_a[i] for i in a], [t.bytes_b[i] for i in b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            found.append(None)
            continue
        ends = [set(), set()]
        spans = [[], []]
        for side, tokens in enumerate((bytes_a, bytes_b)):
            at = 0
            for x in tokens:
                spans[side].append((at, at + len(x)))
                at += len(x)
                ends[side].add(at)
        groups, low = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append([[i for i, (s, e) in zip(ids, sp, strict=True) if low <= s and e <= end] for ids, sp in ((a, spans[0]), (b, spans[1]))])
            low = end
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        overlaps = sum(s < f and g < e for s, e in spans[0] for g, f in spans[1]) if len(a) < 300 else None
        holders.update(set(links))
        found.append((len(a), len(b), groups, links, overlaps))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        n_a, n_b, groups, links, overlaps = f
        shown = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((
            n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if holders[k] == most[k[0]]),
            sum(n * holders[k] for k, n in links.items()), sha256(shown.encode()).hexdigest(), overlaps,
        ))
    return out


def texts_of_all_sorts():
    rng = random.Random(13)
    texts = [None, "", " ", "  ", "\n", "abc ", " abc", "a  b", "a \n b\n\n  c", "x\t y", "it's <|endoftext|> <s></s> fine", "naïve 𝄞 日本語 ١٢٣", "▁a b", "a▁▁ b",
             "\x00\x1c y\x85 z　w\xa0 v", "the the the " * 300, "a" * 5000, "q" * 64 + " " * 300 + "z", "日本語テキスト" * 200, "ﬁ① é é"]
    texts += ["".join(rng.choice("ab'sé1 \n \t.,日  ") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    words = ["river", "straße", "unbelievable", "don't", "3.14", "Привет", "\n", "hello,", "x", ""]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(100)]


@pytest.mark.parametrize("block, chunks", [(1 << 20, 300_000), (300, 50)])
def test_documents(rows_of_text, files, monkeypatch, block, chunks):
    monkeypatch.setattr(alignment, "CHUNKS", chunks)
    monkeypatch.setattr(alignment, "TERMS", 64)
    texts = texts_of_all_sorts()
    texts += texts[:30]
    found = alignment.Alignment(rows_of_text(texts), *files, block=block).documents()
    got = {r[0]: tuple(r)[1:] for r in found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps").collect()}
    want = brute(texts, files)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i][:7] == w[:7], texts[i]
        assert w[7] is None or got[i][7] == w[7], texts[i]
    assert want[12][0] == 0 and want[17][0] > 0


def test_pairs(rows_of_text, files):
    found = alignment.Alignment(rows_of_text(["river stone", "river", "river river", None]), *files).pairs().collect()
    river = [r for r in found if r["count"] == 3]
    assert river and all(r.best == 1 for r in river) and all(r["count"] >= 1 for r in found)


def test_extra_columns_and_empty_table(spark, rows_of_text, files):
    df = spark.createDataFrame([(1, "a b", "x", 2, 3, [1], "y")], "doc_id long, text string, block string, kind int, number int, payload array<int>, row string")
    r = alignment.Alignment(df, *files).documents().collect()[0]
    assert r.row.block == "x" and r.row.payload == [1] and r.n_a == 2
    assert alignment.Alignment(rows_of_text([]), *files).documents().count() == 0


def test_matrices(monkeypatch):
    rng = np.random.default_rng(0)
    for terms in (1, 7, 1 << 22):
        monkeypatch.setattr(alignment, "TERMS", terms)
        for h, k, w in ((5, 6, 7), (1, 1, 1), (9, 3, 0), (0, 4, 2), (8, 20, 8)):
            a, b = (rng.integers(0, 4, s) * (rng.random(s) < 0.4) for s in ((h, k), (k, w)))
            sparse = [alignment.Csr.of(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (a, b)]
            for got, want in ((sparse[0].product(sparse[1]), a @ b), (sparse[0].transpose(), a.T)):
                dense = np.zeros(want.shape, int)
                dense[got.rows, got.columns] = got.values
                assert (dense == want).all()


def test_groups():
    a, b, n = alignment.groups_of(np.array([2, 1, 3]), np.array([1, 1, 4]))
    assert (a.tolist(), b.tolist(), n) == ([0, 1, 1], [0, 0, 1], 2)
