"""Files of token blocks against the tokenizer itself, and the blocks against numpy."""

import io
import random
from uuid import uuid4
from zlib import crc32

import numpy as np
import pytest

from foundling.llm import tokenfile
from foundling.session import shared_dir


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("percentile", [0, 50, 95, 100])
def test_blocks(percentile):
    rng = np.random.default_rng(4)
    for ids in ([], [7], [0] * 256, [(1 << 32) - 1, 0] * 200, rng.integers(0, 50_000, 5000), rng.integers(0, 30, 700) + (rng.random(700) < 0.05) * 4_000_000_000, np.arange(513)):
        ids = np.array(ids, np.uint32)
        blocks = tokenfile.pack(ids, percentile)
        data = b"".join(blocks)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1].astype(np.int64)
        sizes = np.minimum(tokenfile.BLOCK, len(ids) - tokenfile.BLOCK * np.arange(len(blocks)))
        assert (tokenfile.unpack(data, starts, sizes) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(256, 3, np.uint32)
    ids[::2] = 2
    ids[17] = 40_000
    assert len(tokenfile.pack(ids)[0]) == 8 + 256 // 8 + 1 + 4


def test_any_stretch(monkeypatch):
    monkeypatch.setattr(tokenfile, "RUN", 512)
    rng = np.random.default_rng(5)
    docs = [(i if i % 3 else None, rng.integers(0, 49_408, int(n)).astype(np.uint32)) for i, n in enumerate([0, 1, 255, 256, 257, 3000, 0, 40] + [5] * 200)]
    out = io.BytesIO()
    writer = tokenfile.Writer(out)
    for doc in docs:
        writer.add(*doc)
    assert writer.close() == len(out.getvalue())
    reader = tokenfile.Reader(out)
    every = np.concatenate([ids for _, ids in docs])
    assert reader.ids == [i for i, _ in docs] and reader.n == len(every)
    assert all((reader.document(k) == ids).all() for k, (_, ids) in enumerate(docs))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(every) + 1, 2).tolist())
        assert (reader.read(a, b) == every[a:b]).all()
    assert reader.checksums() == [crc32(ids.astype("<u4").tobytes()) for _, ids in docs]
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(b"x" * 100))


def _result(spark, docs, tokenizer, **how):
    folder = f"{shared_dir(spark)}/{uuid4()}"
    manifest = tokenfile.write(docs, folder, tokenizer, **how)
    rows = sorted(map(tuple, tokenfile.documents(manifest, folder).collect()), key=lambda r: r[1])
    files = manifest.count()
    tokenfile.remove(spark, folder)
    return rows, files


@pytest.mark.parametrize("how", [{}, {"ranges": 1, "file_ids": 300}, {"ranges": 7, "file_ids": 50}])
def test_files(spark, rows_of_text, tokenizer, how):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", " \t\n", "Mixed CASE  don't é ́ x y z", "<|endoftext|> a<|startoftext|>b", "\x00\x1c\x85é\r\nΣΑΣ", "𝄞日本語" * 50, "word " * 4000, "a" * 20_000]
    texts += ["".join(rng.choice("ab'sΣ1 \n\t.é́ ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids = [5, 3, None, 9, 2, None, -4, 1 << 40, 0] + [rng.choice([50, 50, 50, 60 + i, None]) for i in range(300)]
    texts, ids = texts + texts[:20], ids + ids[:20]
    own = Tokenizer.from_str(tokenizer)
    want = {}
    for i, t in zip(ids, texts, strict=True):
        coded = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault(i, []).append((len(coded), crc32(coded.tobytes())))
    rows, files = _result(spark, rows_of_text(texts, ids), tokenizer, **how)
    assert len(rows) == len(texts) and files > (0 if not how else 6)
    at, got = 0, {}
    for i, start, n, crc in rows:
        assert start == at
        at += n
        got.setdefault(i, []).append((n, crc))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    order = [tokenfile.NO_ID if r[0] is None else r[0] for r in rows]
    assert order == sorted(order)


def test_one_id_is_split(spark, rows_of_text):
    docs = rows_of_text(["x"] * 900, [7] * 700 + list(range(100, 300)))
    found = tokenfile.cuts(docs, doc_id="doc_id", ranges=8)
    assert sum(i == 7 for i, _ in found) >= 5


def test_empty_table(spark, rows_of_text, tokenizer):
    assert _result(spark, rows_of_text([]), tokenizer) == ([], 0)
