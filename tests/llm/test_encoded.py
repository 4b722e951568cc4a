"""Encoded data in the compression bands."""

import base64
import random

from test_quality import prose

from foundling.llm import quality


def lines(data, width=60):
    return "\n".join(data[i:i + width] for i in range(0, len(data), width))


def test_encoded_data_is_rejected(rows_of_text):
    rng = random.Random(4)
    coded = [lines(base64.b64encode(rng.randbytes(n)).decode(), w) for n, w in ((300, 6), (800, 12), (2500, 40), (5000, 60), (200_000, 76))]
    coded += [lines(rng.randbytes(n).hex()) for n in (10_000, 200_000)]
    text = prose(rng, 6000)
    half = [text[:20_000] + "\n" + lines(base64.b64encode(rng.randbytes(15_000)).decode()), text + "\n" + lines(base64.b64encode(rng.randbytes(len(text) // 2)).decode())]
    good = [text, text[:5000], text[:1200], text[:400]]
    out = {r.doc_id: r for r in quality.judge(rows_of_text(coded + half + good)).select("row.doc_id", "*").collect()}
    n = len(coded)
    assert [out[i].verdict for i in range(n)] == ["incompressible"] * n and not any(out[i].base_failed for i in range(n))
    assert all(out[i].verdict in ("incompressible", "chunks") and not out[i].kept for i in (n, n + 1))
    assert all(out[i].kept for i in range(n + 2, n + 2 + len(good)))
