"""Blocks of equal texts."""

from foundling.llm import bpe
from foundling.llm.queries import tokenizer


def test_equal_blocks(spark):
    import tiktoken

    path, pattern = tokenizer()
    table = bpe.ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})
    texts = ["some text of a file", None, "another text\n" * 90]
    # two partitions of equal texts and a third one
    rows = spark.sparkContext.parallelize([(t,) for t in texts * 2 + texts[:1] * 3], 3)
    docs = spark.createDataFrame(rows, "text string")
    assert [len(p) for p in docs.rdd.glom().collect()] == [3, 3, 3]
    out = bpe.encode(docs, path, pattern).select("ids", "decoded").collect()
    assert len(out) == 9
    for r in out:
        text = bytes(r.decoded).decode()
        assert text in [t or "" for t in texts] and r.ids == own.encode_ordinary(text)
