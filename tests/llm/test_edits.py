import random

import numpy as np
import pytest

from lociframe.llm import bpe, edits
from lociframe.llm.common import table

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def count(text):
    import pyarrow as pa

    return len(bpe.encode_column(pa.array([text]), bpe.merger(RANKS))[0])


def grown(spark_free_text):
    """Tree of a text without Spark."""
    ends, at = [], 0
    while at < len(spark_free_text):
        end = edits.piece_end(spark_free_text, at)
        ends.append(spark_free_text[at:end])
        at = end
    how = bpe.merger(RANKS)
    chars = np.array([len(x) for x in ends] or [0])
    tokens = np.array([len(how.ids([x.encode()])[0]) for x in ends] or [0])
    rows = np.array([0, len(chars)])
    return edits.Tree(spark_free_text, edits.plant(chars, rows)[0], edits.plant(tokens, rows)[0], len(chars))


def test_many_edits_like_encoding_again():
    rng, how = random.Random(7), bpe.merger(RANKS)
    letters = "ab'srell  \n\t1é漢.,!"
    for _ in range(400):
        tree = grown("".join(rng.choices(letters, k=rng.randrange(80))))
        for _ in range(6):
            n = len(tree.text)
            start = rng.randrange(-2, n + 3)
            tree.splice(start, start + rng.randrange(-1, 9), "".join(rng.choices(letters, k=rng.randrange(9))), how)
            assert tree.count == count(tree.text), tree.text
            assert tree.chars[-1][0] == len(tree.text)
            for level in (tree.chars, tree.tokens):
                for below, above in zip(level, level[1:]):
                    assert above.tolist() == [int(below[i : i + 2].sum()) for i in range(0, len(below), 2)]


def test_only_touched_pieces_are_encoded():
    tree = grown("some words in a row, again and again. " * 2000)
    tree.splice(30_000, 30_005, "x", bpe.merger(RANKS))
    assert tree.encoded < 8 and tree.count == count(tree.text)


def test_documents_and_stored_trees(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    trees = edits.build(docs.withColumn("edits", edits.sample_edits()), RANKS)
    once = edits.apply(trees, "edits", RANKS)
    twice = edits.apply(once.withColumn("edits", edits.sample_edits()), "edits", RANKS).collect()
    for r in once.collect():
        assert r.n_tokens == count(r.text)
    for r in twice:
        assert r.n_tokens == count(r.text) and r.n_encoded < 80
    assert {r.n_tokens_before for r in twice} == {r.n_tokens for r in once.collect()}


def test_odd_rows(spark):
    texts = [None, "", "a", " ", "x" * 200_000, "it's", "漢" * 50]
    some = [None, [], [(0, 0, "it"), (0, 0, "'s")], [(5, 2, None)], [(None, 1, "x")], [None], [(0, 10**6, "")], [(1, 3, "b"), (2, 4, "c")]]
    data = [(None if i % 3 else 1, t, e, 5) for i, t in enumerate(texts) for e in some]
    df = spark.createDataFrame(data, f"doc_id long, text string, edits {edits.EDITS}, n_tokens long")
    rows = edits.apply(edits.build(df, RANKS), "edits", RANKS).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert r.n_tokens == count(r.text or "")
    assert edits.apply(edits.build(df.limit(0), RANKS), "edits", RANKS).count() == 0
