import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm import bpe
from lociframe.llm.common import table

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a", "it's 'stuff' we'll  they'REr ''s 's", "x\n\n y\t\tz  ", "'r 've'd'm't's'll'lx", " 　a  b", "ÄÖ漢字かな😀👍🏽 1²³४", "a" * 5000,
    "ab" * 3000 + "!" * 700, "\r\n \r\n", "don 't", "\n's", "1's2't", "é'é", "a'", "'", " '", "it'", "x'll'", "\x1c\x1d\x85y", "日" * 300,
]


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(texts):
    data, begins, _, at = bpe.pieces(pa.array(texts, pa.string()))
    return [data[a:b].tobytes().decode() for a, b in zip(begins[:-1], begins[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'srevltmdQ1 \n\t. é²"), max_size=30), max_size=6))
def test_pieces_like_the_pattern(texts):
    assert cut(texts) == [m for t in texts for m in regex.findall(P.PATTERN, t)]


def test_scan_composes():
    rng = np.random.default_rng(3)
    gens, compose, _, _ = bpe.monoid()
    for n in (1, 31, 33, 1000, 4099):
        codes = gens[rng.integers(0, len(gens), n)]
        want = codes.copy()
        for i in range(1, n):
            want[i] = compose[want[i - 1], codes[i]]
        assert (bpe.scan(codes) == want).all()


def test_like_the_library_and_back(spark, coder):
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choices("ab'sre ll1é😀\n\t.,漢", k=rng.randrange(60))) for _ in range(500))]
    docs = spark.createDataFrame([(i if i % 4 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, token_ids long")
    got = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "text", "token_ids", "token_starts", "decoded"}
    for r in got:
        ids = coder.encode_ordinary(r.text or "")
        assert r.token_ids == ids and bytes(r.decoded) == (r.text or "").encode()
        sizes = [len(coder.decode_single_token_bytes(i)) for i in ids]
        assert r.token_starts == [sum(sizes[:i]) for i in range(len(sizes))][: len(ids)]
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS), RANKS).count() == 0


def test_documents_digests(spark, coder):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(docs, RANKS).collect():
        ids = coder.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_malformed_bytes_and_wrong_offsets(spark, coder):
    bad = spark.sql("select 1L as doc_id, cast(X'61ff62' as string) as text union all select 2L, 'ok'")
    rows = {r.doc_id: r for r in bpe.encode(bad, RANKS).drop("text").collect()}
    assert rows[1].token_ids == coder.encode_ordinary("a�b") and rows[2].token_ids == coder.encode_ordinary("ok")
    wrong = bpe.encode(bad, RANKS).selectExpr("token_ids", "transform(token_starts, x -> x + 1) as token_starts")
    with pytest.raises(Exception, match="do not belong"):
        bpe.decode(wrong, RANKS).collect()
