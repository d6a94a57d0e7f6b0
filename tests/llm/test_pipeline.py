import base64
import hashlib
import math
from collections import Counter

import pytest
import test_linedup
import test_minhash

from lociframe.llm import mixing, quality
from lociframe.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def poisson(mean, *parts):
    u = int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / 2**52
    term = total = math.exp(-mean)
    k = 0
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    trees = quality.fit(docs, table(spark, SF, "labels"))
    kept = {r.doc_id for r in quality.judge(docs, trees).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    cut = test_linedup.plain([(i, r.text) for i, r in rows.items()])
    text = {i: cut[i, r.text][0] for i, r in rows.items()}
    root = test_minhash.plain(list(text.items()))
    left = [i for i in text if root[i] == i]
    size = Counter()
    named = {i: rows[i].source if rows[i].source in mixing.WEIGHTS else None for i in left}
    for i in left:
        size[named[i]] += len(text[i])
    wanted = {**mixing.WEIGHTS, None: 1 - sum(mixing.WEIGHTS.values())}
    total = sum(w for s, w in wanted.items() if size[s])
    want = []
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in left:
        rate = wanted[named[i]] / total * sum(size.values()) / size[named[i]]
        assert rate < mixing.PART
        ids = coder.encode_ordinary(text[i])
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest())
        want += [row] * poisson(rate, mixing.SEED, "0", str(i))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_all_but_the_last_return_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    empty = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
