from collections import Counter

import numpy as np
import pytest

from lociframe.llm import mixing


def test_distribution_is_poisson():
    for mean in (0.0, 0.01, 1.0, 7.5, 32.0):
        cdf = np.array(mixing.distribution(mean))
        p = np.diff(np.append(0, cdf))
        assert abs(cdf[-1] - 1) < 1e-12 and abs((p * np.arange(len(p))).sum() - mean) < 1e-9
        assert abs((p * np.arange(len(p)) ** 2).sum() - mean - mean**2) < 1e-7


def test_counts_follow_rates(spark):
    ids = spark.range(20_000)
    for mean in (0.3, 2.0, 150.0):
        n = np.array([r[0] for r in ids.select(mixing.copies(mean, "s", ids["id"].cast("string"))).collect()])
        assert abs(n.mean() - mean) < 5 * np.sqrt(mean / 20_000) and abs(n.var() / mean - 1) < 0.06
    assert ids.select(mixing.copies(0.0, "s", ids["id"].cast("string")).alias("n")).where("n > 0").count() == 0


def test_shares_meet_weights(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'rare' when id % 7 = 0 then null else concat('s', id % 9) end as source",
                                        "repeat('x', cast(50 + id % 50 as int)) as text", "1 as copy")
    out = mixing.mix(docs, {"hot": 0.2, "rare": 0.3, "absent": 0.25}, copy_col="copy").collect()
    size = Counter()
    for r in out:
        size[r.source if r.source in ("hot", "rare") else None] += len(r.text)
    total = sum(size.values())
    for s, share in (("hot", 0.2 / 0.75), ("rare", 0.3 / 0.75), (None, 0.25 / 0.75)):
        assert abs(size[s] / total - share) < 0.05
    copies = Counter((r.doc_id, r.copy) for r in out)
    assert max(copies.values()) == 1
    many = Counter(r.doc_id for r in out)
    assert all({(i, c) for c in range(1, n + 1)} <= set(copies) for i, n in many.items())
    again = mixing.mix(docs.repartition(7), {"hot": 0.2, "rare": 0.3, "absent": 0.25}, copy_col="copy").collect()
    assert [(r.doc_id, r.copy) for r in again] == [(r.doc_id, r.copy) for r in out] != sorted((r.doc_id, r.copy) for r in out)


def test_odd_rows(spark):
    data = [(1, None, "a"), (1, None, "a"), (None, "", "a"), (2, "t", None), (3, None, "empty"), (4, "x" * 100_000, "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("shuffle_key", docs_one())
    out = mixing.mix(docs, {"a": 0.3, "empty": 0.3})
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert n[1] % 2 == 0
    assert mixing.rates(docs, {"a": 0.3, "empty": 0.3})["empty"] == 1.0
    assert mixing.mix(docs.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(docs, {"a": 1.5})


def docs_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_copy_column_clashes_in_any_case(spark):
    docs = spark.sql("select 1 as doc_id, 'a' as source, 'xyz' as text, 'old' as Copy, 2 as SHUFFLE_KEY")
    out = mixing.mix(docs, {"a": 0.5}, copy_col="copy", target=30)
    assert out.columns == ["doc_id", "source", "text", "SHUFFLE_KEY", "copy"]
    assert [r.copy for r in out.orderBy("copy").collect()] == list(range(1, out.count() + 1))
