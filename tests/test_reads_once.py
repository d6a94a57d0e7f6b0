"""Alignments are worked through once where their results are read several times."""

import pyarrow as pa
import pyarrow.parquet as pq

from lociframe import plans

TEXTS = ["gcatgcatcgacgcactgcaatgcgcacgtagcatcgatcgcatgcatcagcagcgtagcatgcagcatcgactgacgcatcgca" * k for k in (1, 2, 3)]


def test_gpc_table_is_settled(spark, tmp_path):
    """The windows counted, added up and joined the cytosines anew from the texts each time."""
    pq.write_table(pa.table({"doc_id": [1, 6, 7], "text": TEXTS, "lang": ["en"] * 3, "source": ["s"] * 3}), tmp_path / "documents.parquet")
    out = plans.load()["w_gpc_density"].run(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "parquet" not in plan and "regexp_replace" not in plan
    assert out.filter("n > 0").count() > 0
