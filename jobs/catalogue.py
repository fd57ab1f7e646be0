"""The jobs as queries: each runs twice into one new folder, and what stands there after that is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import feedback_triples, retrieval_run
from tarn.plans import oracles
from tarn.runtime import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_retrieval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "retrieval-run")
    for _ in range(2):
        retrieval_run.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return retrieval_run.result(spark, out).withColumn("score", F.round("score", 6))


def job2_feedback_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "feedback-triples")
    for _ in range(2):
        feedback_triples.run(spark, f"{sf_dir}/events.parquet", f"{out}/tables", f"{out}/checkpoint")
    return feedback_triples.result(spark, f"{out}/tables")


QUERIES = {f.__name__: f for f in (job1_retrieval_run, job2_feedback_triples)}

ORACLES = {
    "job1_retrieval_run": f"""WITH {oracles.SPARSE}, {oracles.DENSE}, {oracles.fused(10)},
runs AS (
  SELECT 'sparse' AS strategy, query_id, rank, doc_id, score FROM sparse WHERE rank < 10
  UNION ALL SELECT 'dense', query_id, rank, doc_id, score FROM dense WHERE rank < 10
  UNION ALL SELECT 'hybrid', query_id, rank, doc_id, score FROM rrf WHERE rank < 10
)
SELECT strategy, query_id, rank::INTEGER AS rank, r.doc_id, round(score, 6) AS score, lang,
       EXISTS (SELECT 1 FROM sparse s WHERE s.rank < 10 AND s.query_id = r.query_id AND s.doc_id = r.doc_id) AS in_baseline
FROM runs r LEFT JOIN documents d ON d.doc_id = r.doc_id""",
    "job2_feedback_triples": f"""WITH {oracles._TRIPLES}
SELECT query_id, query_text, pos_doc_id, neg_doc_id, right(query_id, 10) AS day FROM triples""",
}
