"""All documents scored. SQL has no compressor: tested by held-out accuracy."""

from lapidary.llm.toxicity import score_documents

ORACLE = None


def query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
