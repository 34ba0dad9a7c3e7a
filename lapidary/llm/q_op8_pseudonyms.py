"""All documents with their personal values replaced. SQL has no Feistel network: tested by inversion and rules."""

from lapidary.llm.pseudonyms import KINDS, pseudonymise, session_key

ORACLE = None


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, session_key(spark))
    return out.select("doc_id", "text", *(out["found"][k].alias(f"n_{k}") for k in KINDS))
