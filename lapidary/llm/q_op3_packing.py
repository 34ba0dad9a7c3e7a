"""All documents in sequences of at most 4096 tokens. SQL has no tokenizer: tested by unpacking and against a bound."""

from lapidary.llm.packing import pack_documents

ORACLE = None


def query(spark, sf_dir):
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
