"""Near-duplicate groups of all documents on 4-word shingles at 0.8. Too slow in SQL on whole tables: tested against all pairs of a fixture."""

from lapidary.llm.minhash import near_duplicates

ORACLE = None


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, threshold=80)
