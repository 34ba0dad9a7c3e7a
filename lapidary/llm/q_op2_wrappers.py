"""Main text of all pages. Too deep for SQL: tested against the texts that pages were made from."""

from lapidary.llm.wrappers import extract

ORACLE = None


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
