"""Quality of all documents. SQL has no tokenizer for the verdict: tested against a plain version."""

from lapidary.llm.quality import rules

ORACLE = None


def query(spark, sf_dir):
    out = rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "fertility", "fallback", "evenness",
    )
