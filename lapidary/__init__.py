"""Record curation on Spark: rules, de-duplication, joins, prompts and inventory as DataFrame operators."""
