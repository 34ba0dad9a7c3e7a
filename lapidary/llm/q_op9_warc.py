"""All pages through WARC archives and back."""

from pyspark.sql import functions as F

from lapidary.llm.warc import archive_and_assemble


def query(spark, sf_dir):
    captures = archive_and_assemble(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0, with_payload=False)
    # a response's size and digest are of the payload that was read; a revisit has none, and its records tell
    return captures.select(
        "page_id",
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )


_BITS = "cast(('0x' || substr(sha1(coalesce(html, '')), {at}, 5))::bigint as bigint)"
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((({_BITS.format(at=5 * i + 1)} >> {shift}) & 31) + 1 as integer), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
ORACLE = f"""
with d as (select cast(page_id as bigint) as page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, {_LETTERS} as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as largest from d)
select page_id, payload_bytes, payload_digest, case when page_id = largest then 'response' else 'revisit' end as record_type,
       case when page_id = largest then null else largest end as refers_to from m
"""
