"""The five best others of every 50th vector, among all vectors."""

from lapidary.llm.knn import top_inner_products


def query(spark, sf_dir):
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=50, k=5)


ORACLE = """
with v as (select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as w from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
"""
