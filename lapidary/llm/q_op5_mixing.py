"""All documents mixed to the weights of their sources; ``placed`` counts a document's places in shards that the splitting tree gave."""

from pyspark.sql import functions as F

from lapidary.llm.mixing import mix_sources


def query(spark, sf_dir):
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=False)
    placed = F.size(F.filter("placements", lambda p: (p["shard"] >= 0) & (p["shard"] < F.col("n_shards"))))
    return out.select("doc_id", "size", "source_size", "target", "taken", placed.cast("long").alias("placed"))


ORACLE = r"""
with n as (select cast(greatest(1024, pow(2, greatest(0, ceil(log2(greatest(1, count(*) / 2000.0)))))) as bigint) as blocks from documents),
d as (
  select cast(doc_id as bigint) as doc_id, source is null as no_source, coalesce(source, '') as src,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('5:' || coalesce(cast(doc_id as varchar), '')) as perm,
         cast(('0x' || substr(md5('block:5:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint % n.blocks as integer) as block
  from documents, n),
b as (select no_source, src, block, cast(sum(size) as bigint) as words from d group by all),
s as (select no_source, src, cast(sum(words) as bigint) as source_size from b group by all),
w as (select *, (row_number() over (order by no_source, src) - 1) % 3 + 1 as weight from s),
l as (select *, sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size * 3 / weight, no_source, src rows between unbounded preceding and 1 preceding), 0) as room,
             sum(weight) over () - coalesce(sum(weight) over (order by source_size * 3 / weight, no_source, src rows between unbounded preceding and 1 preceding), 0) as weights from w),
t as (select no_source, src, source_size, least(cast(source_size * 3 as double), weight * max(cast(room as double) / cast(weights as double)) over ()) as target from l),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from t),
q as (select *, cast(floor(target + 0.5) as bigint) - passes * source_size as part from p),
o as (select *, coalesce(sum(words) over (partition by no_source, src order by md5('5:' || src || ':' || cast(block as varchar)), block rows between unbounded preceding and 1 preceding), 0) as before from b),
x as (select d.doc_id, d.size, q.source_size, q.target, q.passes, q.part, o.before,
             coalesce(sum(d.size) over (partition by d.no_source, d.src, d.block order by d.perm, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as within
      from d join o using (no_source, src, block) join q using (no_source, src))
select doc_id, size, source_size, target, cast(passes * size + greatest(0, least(size, part - before - within)) as bigint) as taken,
       passes + case when least(size, part - before - within) > 0 then 1 else 0 end as placed from x
"""
