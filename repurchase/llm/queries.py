"""The registered queries of the operators, and equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repurchase.llm import ann, bpe, fim, mixing, neardup, negatives, pii, quality, sharding, substrings, toxicity, warc, weighted


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.quality_verdicts(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixing.taken(mixed).drop("copies")


def op4_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Rows with this remainder are held out: nothing is learned from their labels.
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    scored = toxicity.score(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out, "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", outputs="digests")


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    counts = [
        F.size(F.filter("base", pii.of_kind(i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


def op9_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op11_block_rotation_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


def op13_weighted_sampling_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_label_propagation_shards": op1_label_propagation_shards,
    "op2_risk_controlled_rules": op2_risk_controlled_rules,
    "op3_golden_ratio_mix": op3_golden_ratio_mix,
    "op4_zstd_warc": op4_zstd_warc,
    "op5_run_length_index": op5_run_length_index,
    "op6_boosted_toxicity": op6_boosted_toxicity,
    "op7_bpe_tree": op7_bpe_tree,
    "op8_weak_supervision_pii": op8_weak_supervision_pii,
    "op9_bottom_k_near_duplicates": op9_bottom_k_near_duplicates,
    "op10_learned_partitions": op10_learned_partitions,
    "op11_block_rotation_fim": op11_block_rotation_fim,
    "op12_anchor_tree_negatives": op12_anchor_tree_negatives,
    "op13_weighted_sampling_fingerprints": op13_weighted_sampling_fingerprints,
}

SQL = {
    "op4_zstd_warc": """
with r as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest as d, min(page_id) as first from r where n >= 100 group by digest)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from r left join f on digest = d and n >= 100
""",
    "op3_golden_ratio_mix": r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':17') as ord
  from documents),
s0 as (select source, sum(size)::bigint as source_size from docs group by source),
s1 as (select source, source_size, row_number() over (order by source is null, source) - 1 as sid from s0),
s2 as (select *, case sid % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
  source_size * 3.0::double as cap from s1),
s3 as (select *, row_number() over (order by cap / weight, sid) as rk,
  ((sum(source_size::double) over ()) - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0.0::double))
  / sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as lvl from s2),
lv as (select lvl from s3 where cap / weight >= lvl order by rk limit 1),
s4 as (select source, source_size, least(cap, coalesce((select lvl from lv) * weight, cap)) as target from s3),
s5 as (select *, floor(target + 0.5::double)::bigint as goal from s4),
placed as (
  select d.doc_id, d.size, s.source_size, s.target, s.goal,
    coalesce(sum(d.size) over (partition by s.source order by d.ord, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from docs d join s5 s on d.source is not distinct from s.source)
select doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else (goal // source_size) * size
    + greatest(least(start + size, goal % source_size) - start, 0) end)::bigint as taken
from placed
""",
    "op11_block_rotation_fim": r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
d as (
  select doc_id, text, u, len(u)::bigint as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as x, ('0x' || h[9:16])::bigint % (len(u) + 1) as y,
    text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 as plain,
    ('0x' || h[25:32])::bigint % 100 < 80 as spm
  from t),
c as (
  select *, array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m,
    array_to_string(u[greatest(x, y) + 1:], '') as s
  from d)
select doc_id, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
  case when not plain then length(p) end as prefix_chars, case when not plain then length(m) end as middle_chars,
  sha256(case when plain then text when spm then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from c
""",
    "op12_anchor_tree_negatives": """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
  from r a join r c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank,
  id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
""",
}
