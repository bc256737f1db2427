"""The registered queries of this subpackage: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, lm, media, mixing, packing, pii, quality, simhash, toxicity
from .common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(read(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digests(chat.formatted(rows, tokenizer_path()))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_media, op2_licenses, op3_quality, op4_lm, op5_pii, op6_toxicity, op7_chat, op8_packing, op9_mixing, op10_simhash, pipeline]
    return {f.__name__: f for f in named}


_OP9 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight
  from d group by source),
l as (
  select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as level from s),
u as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as u
  from l window w as (order by level, source is null, source rows between unbounded preceding and 1 preceding)),
t as (
  select source, source_size, least(cap, weight * coalesce(max(case when level > u then u end) over (), max(level) over ())) as target from u),
r as (
  select *, case when source_size > 0 then floor(target / source_size + 1e-9) else 0 end as copies from t),
c as (
  select d.*, r.source_size, r.target, r.copies, r.target - r.copies * r.source_size as extra,
         sum(size) over (partition by d.source order by key rows between unbounded preceding and current row) as until
  from d join r on d.source is not distinct from r.source),
g as (select *, extra - coalesce(max(case when until <= extra then until end) over (partition by source), 0) as gap from c),
f as (select *, row_number() over (partition by source order by until <= extra, abs(size - gap), key) as place from g)
select doc_id, size, source_size, target,
       (size * (copies + case when until <= extra or (place = 1 and abs(size - gap) < gap) then 1 else 0 end))::bigint as taken
from f
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": _OP9}
