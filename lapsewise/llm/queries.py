"""The numbered queries: each applies its operator to its whole table; SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import (
    dedup,
    extract,
    fingerprint,
    langid,
    licenses,
    mix,
    pack,
    periodic,
    sampling,
    secrets,
    shared,
    simhash,
    store,
    toxicity,
    trie,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shared.shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared.folder(spark)}/tokens-{uuid.uuid4().hex}"
    store.write(table(spark, sf_dir, "documents"), VOCABULARY, path)
    return store.read(spark, path)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of_kind(kind) for kind in secrets.BASE],
        F.sha2(secrets.listing(F.col("spans"), list(secrets.BASE)), 256).alias("base_sha256"),
        secrets.listing(F.col("spans"), secrets.KINDS).alias("spans"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "documents")).drop("row")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def crc_of(number: Column) -> Column:
    """Unsigned crc32 of the number as text (null as empty)."""
    return F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document (by crc32 of its id) the words from one place on repeat."""
    h = crc_of(F.col("doc_id"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text").cast("string"), F.lit(mix.WORD), F.lit(0)))
    g, n = F.floor(h / 10), F.size("words")
    slim = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("a", F.when(n > 0, F.col("g") % n))
    slim = slim.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda k: (F.col("a") + F.pmod(k - F.col("a"), F.col("p"))).cast("int")
    again = F.transform("words", lambda w, k: F.when(k >= F.col("a"), F.get("words", source(k))).otherwise(w))
    return slim.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(made_periodic(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast(periodic.RUN)
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | more(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    begun = trie.with_shared_heads(turns, 5, (crc_of(F.col("conv_id")) % 9).cast("int"))
    return trie.nodes(begun).drop("node")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda name: F.array_join(name, ",").alias(name)
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_pack": op2_pack,
    "op3_fingerprint": op3_fingerprint,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_extract": op6_extract,
    "op7_token_store": op7_token_store,
    "op8_secrets": op8_secrets,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
    "op11_periodic": op11_periodic,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, 3 * source_size as upper_limit,
         ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint as weight
  from sources),
-- the share of a weight: what is left when the sources that fill up under it are full
shares as (
  select w.source, w.source_size, w.weight, w.upper_limit,
         (select sum(source_size) from sources)
           - coalesce(sum(v.upper_limit) filter (where v.upper_limit * w.weight < w.upper_limit * v.weight), 0) as rest,
         sum(v.weight) filter (where v.upper_limit * w.weight >= w.upper_limit * v.weight) as others
  from weighed w cross join weighed v
  group by all),
share as (
  select arg_max(rest, others) as rest, max(others) as others
  from shares where upper_limit * others > weight * rest),
goals as (
  select s.source, s.source_size,
         case when s.upper_limit * s.others <= s.weight * s.rest then s.upper_limit else s.weight * share.rest end::hugeint as top,
         case when s.upper_limit * s.others <= s.weight * s.rest then 1 else share.others end::hugeint as bottom,
         ('0x' || md5('0:' || coalesce(s.source, chr(0)))[1:8])::bigint::hugeint as start
  from shares s left join share on true),
placed as (
  select d.*, g.source_size, g.top, g.bottom, g.start,
         (row_number() over (partition by d.source order by d.size, md5(coalesce(d.doc_id::varchar, ''))[1:2],
                             d.doc_id is null, d.doc_id) - 1)::hugeint as place
  from sized d join goals g on d.source is not distinct from g.source)
select doc_id, size, source_size, top::double / bottom::double as target,
       case when source_size = 0 then 0 else
         ((((place + 1) * top * 4294967296 + start * bottom * source_size) // (bottom * source_size * 4294967296))
          - ((place * top * 4294967296 + start * bottom * source_size) // (bottom * source_size * 4294967296))) * size
       end::bigint as taken
from placed
""",
    "op8_secrets": secrets.sql(),
    "op13_licenses": licenses.sql(),
    "op9_exact_dedup": r"""
with normal as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by text_sha256 order by doc_id is null, doc_id) = 1 as kept, text_sha256
from normal
window same as (partition by text_sha256)
""",
}
