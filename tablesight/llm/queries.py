"""Registered queries of this subpackage: one per operator, over its whole
table, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, extraction, minhash, mixing, packing, periodic, quality, sharding, spelling, suffix, tokens, toxicity, urlfilter
from .shared import WORD_PATTERN, Scratch

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = TOKENIZER) -> bytes:
    import public_tokenizers
    return tokens.read_tokenizer(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are written to their shards; the rows are read back
    from the files."""
    path = Scratch(spark, "shards").root
    written = sharding.write_shards(table(spark, sf_dir, "documents"), path, SHARDS)
    return written.select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix counts are stored; the tokens of the whole text, the limit and
    the longest prefix within it are read from the store."""
    stored = tokens.store_prefixes(table(spark, sf_dir, "documents"), tokenizer(), Scratch(spark, "prefixes").root)
    asked = tokens.bytes_within_budget(tokens.tokens_in_prefix(stored.drop("n_tokens"), F.col("n_bytes")), TOKEN_LIMIT)
    return asked.select("doc_id", "n_bytes", F.col("prefix_tokens").alias("n_tokens"),
                        (F.col("prefix_tokens") > TOKEN_LIMIT).alias("over_limit"), "budget_bytes")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), alter_every=199))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document, by crc32 of its id, the words
    from some place on are replaced by repetitions of the first few of them. A
    null id counts as no tenth."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.expr("transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)]))")
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op13_rows(docs: DataFrame) -> DataFrame:
    """The digest of each document's runs: their number, the one of greatest
    exponent, hashes of all and of the collapsed text."""
    found = periodic.find_runs(repeat_tails(docs))
    first = F.expr("""array_sort(runs, (x, y) -> case
        when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1)
        when x.start <> y.start then if(x.start < y.start, -1, 1)
        when x.period <> y.period then if(x.period < y.period, -1, 1) else 0 end)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", F.get(first, F.lit(0)))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_rules, op3_url_filters, op4_suffix_dedup, op5_sharding,
                            op6_embedding_near_dedup, op7_toxicity, op8_packing, op9_mixing, op10_token_counts, op11_html_extraction, op12_spelling_variants, op13_periodic_runs, pipeline)}

ORACLE_SQL = {
    "op3_url_filters": r"""
with parts as (
  select page_id,
    case when strpos(url, '://') > 0
         then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest
  from pages),
split as (
  select page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path
  from (select page_id, coalesce(rest, '') as rest from parts)),
rules(rule, rhost, rpath, verdict) as (values
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from split join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id)
select s.page_id, s.host, s.path, b.rule,
  coalesce(b.verdict, case when regexp_matches(s.host,
    '(^|[.-])(casino|bets|cheap-pills|porn|xxx|viagra|payday-loans)([.-]|$)') then 'block' else 'allow' end) as verdict
from split s left join best b on s.page_id is not distinct from b.page_id""",
    "op9_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    'mix-1|' || case when doc_id is null then '|' || md5(coalesce(text, '')) else doc_id::varchar end as seed from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, source_size * 2.0::double as cap,
    ([3, 1, 2])[((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as weight
  from sums),
levels as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from weighed window before as (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
chosen as (select arg_min(level, (cap / weight, source is null, encode(source))) as level from levels where level * weight <= cap),
targets as (
  select source, source_size, case when c.level is null then cap else least(weight * c.level, cap) end as target
  from weighed, chosen c),
rated as (
  select doc_id, size, source_size, target,
    case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substr(md5(seed), 1, 13))::bigint / 4503599627370496.0::double as draw
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  size * (floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end) as taken
from rated""",
}
