"""The registered queries of the operators of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import (
    bloom_lm,
    filter_audit,
    language,
    mixing,
    negatives,
    packing,
    pages,
    quality,
    sharding,
    simhash,
    sketch,
    urls,
    warc,
)
from tableflow.llm.store import prepare
from tableflow.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return run(spark, sf_dir)

        QUERIES[name] = with_settings
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source
), bounds as (
  select *, source_size * 2.0::double as bound, sum(source_size) over () * 1.5::double as total from sources
), levels as (
  select *, (total - coalesce(sum(bound) over (order by bound / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by bound / weight, source nulls last rows between current row and unbounded following) as level
  from bounds
), lowest as (
  select *, max(level) filter (where level * weight <= bound) over () as water from levels
), rates as (
  select source, source_size, least(bound, water * weight)::double as target,
    case when source_size > 0 then least(bound, water * weight)::double / source_size else 0 end as rate
  from lowest
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + (('0x' || substr(md5(concat_ws(':', 'mix', doc_id::varchar)), 1, 13))::bigint / 4503599627370496.0::double < rate - floor(rate))::int))::bigint as taken
from sized join rates on sized.source is not distinct from rates.source
"""


@query("op1_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.planned(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.sharded(docs, 24, ["source", "lang"], ["size"], ["text_crc32", "doc_id"])
    unset = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", unset)


@query("op3_bottom_k_fingerprints")
def bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_likeness(documents(spark, sf_dir))


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op4_pack_along_curve")
def pack_along_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(packing.pack(documents(spark, sf_dir)))


WARC_SQL = """
with sized as (
  select page_id, coalesce(html, '') as payload, strlen(coalesce(html, ''))::bigint as payload_bytes from pages
), firsts as (
  select *, min(page_id) over (partition by payload) as first_id from sized
)
select page_id, payload_bytes, sha256(payload) as payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from firsts
"""


@query("op5_warc_transactions", WARC_SQL)
def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = warc.captures(warc.read_archives(spark, path))
    return found.select(
        "page_id",
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_sha256").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.col("answer_page")).alias("refers_to"),
    )


def fold(folds: int) -> Column:
    """Remainder of the id's checksum."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = language.learn(docs.where(fold(3) != 1))
    return language.predicted(docs, models).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op7_bloom_lm_scores")
def bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bloom_lm.scored(documents(spark, sf_dir), fold(5) != 1)
    held_out = (~F.col("train")).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.extracted(table, pages.learn(table))


@query("op9_simhash_near_copies")
def simhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir))


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


NEGATIVES_SQL = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from vectors a join vectors b on a.vec_id % 50 = 0
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same and anchor_id <> id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
  id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), negatives.quantised(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


AUDIT_SQL = r"""
with recursive words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents
), flags as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), cells as (
  select part, (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
    + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::int
    + 8 * regexp_matches(body, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int as mask,
    count(*) as n, count(*) filter (good = 1) as good, count(*) filter (toxic = 1) as toxic
  from words left join flags using (doc_id) group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit
), prefixes as (
  select '' as prefix, 0 as applied, 0 as before, 0 as bit, 0 as step
  union all
  select prefix || letter, applied | letters.bit, applied, letters.bit, step + 1 from prefixes, letters where applied & letters.bit = 0
), parts as (
  select distinct part from cells
), steps as (
  select parts.part, prefix, step, right(prefix, 1) as letter,
    coalesce(sum(n) filter (mask & applied = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0)::bigint as toxic_lost
  from parts cross join prefixes join cells on cells.part = parts.part where step > 0 group by all
), every as (
  select steps.part, orders.prefix as filter_order, steps.* exclude (part, prefix)
  from steps join prefixes orders on orders.step = 5 and starts_with(orders.prefix, steps.prefix)
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, letter)::bigint as shapley
from every
"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.cells(documents(spark, sf_dir), labels))


RULES = [
    ("org", "/", urls.ALLOW),
    ("example.org", "/es/", urls.BLOCK),
    ("example.org", "/en/1", urls.BLOCK),
    ("com", "/fr/", urls.ALLOW),
    ("com", "/de/", urls.BLOCK),
]


URLS_SQL = r"""
with recursive read as (
  select page_id, url, lower(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)) as origin,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1) as rest,
    regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g') as seen
  from pages
), tags as (
  select url, origin, path, unnest(
    [regexp_extract(x, '(?is)\bhref\s*=\s*(?:"\s*([^"]*)|''\s*([^'']*)|([^\s"''>]+))', 1)
      || regexp_extract(x, '(?is)\bhref\s*=\s*(?:"\s*([^"]*)|''\s*([^'']*)|([^\s"''>]+))', 2)
      || regexp_extract(x, '(?is)\bhref\s*=\s*(?:"\s*([^"]*)|''\s*([^'']*)|([^\s"''>]+))', 3)
      for x in regexp_extract_all(seen, '(?is)<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b[^>]*>')]
    || [regexp_extract(x, '(?is)\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["'']?\s*([^"''>]+)', 1)
      for x in regexp_extract_all(seen, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>')]) as raw
  from read
), written as (
  select url, origin, path, replace(trim(raw), '&amp;', '&') as target from tags
), placed as (
  select url, case when target = '' or target[1] = '#' then null
    when contains(target, '://') and regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') then target
    when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') or coalesce(origin, '') = '' then null
    when starts_with(target, '//') then regexp_extract(url, '^([^:]*:)', 1) || target
    when target[1] = '/' then origin || target
    when target[1] = '?' then origin || path || target
    else origin || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || target end as target
  from written
), named as (
  select url, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as from_origin,
    target, regexp_extract(target, '(?s)^(.*?://[^/?#]*)', 1) as to_origin
  from placed where url is not null and target is not null
), links as (
  select distinct lower(from_origin) || regexp_replace(url[length(from_origin) + 1:], '(?s)#.*$', '') as a,
    lower(to_origin) || regexp_replace(target[length(to_origin) + 1:], '(?s)#.*$', '') as b
  from named
), pairs as (
  select a, b from links union select b, a from links
), reach as (
  select a, b from pairs union select reach.a, pairs.b from reach join pairs on pairs.a = reach.b
), rules as (
  select unnest(['org', 'example.org', 'example.org', 'com', 'com']) as host, unnest(['/', '/es/', '/en/1', '/fr/', '/de/']) as start,
    unnest(['allow', 'block', 'block', 'allow', 'block']) as verdict
), nodes as (
  select origin || regexp_replace(rest, '(?s)#.*$', '') as node from read where origin <> ''
  union select regexp_replace(url, '(?s)#.*$', '') from read where origin = ''
  union select b from links
), decided as (
  select node, arg_min(host || start, (-length(host || start), verdict)) as rule, arg_min(verdict, (-length(host || start), verdict)) as verdict
  from nodes join rules on starts_with(regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1), start) and contains(node, '://')
    and ends_with('.' || regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), '.' || host)
  group by node
), passed as (
  select a as node, min(verdict) as verdict from reach join decided on decided.node = b group by a
)
select page_id, coalesce(regexp_extract(origin, '(?s)^.*?://(.*)$', 1), '') as host, coalesce(path, '') as path, decided.rule,
  coalesce(decided.verdict, passed.verdict, 'allow') as verdict
from read left join decided on decided.node = case when origin = '' then regexp_replace(url, '(?s)#.*$', '') else origin || regexp_replace(rest, '(?s)#.*$', '') end
  left join passed on passed.node = case when origin = '' then regexp_replace(url, '(?s)#.*$', '') else origin || regexp_replace(rest, '(?s)#.*$', '') end
"""


@query("op13_url_filters", URLS_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
