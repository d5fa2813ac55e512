"""Queries over the corpus tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenload.llm import fingerprints, host_reputation, line_dedup, mixing, near_text, near_vectors, pieces, secret_scan, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's reader, wherever the folder is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over documents."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with doc as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
line as (select rid, doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos from doc),
keyed as (
  select rid, doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from line),
seen as (select k, min(doc_id) as first_doc, count(distinct doc_id) as docs from keyed where length(k) >= 10 group by k),
marked as (
  select rid, doc_id, pos, line, coalesce(docs >= 2 and doc_id > first_doc, false) as gone
  from keyed left join seen using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by rid, doc_id
"""


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between embeddings of one label at a cosine of 0.93 or more."""
    out, _ = near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("_id").alias("vec_id"), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


OP2_SQL = r"""
with recursive good as (
  select vec_id, label, [x::double for x in embedding] as v from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from good a join good b
    on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a, min(b) as b from reach group by a),
counts as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) as kept
from embeddings e left join counts c on c.a = e.vec_id left join least l on l.a = e.vec_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of near equal bytes over documents."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: base spans, and those that the randomness battery adds."""
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}")
        for k in secret_scan.KINDS[:3]
    ]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(F.encode(secret_scan.joined(base), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op5_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document; kept: it stands for its class."""
    out = near_text.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), "class_id", F.expr("_id <=> class_id").alias("kept"))


def model_bytes() -> bytes:
    """The tokenizer's file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of documents, the spans of original bytes that they stand for, and their decoded texts, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, model_bytes(), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        F.lower(F.hex(F.xxhash64("begins", "ends"))).alias("spans_hash"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.graded(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_toxic", "severity", "toxic")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how near they and the next documents are."""
    return fingerprints.near_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules of the url query.
RULES = (
    host_reputation.Rule("allow", "com", "/"),
    host_reputation.Rule("block", "example.com", "/en/"),
    host_reputation.Rule("allow", "www.example.com", "/en/"),
    host_reputation.Rule("block", "net", "/es/"),
    host_reputation.Rule("block", "net", "/fr/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation over pages; a page is bad if its document is toxic or of low quality."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("doc"), F.expr("cast(toxic = 1 or quality = 0 as int)").alias("bad")
    )
    out = host_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
with listed as (select unnest(string_split('SUFFIXES', ' ')) as known),
cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
page as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
parsed as (select *, try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint) as doc from page),
outcome as (
  select doc_id as doc, max((toxic = 1 or quality = 0)::int) as bad from labels
  where (toxic = 1 or quality = 0) is not null group by doc_id),
host as (select host, count(bad) as n, coalesce(sum(bad), 0) as k from parsed left join outcome using (doc) group by host),
ended as (
  select host, n, k, coalesce(max_by(known, length(known)), regexp_extract(host, '[^.]*$')) as suffix
  from host left join listed on '.' || host like '%.' || known group by host, n, k),
hosts as (
  select host, n, k, suffix, case when length(host) <= length(suffix) + 1 then host
    else regexp_extract(left(host, length(host) - length(suffix) - 1), '[^.]*$') || '.' || suffix end as domain
  from ended),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by 1, 2),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by 1),
overall as (select (coalesce(sum(k), 0) + 1.0::double) / (coalesce(sum(n), 0) + 2) as m from hosts),
s1 as (select suffix, n, k, m from suffixes, overall),
t1 as (select sum((k - n * m) * (k - n * m) / (n * m * (1 - m))) as x2, count(*) as c, sum(n) as n from s1 where n > 0),
p1 as (select case when c = 0 or n = c or x2 <= c then 1000.0 else least(1000.0, greatest(1.0, (n - c) / (x2 - c) - 1)) end as s from t1),
m1 as (select suffix, (s * m + k) / (s + n) as m from s1, p1),
s2 as (select domain, n, k, m from domains join m1 using (suffix)),
t2 as (select sum((k - n * m) * (k - n * m) / (n * m * (1 - m))) as x2, count(*) as c, sum(n) as n from s2 where n > 0),
p2 as (select case when c = 0 or n = c or x2 <= c then 1000.0 else least(1000.0, greatest(1.0, (n - c) / (x2 - c) - 1)) end as s from t2),
m2 as (select domain, (s * m + k) / (s + n) as m from s2, p2),
s3 as (select host, n, k, m from hosts join m2 using (domain)),
t3 as (select sum((k - n * m) * (k - n * m) / (n * m * (1 - m))) as x2, count(*) as c, sum(n) as n from s3 where n > 0),
p3 as (select case when c = 0 or n = c or x2 <= c then 1000.0 else least(1000.0, greatest(1.0, (n - c) / (x2 - c) - 1)) end as s from t3),
m3 as (select host, s * m + k as a, s * (1 - m) + n - k as b from s3, p3),
low as (
  select host, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a + b) * ln(0.5::double)) / a * (1 + list_sum([
    exp(lgamma(a + 1) + lgamma(a + b + i + 1) - lgamma(a + i + 2) - lgamma(a + b) + (i + 1) * ln(0.5::double)) for i in range(3000)])) as below
  from m3),
ruled as (
  select page_id, host, path, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/'
    end as rule
  from parsed)
select page_id, host, path, rule, case
  when rule in ('com/', 'www.example.com/en/') then 'allow'
  when rule is not null then 'block'
  when below < 0.05 then 'block' else 'allow' end as verdict
from ruled left join low using (host)
""".replace("SUFFIXES", " ".join(host_reputation.SUFFIXES))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to 150 % of their words."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    draws = F.array_join(F.transform("draws", lambda d: F.concat(d["pass"].cast("string"), F.lit(":"), d["shard"].cast("string"))), ",")
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", draws.alias("draws"))


def _tree_sql(n_shards: int, blocks: str) -> str:
    """The splitting tree: a common table expression per level halves the shards of each node and deals its draws by MD5."""
    parts = [f"t0 as (select source, block, pass, 0 as lo, {n_shards} as hi from {blocks})"]
    for level in range((n_shards - 1).bit_length()):
        lot = f"md5('mix:{level}:' || case when source is null then 'none' else 'some' end || ':' || coalesce(source, '') || ':' || block || ':' || pass)"
        parts.append(f"""n{level} as (
  select *, count(*) over (partition by lo, hi) as n, (lo + hi) // 2 as mid,
    row_number() over (partition by lo, hi order by {lot}, source nulls last, block, pass) as spot from t{level}),
t{level + 1} as (
  select source, block, pass, case when hi - lo = 1 or spot <= n * (mid - lo) // (hi - lo) then lo else mid end as lo,
    case when hi - lo > 1 and spot <= n * (mid - lo) // (hi - lo) then mid else hi end as hi from n{level})""")
    return ",\n".join(parts) + f",\nshards as (select source, block, pass, lo as shard from t{(n_shards - 1).bit_length()})"


OP10_SQL = r"""
with slim as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
src as (select source, sum(size)::bigint as source_size from slim group by source),
ranked as (
  select *, row_number() over (order by source nulls last) as rank, source_size * 2.0::double as cap,
    sum(source_size) over () * 1.5::double as budget from src),
weighted as (select *, ([5.0::double, 2.0::double, 1.0::double])[(rank - 1) % 3 + 1] as w from ranked),
summed as (
  select *, sum(cap) over (order by cap / w, rank) - cap as "full",
    sum(w) over (order by cap / w desc, rank desc) as rest from weighted),
capped as (select *, cap / w <= (budget - "full") / rest as capped from summed),
target as (
  select source, source_size, case when capped then cap else w *
    (budget - sum(case when capped then cap else 0 end) over ())
    / nullif(sum(case when capped then 0 else w end) over (), 0) end as target from capped),
quota as (
  select *, case when source_size = 0 then 0 else floor(target / source_size)::int end as passes from target),
doc as (
  select row_number() over () as rid, s.doc_id, s.source, s.size, q.source_size, q.target, q.passes,
    q.target - q.passes * q.source_size as rest, substr(s.key, 1, 3) as block,
    sum(s.size) over (partition by s.source order by s.key, s.size rows between unbounded preceding and current row) - s.size as prior
  from slim s join quota q on s.source is not distinct from q.source),
block as (
  select source, block, passes, rest, source_size, sum(size) as block_size, min(prior) as before from doc group by all having sum(size) > 0),
draw as (
  select source, block, pass from (select *, unnest(range(passes + 1)) as pass from block) where pass < passes or before < rest),
TREE,
drawn as (
  select doc.*, size > 0 and (pass < passes or 2 * prior + size <= 2 * rest) as takes, pass, shard
  from doc left join shards on doc.source is not distinct from shards.source and doc.block = shards.block)
select doc_id, size, source_size, target, (size * count(*) filter (where takes))::bigint as taken,
  coalesce(string_agg(pass || ':' || shard, ',' order by pass) filter (where takes), '') as draws
from drawn group by rid, doc_id, size, source_size, target
""".replace("TREE", _tree_sql(16, "draw"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_vectors": op2_near_vectors,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_near_text": op5_near_text,
    "op6_pieces": op6_pieces,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_near_vectors": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_mixing": OP10_SQL}
