"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .block_knn import nearest
from .chat_format import format_chats, loss_text, parse_chat
from .common import staged, table
from .decontaminate import find_leaks
from .fim import fill_in_middle, restored
from .html_text import extract_text
from .kd_shards import kd_shards
from .language_id import identify_language
from .ngram_join import link_components
from .ranked_search import search
from .secret_scan import scan_secrets
from .token_files import digests, read_tokens, write_tokens
from .warc import read_warc, write_warc


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.digests(table(spark, sf_dir, "documents"), path=tokenizer_path(), pattern=tokenizer_pattern())
    return made.withColumnRenamed("id", "doc_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract_text(table(spark, sf_dir, "pages"))
    return made.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    made = format_chats(rows.unionByName(spark.createDataFrame(planted, rows.schema)))
    turns = parse_chat(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan_secrets(table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inferred")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(table(spark, sf_dir, "pages"))
    back = read_warc(spark, path)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    revisit = F.col("warc_type") == "revisit"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("payload_digest", ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = identify_language(docs, trains=~held_out()).withColumnRenamed("id", "doc_id")
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    leaks = F.size("leaked_items") > 0
    return found.select("doc_id", leaks.alias("contaminated"), F.array_join(F.array_sort(F.array_distinct("leaked_items")).cast("array<string>"), ",").alias("leaked_items"), "coverage", "longest_tile")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).withColumnRenamed("id", "doc_id")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return digests(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP1_SQL = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents
), s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(t) >= 5 then list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) when len(t) > 0 then [array_to_string(t, ' ')] else [] end) as sh from w)
), n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)
), reach as (
  select doc_id, doc_id as other from n union select reach.doc_id, links.b from reach join links on reach.other = links.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce((select min(other) from reach where reach.doc_id = d.doc_id), d.doc_id) as component_id
from documents d left join n using (doc_id)
"""

OP6_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?INST\]|/?s>|</?SYS>>)', '\1_\2', 'g')) as n from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + length(role) + 17) as bigint) as formatted_chars, cast(0 as bigint) as n_attachments, cast(0 as bigint) as expanded_tokens
from sized group by conv_id
"""

OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as keeper from d)
select page_id, payload_bytes, payload_digest,
  case when keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from k
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with t as (select row_number() over () as row, doc_id, {_TERMS} as t from documents),
size as (select row, doc_id, cast(len(t) as bigint) as n from t where len(t) > 0),
told as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from size),
item as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
tf as (select row, term, cast(count(*) as bigint) as tf from (select row, unnest(t) as term from t) where term in (select term from item) group by row, term),
w as (select term, cast(floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1))) as bigint) as w from tf, told group by term, docs),
hit as (
  select row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as points from tf join w using (term) join size using (row), told
), scored as (
  select item_id, row, cast(sum(points) as bigint) as score from item join hit using (term) group by item_id, row having sum(points) > 0
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored join size using (row) qualify rank <= 10
"""

OP13_SQL = r"""
with u as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), d as (
  select *, cast(len(u) as bigint) as n, cast('0x' || h[1:8] as bigint) % (len(u) + 1) as one, cast('0x' || h[9:16] as bigint) % (len(u) + 1) as two, cast('0x' || h[17:24] as bigint) % 100 as three, cast('0x' || h[25:32] as bigint) % 100 as four from u
), f as (
  select doc_id, n, text, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or three >= 50 then 'plain' when four < 80 then 'spm' else 'psm' end as form,
    array_to_string(u[1:least(one, two)], '') as prefix, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') as middle, array_to_string(u[greatest(one, two) + 1:], '') as suffix from d
)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from f
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_knn": op1_block_knn,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_kd_shards": op4_kd_shards,
    "op5_html_text": op5_html_text,
    "op6_chat_format": op6_chat_format,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_files": op12_token_files,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {"op1_block_knn": OP1_SQL, "op3_ngram_join": OP3_SQL, "op6_chat_format": OP6_SQL, "op8_warc": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
