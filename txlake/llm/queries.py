"""The package's registered queries: each operator over its whole table, and the corpus pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from txlake.catalog.registry import query
from txlake.llm import (
    bpe, conversation_trie, decontaminate, embedding_dedup, hard_negatives, language_id, license_scan, line_dedup, prob_minhash, source_mix, substring_dedup,
    suffix_dedup, warc_revisit)
from txlake.llm.schema_guard import durable, pick
from txlake.session import scratch_path

BPE_FILE = "byte_bpe_50k.json"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(BPE_FILE))


@query("op2_language_id")
def op2_language_id(spark, folder):
    return language_id.identify(table(spark, folder, "documents"))


@query("op3_embedding_dedup", """
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
r as (select vec_id id, vec_id low from embeddings union select l.b, r.low from r join l on l.a = r.id where r.low < l.b),
c as (select id, min(low) component_id from r group by 1),
n as (select a, count(*) n from l group by 1)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from embeddings left join n on a = vec_id join c on id = vec_id""")
def op3_embedding_dedup(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op4_prob_minhash")
def op4_prob_minhash(spark, folder):
    return prob_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_warc_revisit", """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) head from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest, case when head < page_id then 'revisit' else 'response' end record_type,
  case when head < page_id then head end refers_to
from p left join f on p.payload_digest = f.payload_digest""")
def op5_warc_revisit(spark, folder):
    archives = scratch_path(spark, "archives")
    warc_revisit.write_archives(warc_revisit.resolve_revisits(table(spark, folder, "pages")), archives)
    headers = durable(warc_revisit.read_archives(spark, archives).drop("payload", "url"), "headers")
    return warc_revisit.resolved_lengths(headers)


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query("op6_substring_dedup", f"""
with d as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], chr(10)) g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
f as (select g, min(doc_id) low from g group by 1),
h as (select distinct doc_id, i + k as place from (select doc_id, i, unnest(range(0, 13)) k from g join f using (g) where low < doc_id)),
r as (select doc_id, list(place) gone from h group by 1)
select d.doc_id, len(w) n_words, coalesce(len(gone), 0) n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(w, lambda x, i: case when not list_contains(coalesce(gone, []), i) then x end), lambda x: x is not null), ' '), '')) kept_sha256
from d left join r on d.doc_id = r.doc_id""")
def op6_substring_dedup(spark, folder):
    cut = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_decontamination")
def op7_decontamination(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("tiles")


@query("op8_license_scan")
def op8_license_scan(spark, folder):
    return license_scan.licences(table(spark, folder, "documents"))


@query("op9_line_dedup")
def op9_line_dedup(spark, folder):
    cut = line_dedup.remove_lines(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, folder):
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_conversation_trie", """
with t as (select conv_id, {r: coalesce(role, ''), t: coalesce(text, '')} v, turn,
  sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) g from conversations where conv_id is not null),
w as (select conv_id, list(v order by turn nulls first, g) w, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
    string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 h from t group by 1),
b as (select w.conv_id, coalesce(o.w, [])[1:w.h] || w.w[w.h + 1:] w from w left join w o on o.conv_id = w.conv_id - w.conv_id % 5),
p as (select conv_id, d, w[1:d] k, case when d > 0 then octet_length(encode(w[d].t)) else 0 end bytes, len(w) = d ends from (select *, unnest(range(len(w) + 1)) d from b)),
n as (select d, k, min(conv_id) conv, count(*) n, any_value(bytes) bytes, string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) ids from p group by 1, 2),
y as (select p.conv_id, p.d, n.conv from p join n on p.d = n.d and p.k = n.k),
m as (select n.*, y.conv parent from n left join y on y.conv_id = n.conv and y.d = n.d - 1),
c as (select parent conv, d - 1 d, count(*) children from m where d > 0 group by 1, 2),
e as (select m.*, coalesce(children, 0) children from m left join c on c.conv = m.conv and c.d = m.d),
s as (select y.conv, y.d, sum((e.children = 0)::int) leaves, sum((e.n - 1) * e.bytes) saved from e join y on y.conv_id = e.conv and y.d <= e.d group by 1, 2)
select e.conv conv_id, e.d depth, parent parent_conv_id, n n_convs, children n_children, leaves::bigint n_leaves, saved::bigint saved_tokens,
  sha256(coalesce(ids, '')) ends_sha256 from e join s on s.conv = e.conv and s.d = e.d""")
def op11_conversation_trie(spark, folder):
    return conversation_trie.trie(table(spark, folder, "conversations"))


@query("op12_hard_negatives", f"""
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
  list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)::bigint) e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 0)::bigint score
  from v a join v b on a.vec_id % {hard_negatives.ANCHOR_EVERY} = 0 and (a.vec_id <> b.vec_id or a.e <> b.e) and len(a.e) = len(b.e)),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {hard_negatives.POSITIVES})
select anchor_id, p.vec_id positive_id, row_number() over w::int rank, s.vec_id negative_id, p.score positive_score, s.score negative_score
from p join s using (anchor_id) where not s.same and {hard_negatives.LOWEST} * p.score <= 100 * s.score and 100 * s.score <= {hard_negatives.HIGHEST} * p.score
window w as (partition by anchor_id, p.vec_id order by s.score desc, s.vec_id)
qualify rank <= {hard_negatives.NEGATIVES}""")
def op12_hard_negatives(spark, folder):
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


@query("op13_source_mix", f"""
with d as (select doc_id, source, len({_WORDS}) size, md5(coalesce(text, '')) g from documents),
t as (select coalesce(sum(size), 0)::bigint total, greatest(1, least({source_mix.BLOCK}, coalesce(sum(size), 0)::bigint // ({source_mix.BLOCKS} * greatest(count(distinct coalesce(source, chr(0))), 1)))) b from d),
c as (select *, row_number() over (partition by doc_id, source, size, g) - 1 i from d),
s as (select source, sum(size)::bigint ss, count(*) n, row_number() over (order by source nulls last) - 1 place from d group by 1),
w as (select *, place % 3 + 1 w from s),
o as (select a.*, (select sum(least({source_mix.MOST} * b.ss::hugeint * a.w, {source_mix.MOST} * a.ss::hugeint * b.w)) from w b) < total::hugeint * a.w capped from w a, t),
f as (select total - coalesce(sum({source_mix.MOST} * ss) filter (capped), 0) free, sum(w) filter (not capped) weight from o, t group by total),
g as (select o.*, case when capped then ({source_mix.MOST} * ss)::double else free::double * w / weight::double end target from o, f),
q as (select place, count(*) quota from (select place, row_number() over (order by target / (2 * k + 1) desc, place) nth
  from (select place, target, unnest(range({source_mix.MOST} * ss // b + 2)) k from g, t where target > 0)), t where nth <= (2 * total + b) // (2 * b) group by 1),
p as (select c.*, i - i % {source_mix.COPIES} piece, place, ss, target, coalesce(quota, 0) seats, ceil((ss + n) / {source_mix.SHARD})::bigint shards
  from c join g on c.source is not distinct from g.source left join q using (place)),
r as (select *, ('0x' || substr(md5(concat_ws('|', '0', coalesce(doc_id::varchar, '-'), g, piece)), 1, 8))::bigint draw from p),
h as (select *, draw % shards shard, (sum(size) over (partition by place, draw % shards order by draw, doc_id nulls first, g, piece, i) - size)::bigint begin from r),
l as (select place, shard, sum(size)::bigint line, any_value(seats) seats, ('0x' || substr(md5(concat_ws('|', '0', 'shard', place, shard)), 1, 8))::bigint draw from h group by 1, 2),
u as (select place, shard, count(*) quota from (select place, shard, seats, row_number() over (partition by place order by line::double / (2 * k + 1) desc, shard) nth
  from (select place, shard, line, seats, unnest(range({source_mix.MOST} * line // b + 3)) k from l, t where line > 0)) where nth <= seats group by 1, 2),
v as (select place, shard, line, b, (line + b - 1) // b n, least(coalesce(quota, 0) * b, {source_mix.MOST} * line) tokens,
  {list(source_mix.PRIMES)}[draw % {len(source_mix.PRIMES)} + 1]::hugeint a, draw // {len(source_mix.PRIMES)} % ((line + b - 1) // b) c from l left join u using (place, shard), t where line > 0),
x as (select row_number() over () id, * exclude (c), v.c as c from h left join v using (place, shard)),
y as (select id, sum(greatest(0, least(begin + size, j * b + greatest(0, least(b, tokens % line - (k * b - case when k > last then n * b - line else 0 end)))) - greatest(begin, j * b))) part
  from (select *, (a * j + c) % n k, (a * (n - 1) + c) % n as last from (select *, unnest(range(begin // b, (begin + size - 1) // b + 1)) j from x where size > 0)) group by 1)
select doc_id, source, size, ss source_size, target, (case when size > 0 then tokens // line * size + part else 0 end)::bigint taken from x left join y using (id)""")
def op13_source_mix(spark, folder):
    return source_mix.mix(table(spark, folder, "documents"))
