"""The queries of the training-data operators: one for each, over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.chat_format import digests, format_conversations
from stowage.llm import bottom_k, collocations, conversation_trie, licences, merkle, mixing, ngram_join, piece_sampling, pii, suffix_dedup, toxicity
from stowage.llm.common import table
from stowage.llm.exact_dedup import exact_dedup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL["op5_exact_dedup"] = r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
     g as (select norm, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from d group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from d join g using (norm)
"""


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.sql("select -1L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role from range(2)").withColumn("text", F.lit(says))
    return digests(format_conversations(conversations.unionByName(own)))


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [pii.number_of(kind, "base").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"),
        pii.number_of("secret", "spans").alias("n_secret"), F.size("spans").cast("long").alias("n_found"), F.size("learned").cast("long").alias("n_learned"),
    )


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


@_query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passages=True)


@_query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"))


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: source / language / thousand / doc_id.txt."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), path.alias("path"), "text")
    return licences.scan_licences(files).withColumnRenamed("file", "doc_id")


_TEMPLATES = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licences.known_templates(licences.TEMPLATES))
SQL["op2_licences"] = rf"""
with recursive files as (
  select doc_id, concat_ws('/', source, lang, cast(doc_id // 1000 as varchar), doc_id || '.txt') as path, coalesce(text, '') as text from documents),
rows as (select doc_id, path, text, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, list_filter(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))), lambda x: regexp_matches(lower(x), '{licences.CUE}')) as lines,
  list_filter(string_split_regex(text, '{licences.BLANK}'), lambda x: contains(x, chr(10)) and regexp_matches(lower(x), '{licences.CUE}')) as blocks from files),
texts as (select text, any_value(lines) as lines, any_value(blocks) as blocks from rows where regexp_matches(lower(text), '{licences.CUE}') group by text),
parts as (select distinct text, unnest(lines || blocks || [text]) as passage from texts),
passages as (select distinct passage from parts),
known(template, licence, words) as (values {_TEMPLATES}),
ours as (select passage, token, count(*) as tf from (select passage, unnest(regexp_extract_all(lower(passage), '{licences.TOKEN}')) as token from passages) group by all),
theirs as (select template, token, count(*) as tf from (select template, unnest(regexp_extract_all(lower(words), '{licences.TOKEN}')) as token from known) group by all),
idf as (select coalesce(a.token, b.token) as token,
    ln((1.0 + (select count(*) from known) + (select count(*) from passages)) / (1 + coalesce(a.n, 0) + coalesce(b.n, 0))) + 1 as idf
  from (select token, count(*) as n from ours group by token) a full join (select token, count(*) as n from theirs group by token) b on a.token = b.token),
w as (select passage, token, tf * idf as w from ours join idf using (token)),
v as (select template, token, tf * idf as v from theirs join idf using (token)),
dots as (select passage, template, sum(w * v) as dot from w join v using (token) group by all),
cosines as (select passage, licence, round(dot / (wn * vn), 4) as cosine from dots
  join (select passage, sqrt(sum(w * w)) as wn from w group by passage) using (passage) join (select template, sqrt(sum(v * v)) as vn from v group by template) using (template) join known using (template)),
matched as (select passage, min(licence) filter (cosine = top) as licence, any_value(top) as cosine
  from (select *, max(cosine) over (partition by passage) as top from cosines where cosine >= {licences.THRESHOLD}) group by passage),
alike as (select text, bool_or(passage = text) as whole_matches, max(cosine) as cosine, min(licence) filter (cosine = top) as matched
  from (select text, m.*, max(cosine) over (partition by text) as top from parts join matched m using (passage)) group by text),
told as (select text, regexp_replace(regexp_replace(regexp_extract(text, '{licences.EXPRESSION}', 1), '[ \t]+', ' ', 'g'), '^\(([^()]*)\)$', '\1') as told
  from texts where regexp_matches(text, '{licences.EXPRESSION}')),
own as (select text, whole_matches, coalesce(told, matched) as own_licence, case when told is not null then 1.0::double else cosine end as own_cosine from alike full join told using (text)),
marked as (select doc_id, path, dir, cast(len(lines) as bigint) as n_statements, own_licence, own_cosine,
    coalesce(own_licence is not null and (regexp_matches(path, '{licences.FILE_NAME}') or (regexp_matches(path, '{licences.TEXT_NAME}') and whole_matches)), false) as is_licence_file from rows left join own using (text)),
covered as (select dir, max(own_cosine) as c, min(own_licence) filter (own_cosine = top) as dir_licence
  from (select *, max(own_cosine) over (partition by dir) as top from marked where is_licence_file) group by dir),
near as (select m.doc_id, max_by(c.dir, length(c.dir)) as ancestor, max_by(c.dir_licence, length(c.dir)) as dir_licence
  from marked m join covered c on m.dir = c.dir or starts_with(m.dir, c.dir || '/') or c.dir = '' group by m.doc_id)
select doc_id, path, n_statements, own_licence, own_cosine, is_licence_file, coalesce(own_licence, dir_licence) as licence,
  case when own_licence is null then ancestor end as inherited_from from marked left join near using (doc_id)
"""


SQL["op6_ngram_join"] = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as grams from w),
s as (select doc_id, unnest(grams) as gram from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
e as (select a, b from p join g x on x.doc_id = a join g y on y.doc_id = b where 100 * shared >= 75 * (len(x.grams) + len(y.grams) - shared)),
both_ways as (select a, b from e union all select b, a from e),
r(x, y) as (select doc_id, doc_id from g union select r.x, t.b from r join both_ways t on r.y = t.a),
c as (select x, min(y) as component_id from r group by x)
select doc_id, cast(len(grams) as bigint) as n_shingles, component_id from g join c on c.x = g.doc_id
"""


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


SQL["op11_collocations"] = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
q as (select row_number() over () as pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
w as (select pid, lang, unnest(ws) as w1, generate_subscripts(ws, 1) as i from q),
n as (select lang, count(*) as n from w group by lang),
s as (select lang, w1, lead(w1, 1) over own as w2, lead(w1, 2) over own as w3 from w window own as (partition by pid order by i)),
f as materialized (select lang, 1 as k, w1 as phrase, count(*) as f from s group by all union all select lang, 2, w1 || ' ' || w2, count(*) from s where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from s where w3 is not null group by all),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= 10),
halves as (select *, array_to_string(ws[1:j], ' ') as part, array_to_string(ws[j + 1:], ' ') as rest from (select *, unnest(range(1, k)) as j from c)),
cuts as (select h.*, x.f as l, y.f as r, cast((cast(1000000 as hugeint) * a * a) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from halves h join f x on x.lang = h.lang and x.phrase = h.part join f y on y.lang = h.lang and y.phrase = h.rest),
low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (select lang, phrase, max(a) as most from (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from c where k = 3) group by all),
kept as (select low.* from low left join longer x on x.lang = low.lang and x.phrase = low.phrase and low.k = 2 where x.most is null or 100 * x.most < 50 * low.a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang) where rank <= 2000
"""


@_query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


# The checksum is the usual one of 32 bits, a bit at a time.
SQL["op12_conversation_trie"] = r"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations),
n as (select c, count(*) as n from t group by c),
sums as (select c, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda ch: ord(ch)::bigint)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) as crc from n),
plan as (select s.c, s.crc % 4 as h, s.c - s.c % 20 as head, least(s.crc % 4, coalesce(b.n, 0)) as taken from sums s left join n b on b.c = s.c - s.c % 20),
r as (select p.c, t.pos - p.h + p.taken as d, role, text from plan p join t on t.c = p.c where t.pos > p.h
  union all select p.c, t.pos, role, text from plan p join t on t.c = p.head where t.pos <= p.taken),
k as (select c, d, text, string_agg(sha256(length(role) || ':' || role || text), '') over (partition by c order by d) as key from r
  union all select c, 0, '', '' from plan),
last as (select c, max(d) as d from k group by c),
nodes as (select key, max(k.d) as depth, min(k.c) as conv_id, count(*) as n_convs, len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) as words,
    sha256(coalesce(string_agg(k.c::varchar, ',' order by k.c) filter (last.c is not null), '')) as ends_sha256
  from k left join last on last.c = k.c and last.d = k.d group by key),
kids as (select p.key, count(c.key) as n_children from nodes p left join nodes c on c.depth = p.depth + 1 and starts_with(c.key, p.key) group by p.key),
below as (select a.key, sum(case when k.n_children = 0 then 1 else 0 end) as n_leaves, sum((d.n_convs - 1) * d.words) as saved from nodes a join nodes d on starts_with(d.key, a.key) join kids k on k.key = d.key group by a.key)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join kids using (key) join below using (key) left join nodes p on n.depth > 0 and p.key = left(n.key, (64 * (n.depth - 1))::bigint)
"""


@_query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_copies(table(spark, sf_dir, "documents"))


SQL["op13_minhash_near_dedup"] = SQL["op6_ngram_join"].replace("len(words) < 5", "len(words) < 4").replace("len(words) - 3", "len(words) - 2").replace("i:i + 4", "i:i + 3").replace(">= 75 *", ">= 80 *")
SQL["op13_minhash_near_dedup"] = SQL["op13_minhash_near_dedup"].replace("n_shingles, component_id from g", "n_shingles, component_id, doc_id = component_id as kept from g")
