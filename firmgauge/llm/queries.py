"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgauge.llm import (
    bpe, classifier, exact_dedup, extraction, jaccard, licenses, line_dedup, lm, mixing, prefix_trie, quality, spelling, urls,
)
from firmgauge.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, found in it or inherited.

    The tables name no paths: a document is the file source/lang/group/doc_id, with a hundred ids in a group.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    group = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none"))
    path = F.concat_ws("/", part("source"), part("lang"), group, part("doc_id"))
    docs = table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan_files(docs).select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "found_by", "licence_dir")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and their way back, as digests."""
    lines = bpe.read_lines(public_tokenizers.path(RANKS))
    ids = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), lines, public_tokenizers.PATTERN,
                     keep=["doc_id"], apart_at_spaces=True)
    return bpe.decode(ids, lines).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality(table(spark, folder, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near copies of every document."""
    return jaccard.near_duplicates(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.exact_groups(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(table(spark, folder, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return classifier.score(table(spark, folder, "documents"), table(spark, folder, "labels")).withColumnRenamed("id", "doc_id")


#: Targets by level; sources are weighted alike.
MIX = mixing.Mix(budget=0.8, epochs=2, weights={
    "domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}})


def with_domain(docs: DataFrame) -> DataFrame:
    """The tables name no domain: three groups of sources stand for domains."""
    return docs.withColumn("domain", F.concat(F.lit("domain"), F.crc32(F.coalesce("source", F.lit(""))) % 3))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often every document is taken, by domain, language and source."""
    docs = with_domain(table(spark, folder, "documents"))
    return mixing.mix_documents(docs, ["domain", "lang", "source"], MIX, keep=["doc_id", "domain", "lang", "source"])


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return line_dedup.dedup_lines(table(spark, folder, "documents"), keep=["doc_id"])


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents with the form that they are a variant of."""
    return spelling.variants(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document."""
    return lm.score(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


#: CRC-32 of UTF-8 bytes by its table of 256 entries, which is built by the rule.
CRC_SQL = """
create_table as (
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: 0::ubigint)),
        lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end)) as crc_table
)"""


def crc_sql(bytes_: str) -> str:
    """SQL of the CRC-32 of a list of bytes, beside ``create_table``."""
    return (f"xor(list_reduce(list_prepend(4294967295::ubigint, {bytes_}), "
            "lambda c, b: xor(c // 256, crc_table[(xor(c, b) % 256)::int + 1])), 4294967295::ubigint)")


OP11_SQL = f"""
with recursive {CRC_SQL},
runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
    from documents
),
counted as (select doc_id, run, count(*) as k from runs group by all),
hashed as (
    select run, k, {crc_sql("""flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda ch:
        case when ord(ch) < 128 then [ord(ch)::ubigint] else [(192 + ord(ch) // 64)::ubigint, (128 + ord(ch) % 64)::ubigint] end))""")} as h
    from counted, create_table
),
slipped as (
    select k, case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
    from hashed
),
words as (select word, sum(k)::bigint as n from slipped where length(word) >= 6 group by word having sum(k) >= 5),
holes as (
    select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
    from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
),
near as (
    select a.word, b.word as near, b.n as near_n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from holes a join words b on a.rest = b.word
    union select b.word, a.word, a.n from holes a join words b on a.rest = b.word
),
best as (select word, count(*) as n_near, max(near_n) as top from near group by word),
forms as (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.top >= 5 * w.n then b.top end as form_n,
           case when b.top >= 5 * w.n then (select min(near) from near x where x.word = w.word and x.near_n = b.top) end as form
    from words w left join best b on b.word = w.word
),
chain as (
    select word, word as at from forms
    union all select c.word, f.form from chain c join forms f on f.word = c.at where f.form is not null
)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n
from forms f join chain c on c.word = f.word join forms e on e.word = c.at and e.form is null
"""

OP12_SQL = f"""
with {CRC_SQL},
turns as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i,
           coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
),
heads as (select c, {crc_sql("list_transform(string_split(c::varchar, ''), lambda ch: ord(ch)::ubigint)")} % 6 as h
          from (select distinct c from turns), create_table),
rebuilt as (
    select heads.c, t.i, t.role, t.text from heads join turns t on t.c = heads.c - heads.c % 100 and t.i < heads.h
    union all select heads.c, t.i, t.role, t.text from heads join turns t on t.c = heads.c and t.i >= heads.h
),
placed as (
    select c, row_number() over (partition by c order by i) as depth, length(text) as chars,
           sha256(length(role)::varchar || ':' || role || text) as said
    from rebuilt
),
paths as (
    select c, depth, chars, sha256(string_agg(said, ',') over (partition by c order by depth rows unbounded preceding)) as k from placed
    union all select c, 0, 0, '' from heads
),
linked as (
    select *, lag(k) over (partition by c order by depth) as parent, depth = max(depth) over (partition by c) as last from paths
),
nodes as (
    select depth, k, any_value(parent) as parent, any_value(chars) as chars, min(c) as conv_id, count(*) as n_convs,
           sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends_sha256
    from linked group by depth, k
),
family as (
    select n.*, (select count(*) from nodes x where x.depth = n.depth + 1 and x.parent = n.k) as n_children from nodes n
),
subtrees as (
    select p.depth, p.k, sum((f.n_convs - 1) * f.chars)::bigint as saved_tokens, count(*) filter (f.n_children = 0) as n_leaves
    from family f join paths p on p.c = f.conv_id and p.depth <= f.depth group by all
)
select f.conv_id, f.depth::bigint as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
from family f join subtrees s on s.depth = f.depth and s.k = f.k
left join nodes up on up.depth = f.depth - 1 and up.k = f.parent
"""

OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from d),
u as (
    select *, regexp_split_to_array(core, '[\x20\x09-\x0D]+') as words
    from (select distinct line, text, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as core from l) where core <> ''
),
leaved as (
    select line, text, words, len(words) || ' ' || array_to_string(
        list_transform(words[1:3], lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end), ' ') as leaf from u
),
often as (select line from leaved group by line having count(distinct text) >= 3),
busy as (select leaf from leaved group by leaf having count(distinct text) >= 3),
tokens as (
    select leaf, line, text, unnest(words) as word, generate_subscripts(words, 1) as place
    from leaved where len(words) >= 3 and leaf in (select leaf from busy)
),
constants as (select leaf, place, word from tokens group by all having count(distinct text) >= 3),
templates as (
    select t.leaf, t.line, t.text, string_agg(coalesce(c.word, '<*>'), ' ' order by t.place) as template
    from tokens t left join constants c using (leaf, place, word) group by t.leaf, t.line, t.text having count(c.word) >= 0.7 * count(*)
),
recurring as (select leaf, template from templates group by all having count(distinct text) >= 3),
gone as (select line from often union select line from templates join recurring using (leaf, template))
select d.doc_id, coalesce(string_agg(l.line, chr(10) order by l.no) filter (l.line not in (select line from gone)), '') as text,
       count(*) as n_lines, count(*) filter (l.line in (select line from gone)) as n_dropped
from d join l using (r) group by d.r, d.doc_id
"""

OP6_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_bpe": op2_bpe,
    "op3_urls": op3_urls,
    "op4_quality": op4_quality,
    "op5_jaccard": op5_jaccard,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_extraction": op7_extraction,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_classifier": op10_classifier,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scoring": op13_lm_scoring,
}
ORACLES: dict[str, str] = {
    "op6_exact_dedup": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_spelling": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
