"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import fresh_dir
from . import decontaminate, jaccard, language, pieces, products, quality, quotes, records, repeats, sharding, trie, urls, whitening
from .arrow import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int, one: int) -> Column:
    """Whether a row is in a fold by the checksum of its key; a null key is in none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == one, F.lit(False))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts take the source and language of their smallest pair, so that they lie side by side."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.struct("source", "lang").alias("kind"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"),
    )
    docs = sharding.with_kind_of_group(docs, "text_sha256", "kind")
    cells = {
        "source_cell": sharding.by_hash(F.col("kind.source")),
        "lang_cell": sharding.by_hash(F.col("kind.lang")),
        "size_cell": sharding.by_magnitude(F.col("size")),
    }
    sharded = sharding.shards_by_curve(docs, cells, 24, ["text_sha256", "doc_id", "size"])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert", *cells,
    )


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5, 0)
    model = quality.learn(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a given rule decides are the labelled ones."""
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query
def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = F.transform("removed", lambda s: (s["end"] - s["start"]).cast("long"))
    return repeats.remove_repeats(docs, drop=("text",)).select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def with_replies(messages: DataFrame) -> DataFrame:
    """The messages, and one more at the end of each conversation that quotes its first or second turn.

    The table holds no quote marks.  By the conversation's number the reply quotes all lines, the first line, or the
    first two of three or more.
    """
    lines = F.split("text", "\n")
    kind = F.col("conv_id") % 3
    some = F.when(kind == 1, F.slice(lines, 1, 1)).when((kind == 2) & (F.size(lines) > 2), F.slice(lines, 1, 2)).otherwise(lines)
    quoted = F.array_join(F.transform(some, lambda x: F.concat(F.lit("> "), x)), "\n")
    replies = messages.filter((F.col("turn") == F.col("conv_id") % 2) & (F.col("text") != "")).select(
        "conv_id", F.lit(1_000_000).cast("long").alias("turn"), F.lit("user").alias("role"),
        F.concat(quoted, F.lit("\nAn answer in conversation "), F.col("conv_id").cast("string"), F.lit(".")).alias("text"),
    )
    return messages.unionByName(replies)


@query
def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return quotes.link_quotes(with_replies(messages))


ORACLES["op5_quotation_links"] = r"""
with given as (
    select conv_id, turn, role, replace(coalesce(text, ''), chr(13), '') as text,
           row_number() over (partition by conv_id order by turn, role, text) - 1 as place,
           count(*) over (partition by conv_id) as n
    from conversations
), unit as (
    select conv_id, place, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) as body
    from (select conv_id, place, unnest(list_concat([text], string_split(text, chr(10)), string_split(text, chr(10) || chr(10)))) as x from given)
), reply as (
    select conv_id, n as place, case when conv_id % 3 = 1 then l[1:1] when conv_id % 3 = 2 and len(l) > 2 then l[1:2] else l end as lines
    from (select *, string_split(text, chr(10)) as l from given) where turn = conv_id % 2 and text <> ''
), part as (
    select conv_id, place, 0 as rank, array_to_string(lines, ' ') as x from reply
    union all
    select conv_id, place, 1, unnest(lines) from reply
), found as (
    select p.conv_id, p.place, p.rank, length(p.body) as size, min(u.place) as source
    from (select conv_id, place, rank, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) as body from part) p
    join unit u on u.conv_id = p.conv_id and u.body = p.body and u.place < p.place
    where p.body <> '' group by p.conv_id, p.place, p.rank, p.body
), link as (
    select conv_id, place, arg_min(source, (rank, -size, source)) as source from found group by 1, 2
), message as (
    select conv_id, turn, role, text, place, 0 as n_quotes, cast(null as bigint) as source, place as depth from given
    union all
    select reply.conv_id, 1000000, 'user', concat('An answer in conversation ', reply.conv_id, '.'), reply.place, 1, source, coalesce(source + 1, reply.place)
    from reply left join link on link.conv_id = reply.conv_id
)
select conv_id, turn, role, trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' ') as text, place, cast(n_quotes as bigint) as n_quotes,
       cast((source is not null) as bigint) as n_linked, case when place > 0 then conv_id end as parent_conversation,
       case when place > 0 then coalesce(source, place - 1) end as parent_place, source is not null as by_quote, conv_id as thread, depth,
       row_number() over (partition by conv_id order by depth, place) - 1 as reply_order
from message
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_phrases(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op6_decontamination"] = rf"""
with doc as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), item as (
    select coalesce(cast(item_id as varchar), '') as item,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), phrase as (
    select distinct item, least(len(w), 10) as size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as words
    from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from item where len(w) > 0)
), place as (
    select doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') as words
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from doc, (select distinct size from phrase) where len(w) >= size)
), found as (
    select doc_id, k, place.size, item from place join phrase on place.size = phrase.size and place.words = phrase.words
), hit as (
    select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(k, k + size)) as word from found) group by 1
), named as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by 1
)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit on hit.doc_id = doc.doc_id left join named on named.doc_id = doc.doc_id
"""


@query
def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", products.quantised("embedding").alias("whole"))
    found = products.top_products(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "whole")
    return found.select("query_id", "rank", "vec_id", "score")


ORACLES["op7_top_products"] = """
with whole as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id,
           cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from whole q join whole c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5
"""


@query
def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")))


def piece_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4, 2)
    model = language.learn(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op10_jaccard_join"] = rf"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
    select doc_id, list_distinct(case when len(w) = 0 then cast([] as varchar[]) when len(w) < 3 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) end) as s
    from words
), parts as (
    select doc_id, len(s) as n, unnest(s) as g from sets
), links as (
    select a.doc_id as a, b.doc_id as b from parts a join parts b on a.g = b.g and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(doc, other) as (
    select doc_id, doc_id from sets union select reach.doc, links.b from reach join links on links.a = reach.other
)
select doc_id, cast(len(s) as bigint) as n_shingles, least_id as component_id
from sets join (select doc, min(other) as least_id from reach group by 1) r on r.doc = doc_id
"""


@query
def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records.in_key_order(table(spark, sf_dir, "documents"))
    out = fresh_dir(spark, "records")
    records.write_texts(docs, out, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return records.read_records(spark, out).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"), "position"
    )


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of a block of twenty begin like the first of them, for as many turns as their number's checksum says."""
    turns = trie.numbered_turns(table(spark, sf_dir, "conversations"))
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return trie.prefix_trie(*trie.with_shared_start(turns, 20, shared, 3))


ORACLES["op13_prefix_trie"] = r"""
with bytes as (
    select list_transform(range(256), lambda b: list_reduce(
        list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as bigint)) else c >> 1 end)) as t
), turns as (
    select conv_id as c, sha256(concat(cast(length(r) as varchar), ':', r, t)) as digest, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words,
           row_number() over (partition by conv_id order by turn nulls first, sha256(concat(cast(length(r) as varchar), ':', r, t))) as place
    from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null)
), ids as (
    select c, c - c % 20 as base, xor(list_reduce(
        list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ord(x) as bigint))),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), cast(4294967295 as bigint)) % 4 as h
    from (select distinct c from turns), bytes
), rebuilt as (
    select ids.c, place, digest, words from ids join turns on turns.c = base and place <= h
    union all
    select ids.c, place - h + least(h, coalesce(n, 0)), digest, words
    from ids join turns on turns.c = ids.c and place > h left join (select c, count(*) as n from turns group by 1) l on l.c = base
), lists as (
    select ids.c, list(digest order by place) filter (where place is not null) as s, list(words order by place) filter (where place is not null) as w
    from ids left join rebuilt on rebuilt.c = ids.c group by 1
), members as (
    select c, d, coalesce(len(s), 0) as n, array_to_string(s[1:d], ',') as p, case when d > 0 then w[d] else 0 end as words,
           case when d > 0 then array_to_string(s[1 : d - 1], ',') end as up, coalesce(s, []) as s
    from (select *, unnest(range(0, coalesce(len(s), 0) + 1)) as d from lists)
), nodes as (
    select coalesce(p, '') as p, d, any_value(up) as up, any_value(s) as s, min(c) as conv_id, count(*) as n_convs, max(words) as words,
           max(n) > d as inner_node, string_agg(cast(c as varchar), ',' order by c) filter (where n = d) as ends
    from members group by 1, 2
), above as (
    select coalesce(array_to_string(s[1:e], ','), '') as p, e as d, sum((n_convs - 1) * words) as saved, count(*) filter (where not inner_node) as leaves
    from (select *, unnest(range(0, d + 1)) as e from nodes) group by 1, 2
), children as (
    select coalesce(up, '') as p, d - 1 as d, count(*) as n from nodes where d > 0 group by 1, 2
)
select nodes.conv_id, cast(nodes.d as bigint) as depth, parent.conv_id as parent_conv_id, cast(nodes.n_convs as bigint) as n_convs,
       cast(coalesce(children.n, 0) as bigint) as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens,
       sha256(coalesce(nodes.ends, '')) as ends_sha256
from nodes join above on above.p = nodes.p and above.d = nodes.d
left join children on children.p = nodes.p and children.d = nodes.d
left join nodes parent on parent.p = coalesce(nodes.up, '') and parent.d = nodes.d - 1
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long; ``deviation_exact`` has it then."""
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation_exact", F.col("deviation").cast("string")).withColumn(
        "deviation", F.col("deviation").try_cast("long")
    )
