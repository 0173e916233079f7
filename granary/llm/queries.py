"""One query per operator over its whole table, and its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold_of, table


#: Documents per batch between Spark and Python; some are long.
BATCH_DOCUMENTS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for a session that sends them to Python in batches of ``BATCH_DOCUMENTS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCUMENTS))
    return table(spark, sf_dir, "documents")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.toxicity import FOLDS, fit_toxicity, score_toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out=0)
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_small_world_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.hnsw import build_index, nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 100 = 0"), build_index(vectors), k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.line_dedup import dedup_lines

    docs = documents(spark, sf_dir)
    out = dedup_lines(docs, min_docs=10, keep_first=False, min_chars=1)
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP3_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), frequent as (
    select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
), marked as (
    select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quality import FOLDS, fit_quality, score_quality

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), held_out=2)
    return score_quality(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.chat import formatted_chats, masked_text

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(
        "select cast(-7 as bigint) as conv_id, cast(turn as bigint) as turn, role, '</s>[INST] ok [/INST]' as text "
        "from values (0, 'user'), (1, 'assistant') as t(turn, role)"
    )
    chats = formatted_chats(turns.unionByName(planted))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("mask"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
    select *,
        case role when 'user' then length('[INST]  [/INST]') when 'assistant' then length(' </s>')
            else length('[ROLE]') + length(role) + 1 + length('[/ROLE]') end as marks,
        regexp_matches(role || ' ' || text, '<s>|</s>|\[/?INST\]|\[/?ROLE\]')
            or regexp_matches(text, '\\(?s:.)') or regexp_matches(role, '\\(?s:.)|\n') as conflict,
        len(regexp_extract_all(text, '<s>|</s>|\[/?INST\]|\[/?ROLE\]|\\')) as escapes
    from turns
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    3 + sum(marks + length(text) + case when conflict then escapes else 0 end) as formatted_chars
from sized group by conv_id
"""


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.line_crf import apply_rules, fit_line_crf

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_line_crf(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mixed_documents

    docs = documents(spark, sf_dir)
    return mixed_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.token_orc import token_index, tokens_written

    return token_index(spark, tokens_written(documents(spark, sf_dir)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.bpe import decoded, encode_documents

    ids = encode_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return ids.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded()("ids"), 256).alias("decoded_sha256"),
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.ngram_join import jaccard_classes

    classes = jaccard_classes(documents(spark, sf_dir))
    id_of = lambda null, i: F.when(~F.col(null), F.col(i))
    return classes.select(id_of("_k_null", "_k_id").alias("doc_id"), id_of("keep_null", "keep_id").alias("class_id"), "n_links")


OP10_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sets as (
    select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as print from grams group by doc_id
), classes as (
    select print, min(doc_id) as rep, any_value(n) as n, count(*) as copies from sets group by print
), rep_grams as (
    select g.doc_id as rep, g.g from grams g join classes c on g.doc_id = c.rep
), common as (
    select a.rep as a, b.rep as b, count(*) as shared
    from rep_grams a join rep_grams b on a.g = b.g and a.rep < b.rep group by all
), links as (
    select a, b from common join classes x on x.rep = a join classes y on y.rep = b
    where shared * 5 >= 4 * (x.n + y.n - shared)
), sides as (
    select a, b from links union all select b, a from links
), reach as (
    select rep as node, rep as root from classes
    union select s.b, r.root from reach r join sides s on s.a = r.node
), roots as (
    select node, min(root) as root from reach group by node
), linked as (
    select s.a as rep, sum(c.copies) as linked from sides s join classes c on c.rep = s.b group by s.a
)
select d.doc_id, coalesce(r.root, d.doc_id) as class_id, coalesce(c.copies - 1 + coalesce(l.linked, 0), 0) as n_links
from documents d left join sets s on s.doc_id = d.doc_id left join classes c on c.print = s.print
left join roots r on r.node = c.rep left join linked l on l.rep = c.rep
"""



def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.trie import fingerprinted, prefix_trie, rebuilt

    steps, lengths = rebuilt(fingerprinted(table(spark, sf_dir, "conversations")))
    return prefix_trie(steps, lengths).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


OP11_SQL = r"""
with recursive said as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first) as pos
    from conversations where conv_id is not null
), bytes as (
    select range as b from range(256)
), shifted as (
    select b, 0 as k, b as v from bytes
    union all select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from shifted where k < 8
), crc_table as (
    select b, v from shifted where k = 8
), digits as (
    select conv_id, conv_id::varchar as told, 0 as i, 4294967295::bigint as crc from (select distinct conv_id from said)
    union all
    select d.conv_id, d.told, d.i + 1, xor(d.crc // 256, t.v)
    from digits d join crc_table t on t.b = xor(d.crc % 256, ascii(substr(d.told, d.i + 1, 1))) where d.i < length(d.told)
), convs as (
    select conv_id, xor(crc, 4294967295) % 4 as h, conv_id - conv_id % 20 as base from digits where i = length(told)
), turns as (
    select c.conv_id, s.pos, 0 as side, s.role, s.text from convs c join said s on s.conv_id = c.base and s.pos <= c.h
    union all select c.conv_id, s.pos, 1, s.role, s.text from convs c join said s on s.conv_id = c.conv_id and s.pos > c.h
), rebuilt as (
    select conv_id, role, text, row_number() over (partition by conv_id order by side, pos) as depth,
        sha256(role) || sha256(text) as told
    from turns
), prefixes as (
    select conv_id, depth, string_agg(told, '') over (partition by conv_id order by depth) as key,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
    from rebuilt
    union all select conv_id, 0, '', 0 from convs
), nodes as (
    select depth, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from prefixes group by all
), lasts as (
    select conv_id, max(depth) as depth from prefixes group by conv_id
), ends as (
    select key, string_agg(conv_id::varchar, ',' order by conv_id) as ids from prefixes semi join lasts using (conv_id, depth) group by key
), children as (
    select left(key, length(key) - 128) as key, count(*) as n from nodes where depth > 0 group by 1
), below as (
    select p.key, sum((n.n_convs - 1) * n.words) as saved, count(*) filter (c.n is null) as leaves
    from nodes n join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth left join children c on c.key = n.key group by p.key
)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
    b.leaves as n_leaves, b.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join below b on b.key = n.key left join children c on c.key = n.key left join ends e on e.key = n.key
left join nodes up on n.depth > 0 and up.key = left(n.key, length(n.key) - 128)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors.where("vec_id % 50 = 0"), vectors)


OP12_SQL = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id, b.label = a.label as same, list_dot_product(a.v, b.v)::bigint as score
    from rows a join rows b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, p.positive_score, n.vec_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
    and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify rank <= 3
"""


def op13_largest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.topk import largest_products

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return largest_products(vectors.where("vec_id % 100 = 0"), vectors)


OP13_SQL = """
with rows as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)
select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score,
    row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id) as rank
from rows q join rows c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
where q.vec_id % 100 = 0
qualify rank <= 10
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_small_world_search": op2_small_world_search,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_token_orc": op6_token_orc,
    "op7_line_quality": op7_line_quality,
    "op8_source_mix": op8_source_mix,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_largest_products": op13_largest_products,
}
ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op10_ngram_jaccard": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_largest_products": OP13_SQL,
}
