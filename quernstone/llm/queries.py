"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, exact_dedup, langid, minhash, negatives, quality, secrets, spelling, token_count, toxicity, warc
from .common import is_held_out, spread, table


def captures(pages: DataFrame) -> DataFrame:
    """Captures of an archive, from the pages: each page was fetched, and asked for again later.

    A page's fetch is a full response. The later request is a revisit: most carry the entity tag that
    the fetch had, some only its date, a few an outdated tag or nothing.
    """
    p, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 365).cast("int")), "yyyy-MM-dd")
    known = pages.select(
        "page_id", "url",
        F.when(p % 3 != 0, tag).alias("tag"),
        day.alias("day"),
        F.sha2("html", 256).alias("digest"),
        F.length("html").cast("string").alias("size"),
    )
    full = known.select(
        (p * 2).alias("record_id"), "url", (p * 2).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"),
        F.col("day").alias("last_modified"), "digest", headers(("content-type", F.lit("text/html")), ("content-length", F.col("size")), ("date", (p * 2).cast("string")), ("etag", F.col("tag"))),
    )
    asked = (
        F.when(p % 11 == 0, F.lit(None))
        .when(p % 13 == 0, F.lit('"outdated"'))
        .when(p % 5 == 0, F.concat(F.lit("W/"), F.col("tag")))
        .otherwise(F.col("tag"))
    )
    again = known.withColumn("asked", asked).withColumn("then", p * 2 + 1 + (p % 7) * 1000).select(
        (p * 2 + 1).alias("record_id"), "url", F.col("then").alias("ts"), F.lit("revisit").alias("kind"), F.col("asked").alias("etag"),
        F.when(p % 11 != 0, F.col("day")).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        headers(("cache-control", F.lit("max-age=60")), ("content-length", F.lit("0")), ("date", F.col("then").cast("string")), ("etag", F.col("asked"))),
    )
    return full.unionByName(again)


def headers(*fields: tuple[str, Column]) -> Column:
    """A map of the fields that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("headers")


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat_ws(": ", x["key"], x["value"]))
    return found.select("record_id", "canonical", "ts", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "status", "digest", F.array_join(lines, "\n").alias("header_text"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~is_held_out("doc_id"))
    model = quality.fit(docs, labels)
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(docs, ranks, pattern, keep=["doc_id"])
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.read_back(chat.format_turns(turns.select(*planted.columns).unionByName(planted), ranks, pattern), ranks, pattern)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep=["doc_id"])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=3, percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    filters = langid.train(docs.filter(~is_held_out("doc_id")))
    found = langid.predict(docs.select("doc_id", "text"), filters, keep=["doc_id"])
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(spelling.count_words(docs, damage=199))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spread(table(spark, sf_dir, "embeddings")).withColumn("label", noisy))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisit_resolution": op1_revisit_resolution,
    "op2_compression_quality": op2_compression_quality,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op4_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window w as (partition by coalesce(text, ''))
    """,
    "op5_chat_format": r"""
        with t as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e as (
          select *, row_number() over (partition by conv_id order by turn, role, sha256(text)) as pos,
            len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*TEXT\]|\[\\*/TEXT\]')) as marks
          from t
        )
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
          cast(3 + sum(length(text) + marks + case role when 'user' then 13 when 'assistant' then 4 when 'system' then 15
            else 19 + length(role) end) as bigint) as formatted_chars
        from e group by conv_id
    """,
    "op1_revisit_resolution": r"""
        with u as (
          select page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?@]*@', '') as u,
                 case when page_id % 3 <> 0 then '"' || md5(html) || '"' end as tag,
                 strftime(date '2024-01-01' + cast(page_id % 365 as integer), '%Y-%m-%d') as day,
                 sha256(html) as digest, length(html) as size
          from pages
        ), c as (
          select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') ||
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
              substr(u, length(regexp_extract(u, '^[^/?]*')) + 1),
              '([?&])(utm_[a-z]+|ref|gclid|fbclid|sessionid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') as canonical
          from u
        ), resp as (
          select page_id * 2 as response_id, page_id * 2 as ts, canonical, tag, day, digest, size from c
        ), rev as (
          select page_id * 2 + 1 as record_id, page_id * 2 + 1 + (page_id % 7) * 1000 as ts, canonical,
            case when page_id % 11 = 0 then null when page_id % 13 = 0 then '"outdated"' when page_id % 5 = 0 then 'W/' || tag else tag end as asked,
            case when page_id % 11 <> 0 then day end as day
          from c
        ), m as (
          select v.record_id, v.canonical, v.ts, r.response_id, v.asked, r.tag, r.digest as d, r.size,
            case when r.response_id is null then 'no_response'
                 when v.asked is not null and r.tag is not null then case when regexp_replace(v.asked, '^W/', '') = r.tag then 'resolved' else 'validator_mismatch' end
                 when v.day is not null and r.day is not null then case when v.day = r.day then 'resolved' else 'validator_mismatch' end
                 else 'no_validator' end as status
          from rev v asof left join resp r on v.canonical = r.canonical and v.ts > r.ts
        )
        select record_id, canonical, ts, coalesce(response_id, -1) as response_id, status, case when status = 'resolved' then d end as digest,
          case when status = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html'
            || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || coalesce(asked, tag), '') end as header_text
        from m
    """,
    "op8_decontamination": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bi as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0),
        win as (select distinct cast(item_id as varchar) as item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as words from bi),
        di as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n),
        occ as (select doc_id, i, di.n, item from di join win on win.n = di.n and array_to_string(w[i : i + di.n - 1], ' ') = words),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by 1),
        it as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from occ group by 1)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join it using (doc_id)
    """,
    "op9_minhash_near_dedup": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
          when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from d),
        n as (select doc_id, count(*) as n from s group by 1),
        c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
        e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
        g as (select a, b from e union all select b, a from e),
        r(a, b) as (select doc_id, doc_id from d union select r.a, g.b from r join g on r.b = g.a),
        m as (select a as doc_id, min(b) as component_id from r group by 1)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)
    """,
    "op12_spelling_variants": r"""
        with recursive r as (
          select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as w
          from documents
        ), c as (
          select coalesce(cast(doc_id as varchar), '') || ':' || w as s, w, count(*) as k from r where length(w) >= 6 group by all
        ), bytes as (
          select w, k, list_transform(range(1, 2 * octet_length(encode(s)), 2), lambda i: cast(('0x' || substr(hex(encode(s)), i, 2)) as bigint)) as b from c
        ), h as (
          -- crc32, half a byte at a time; t has the remainders of the 16 half bytes
          select w, k, xor(4294967295, list_reduce(b, lambda a, x:
            xor(xor(xor(a, x) >> 4, t[(xor(a, x) & 15) + 1]) >> 4, t[(xor(xor(a, x) >> 4, t[(xor(a, x) & 15) + 1]) & 15) + 1]), 4294967295)) as h
          from bytes, (select [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
            3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] as t)
        ), e as (
          select case when h % 199 = 0 then substr(w, 1, cast(h % length(w) as bigint)) || substr(w, cast(h % length(w) as bigint) + 2) else w end as word, k from h
        ), words as (
          select word, cast(sum(k) as bigint) as n from e where length(word) >= 6 group by 1 having sum(k) >= 5
        ), holed as (
          select word, i, substr(word, 1, i - 1) || ' ' || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as rest
          from (select word, unnest(range(1, length(word) + 1)) as i from words)
        ), near as (
          select a.word, b.word as other from holed a join holed b on a.hole = b.hole and a.word <> b.word
          union select a.word, b.word from holed a join words b on a.rest = b.word
          union select b.word, a.word from holed a join words b on a.rest = b.word
        ), best as (
          select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m
          from (select near.word, other, words.n as m from near join words on words.word = other) group by 1
        ), forms as (
          select word, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then other end as form, case when m >= 5 * n then m end as form_n
          from words left join best using (word)
        ), walk(word, reached) as (
          select word, word from forms union all select walk.word, f.form from walk join forms f on f.word = reached where f.form is not null
        ), ends as (select walk.word, reached as root from walk join forms f on f.word = reached where f.form is null)
        select word, form, root, n, n_near, form_n from forms join ends using (word)
    """,
    "op13_hard_negatives": """
        with e as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                 list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
          from embeddings
          where label is not null and embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
          select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
          from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
        ), p as (
          select anchor_id, other as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
        )
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other) as rank,
               other as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 3
    """,
}
