"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintype.llm.shared import documents


def tokenizer_file() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.kneser_ney import quality

    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.pii import KINDS, count_of, find_personal_data, written

    found = find_personal_data(documents(spark, sf_dir))
    counts = [count_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_file())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.line_dedup import dedup_lines

    done = dedup_lines(documents(spark, sf_dir), least_words=1)
    return done.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), "removed_lines", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.language import identify, train

    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.order_minhash import compare_neighbours

    return compare_neighbours(documents(spark, sf_dir))


#: The contract's rules: host and path, verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.url_rules import judge_urls

    return judge_urls(documents(spark, sf_dir, "pages"), URL_RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.line_quality import quality_rules

    verdicts, _ = quality_rules(documents(spark, sf_dir))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed_words").cast("long").alias("removed_words"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tintype.llm.byte_bpe import round_trip, tokenizer_of_ranks

    return round_trip(documents(spark, sf_dir), tokenizer_of_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.vector_codes import compress

    return compress(documents(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.filter_audit import filter_audit

    return filter_audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op13_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tintype.llm.pivot_index import near_vectors

    return near_vectors(documents(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_URL_RULES_SQL = ", ".join(f"('{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in URL_RULES)

OP8_SQL = f"""with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
 r as (select * from (values {_URL_RULES_SQL}) t(rule, rh, rp, verdict)),
 m as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rh) desc, length(rp) desc) as k from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
 select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m on p.page_id = m.page_id and k = 1"""

OP9_SQL = r"""with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
 w as (select doc_id, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') as ws from d),
 win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as v from w, unnest(range(1, len(ws) - 6)) t(i)),
 rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, v) as c from win) where c > 1),
 cov as (select doc_id, count(distinct i + o) as n from rep, range(8) t(o) group by 1),
 raw as (select doc_id, host, unnest(string_split(text, chr(10))) as line from d),
 dup as (select doc_id, count(*) - count(distinct line) as n from raw where regexp_matches(line, '[^ \t-\r]') group by 1),
 ln as (select doc_id, host, trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g')) as line from raw),
 ok as (select *, length(line) - length(replace(line, ' ', '')) + 1 as words from ln where line <> ''),
 hosts as (select host, count(distinct doc_id) as n from ok group by 1),
 freq as (select host, line from ok join hosts using (host) group by host, line, hosts.n having count(distinct doc_id) > 10 and (count(distinct doc_id) > 0.01::double * hosts.n or count(distinct doc_id) > 1000)),
 lost as (select doc_id, sum(words)::bigint as n from ok join freq using (host, line) group by 1),
 b as (select w.doc_id, len(ws) as n_words, list_sum(list_transform(ws, lambda x: length(x))) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, coalesce(lost.n, 0) as removed_words
   from w join d using (doc_id) left join cov using (doc_id) left join dup using (doc_id) left join lost using (doc_id))
 select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - removed_words >= 0.3::double * n_words as kept from b"""

OP12_SQL = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
 w as (select *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by text) as least from d),
 m as (select doc_id, part, case when len(ws) < 200 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
   || case when 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) then 'C' else '' end
   || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > least then 'E' else '' end as mask from w),
 l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
 c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by 1, 2),
 f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
 o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 p as (select c.*, filter_order, step::int as step, substr(filter_order, step, 1) as f, contains(mask, substr(filter_order, step, 1)) as fails, step > 1 and mask <> '' and regexp_matches(substr(filter_order, 1, step - 1), '[' || mask || '0]') as gone from c, o, range(1, 6) s(step)),
 r as (select part, filter_order, step, f, sum(n) filter (not gone and not fails) as kept, sum(n) filter (not gone and fails) as removed, sum(n) filter (gone and fails) as redundant, sum(n) filter (mask = f) as unique_fails,
   sum(good) filter (not gone and fails) as good_lost, sum(toxic) filter (not gone and fails) as toxic_lost from p group by 1, 2, 3, 4)
 select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, f), 0)::bigint as shapley from r"""


_CODES_START = """e as (select vec_id, label, embedding, len(embedding) // 16 as w from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 p as (select vec_id, label, part, list_transform(embedding[part * w + 1:part * w + w], lambda x: floor(256 * x::double)::bigint) as v from e, range(16) t(part)),
 c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from p qualify entry < 64)"""

_CODES_ASSIGN = """ a{r} as (select vec_id, label, part, any_value(p.v) as v, min(64 * list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint + entry) as k from p join c{r} c using (part) group by 1, 2, 3)"""

_CODES_MOVE = """ s{n} as (select part, k % 64 as entry, i, sum(v[i])::bigint as s, count(*) as n from a{r}, unnest(range(1, len(v) + 1)) t(i) group by 1, 2, 3),
 c{n} as (select c.part, c.entry, coalesce(m.v, c.v) as v from c{r} c left join (select part, entry, list((s - ((s % n) + n) % n) // n order by i) as v from s{n} group by 1, 2) m on m.part = c.part and m.entry = c.entry)"""

OP11_SQL = f"""with {_CODES_START},
{_CODES_ASSIGN.format(r=0)},
{_CODES_MOVE.format(r=0, n=1)},
{_CODES_ASSIGN.format(r=1)},
{_CODES_MOVE.format(r=1, n=2)},
{_CODES_ASSIGN.format(r=2)},
 f as (select vec_id, label, string_agg(lower(printf('%02x', k % 64)), '' order by part) as code, sum(k // 64)::bigint as error from a2 group by 1, 2),
 h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from c2)
 select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from f, h"""

OP13_SQL = """with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
 r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
 c as (select a as vec_id, min(b) as component_id from r group by 1),
 n as (select a as vec_id, count(*) as n from l group by 1)
 select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can answer over whole tables; tests hold the others against brute force."""
    return {"op8_url_filters": OP8_SQL, "op9_quality_rules": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_pivot_index": OP13_SQL}
