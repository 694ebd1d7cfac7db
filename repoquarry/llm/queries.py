"""One registered query for each operator, with production parameters over its whole table, and the DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm import (
    exact_dedup,
    extraction,
    languages,
    lexical,
    line_dedup,
    near_dedup,
    nearest,
    packing,
    phrases,
    sentence_pieces,
    substring_dedup,
    token_counts,
    toxicity,
)

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
NEAREST_FACTOR = 1.0
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(_documents(spark, sf_dir), PIECE_MODEL)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = sentence_pieces.piece_counts(_documents(spark, sf_dir).select("text"), PIECE_MODEL).select("n_tokens")
    return token_counts.context_totals(token_counts.length_histogram(lengths))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model, score="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, F.col("vec_id") % 100 == 0, k=10, factor=NEAREST_FACTOR)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "n_shingles")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(_documents(spark, sf_dir).select("doc_id", "text"))
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(spaced, 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), WORD_TOKENIZER, capacity=4096, end_id=1)


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    tagged = languages.tag_languages(docs.select("doc_id", "text"), languages.learn(docs), with_spans=False)
    return tagged.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir).select("text", "lang"), min_count=100, longest=5, top=2000)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_documents(spark, sf_dir).select("doc_id", "text"))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extraction.extract_text(pages, extraction.learn(pages)).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_nearest": op5_nearest,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_languages": op10_languages,
    "op11_phrases": op11_phrases,
    "op12_search": op12_search,
    "op13_main_text": op13_main_text,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        with lines as (
          select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
          from documents),
        keyed as (
          select *, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
          from lines),
        owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key),
        judged as (select k.*, coalesce(o.owner < k.doc_id, false) as dropped from keyed k left join owners o using (key))
        select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
        from judged group by doc_id""",
    "op6_exact_dedup": """
        with normal as (
          select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        groups as (select text, max(doc_id) as keep_id, count(*) as group_size from normal group by text)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256 from normal join groups using (text)""",
    "op11_phrases": r"""
        with pieces as (
          select doc_id, coalesce(lang,'und') as lang, unnest(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        grams as (select lang, m, array_to_string(w[i:i+m-1], ' ') as phrase, count(*) as f
          from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from split, range(1, 6) sizes(m) where len(w) >= m) group by all),
        often as (select * from grams where f >= 100),
        totals as (select lang, sum(f)::bigint as n from grams where m = 1 group by lang),
        split_often as (select *, string_split(phrase, ' ') as w from often),
        cuts as (
          select c.lang, c.phrase, c.f as a, k, p.f as l, s.f as r, n, ((1000::hugeint * c.f * n) // (p.f::hugeint * s.f))::bigint as score
          from (select *, unnest(range(1, m)) as k from split_often where m > 1) c
          join often p on p.lang = c.lang and p.phrase = array_to_string(c.w[1:k], ' ') and p.m = k
          join often s on s.lang = c.lang and s.phrase = array_to_string(c.w[k+1:], ' ') and s.m = c.m - k
          join totals t on t.lang = c.lang),
        lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        kept as (
          select * from lowest x where not exists (
            select 1 from often y where y.lang = x.lang and y.f >= x.a and len(string_split(y.phrase,' ')) > len(string_split(x.phrase,' '))
              and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
        select lang, rank, phrase, a, l, r, n, score from (
          select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000""",
    "op12_search": r"""
        with found as (
          select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        postings as (select doc_id, term, count(*) as tf from found group by all),
        lengths as (select doc_id, count(*) as n from found group by all),
        totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
        asked as (
          select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, totals group by term, docs),
        scores as (
          select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
          from asked join postings using (term) join weights using (term) join lengths using (doc_id), totals group by all)
        select item_id, rank, doc_id, score from (
          select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10""",
}
