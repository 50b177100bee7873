"""The corpus queries: thin digests over the operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.llm import decontaminate, language, lines, media, packing, quality, simhash, substrings, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as lossless WebP images, read back and described."""
    return media.round_trip(table(spark, sf_dir, "documents"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by two Zstandard dictionaries."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "saved_bytes")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are equal or near to an earlier one."""
    found = lines.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", "n_links", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark that every document holds."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    found = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the shortest PPM code."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records into Zstandard archives, and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the regularised quadratic discriminant."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_webp_media": op1_webp_media,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_zstd_toxicity": op3_zstd_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_ppm_language": op8_ppm_language,
    "op9_warc_zstd": op9_warc_zstd,
    "op10_quality_classifier": op10_quality_classifier,
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {1 + 5 * g}, 5))::INTEGER >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

ORACLES: dict[str, str] = {
    "op5_benchmark_decontamination": r"""
        with
        item as (
            select cast(item_id as varchar) as item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from benchmark where item_id is not null),
        win as (
            select item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as phrase
            from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from item where len(w) > 0)),
        doc as (
            select doc_id, row_number() over () as row,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents),
        place as (
            select row, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase
            from (select row, w, unnest(generate_series(1, len(w))) as i from doc) p, (select distinct n from win) s
            where i + n - 1 <= len(w)),
        hit as (select row, i, h.n, item_id from place h join win using (phrase) where h.n = win.n),
        covered as (select row, count(distinct p) as n_hit from (select row, unnest(generate_series(i, i + n - 1)) as p from (select distinct row, i, n from hit)) group by row),
        listed as (select row, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hit group by row),
        token as (select row, unnest(w) as term, unnest(generate_series(1, len(w))) as at from doc),
        often as (select term, count(*) as n from token group by term),
        word as (select phrase, unnest(string_split(phrase, ' ')) as term, unnest(generate_series(1, n)) as place from (select distinct phrase, n from win)),
        rare as (select phrase, term, place, row_number() over (partition by phrase order by n, place) as k from (select phrase, term, min(place) as place from word group by all) join often using (term)),
        pair as (select distinct a.term as a, b.term as b, abs(a.place - b.place) + 2 as reach from rare a join rare b using (phrase) where a.k = 1 and b.k = 2
                 and phrase not in (select phrase from word where term not in (select term from often))),
        close as (select row, count(*) as n_near from (select distinct x.row, a, b, reach, x.at from pair join token x on x.term = a join token y on y.term = b and y.row = x.row and abs(y.at - x.at) <= reach) group by row)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
        from doc left join covered using (row) left join listed using (row) left join close using (row)""",
    "op6_substring_dedup": r"""
        with
        doc as (select doc_id, row_number() over () as row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select row, doc_id, i, array_to_string(w[i : i + 49], ' ') as phrase from (select row, doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from doc where len(w) >= 50)),
        late as (select row, i from (select row, i, doc_id, min(doc_id) over (partition by phrase) as lo from win) where lo < doc_id),
        gone as (select distinct row, unnest(generate_series(i, i + 49)) as p from late),
        cut as (select row, count(*) as n, list(p) as ps from gone group by row)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
               sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, j : not list_contains(ps, j)) end, ' ')) as kept_sha256
        from doc left join cut using (row)""",
    "op9_warc_zstd": f"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha, min(page_id) over (partition by coalesce(html, '')) as first from pages)
        select page_id, octet_length(encode(html))::bigint as payload_bytes, {_BASE32} as payload_digest,
               case when page_id > first then 'revisit' else 'response' end as record_type,
               case when page_id > first then first end as refers_to
        from p""",
}
