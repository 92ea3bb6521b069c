"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, collocations, line_dedup, packing, periodic_runs, quality, secrets, sharding, simhash, substring_dedup, suffix_dedup, tiff, toxicity
from tidemark.llm.common import documents
from tidemark.plans.registry import Query


def labels(spark: SparkSession, data_dir: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/labels.parquet")


def op1_bpe(spark: SparkSession, data_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(documents(spark, data_dir)))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    return secrets.counts_and_spans(secrets.find_secrets(documents(spark, data_dir)))


def op3_toxicity(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = documents(spark, data_dir)
    return toxicity.score(docs, toxicity.learn(docs, labels(spark, data_dir)))


def op4_quality_rules(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = documents(spark, data_dir)
    return quality.judge(docs, quality.learn_rules(docs, labels(spark, data_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op5_suffix_array_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return suffix_dedup.shared_passages(documents(spark, data_dir)).select(
        "doc_id", "start", "end", "n_words", F.sha2("passage", 256).alias("passage_sha256")
    )


def op6_tiff(spark: SparkSession, data_dir: str) -> DataFrame:
    stored = tiff.text_images(documents(spark, data_dir))
    return tiff.read_pages(stored, carry=("n_bytes", "media")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_best_fit_packing(spark: SparkSession, data_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, data_dir))


def op8_substring_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, data_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_sharding(spark: SparkSession, data_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, data_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_simhash_near_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, data_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_collocations(spark: SparkSession, data_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, data_dir))


def op12_line_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(documents(spark, data_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: Of runs r (start, length, period), the one of most periods: first in this order, compared in whole numbers.
BEST_RUN = """reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> case
    when b is null or r.length * b.period > b.length * r.period
        or (r.length * b.period = b.length * r.period and (r.start, r.period) < (b.start, b.period)) then r else b end)"""


def op13_periodic_runs(spark: SparkSession, data_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(documents(spark, data_dir), plant=True)
    runs = F.expr("transform(starts, (s, i) -> struct(cast(s as bigint) as start, cast(lengths[i] as bigint) as length, cast(periods[i] as bigint) as period))")
    written = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return found.select("doc_id", runs.alias("runs"), "collapsed").select("doc_id", "collapsed", "runs", F.expr(BEST_RUN).alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeated_words_sql(width: int) -> str:
    """Tables for DuckDB: ``words`` (r, doc_id, w) per document and ``gone`` (r, p), the places
    from 1 of words in a window of ``width`` words that starts elsewhere too."""
    return rf"""
    with words as (
        select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
    ), windows as (
        select r, u.s, array_to_string(w[u.s:u.s + {width - 1}], ' ') as seq from words, unnest(range(1, len(w) - {width - 2})) as u(s)
    ), again as (
        select seq from windows group by seq having count(*) > 1
    ), gone as (
        select distinct r, unnest(range(s, s + {width})) as p from windows join again using (seq)
    )"""


PASSAGES_SQL = repeated_words_sql(suffix_dedup.PASSAGE) + """, runs as (
        select r, min(p) as first, max(p) as last
        from (select r, p, p - row_number() over (partition by r order by p) as run from gone) group by r, run
    )
    select doc_id, (first - 1)::integer as start, last::integer as "end", len(w)::integer as n_words,
        sha256(array_to_string(w[first:last], ' ')) as passage_sha256
    from runs join words using (r)"""

KEPT_WORDS_SQL = repeated_words_sql(substring_dedup.WIDTH) + """, places as (
        select r, u.p, w[u.p] as word from words, unnest(range(1, len(w) + 1)) as u(p)
    ), kept as (
        select r, string_agg(word, ' ' order by p) as text, count(*) as n from places anti join gone using (r, p) group by r
    )
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from words left join kept using (r)"""

LINES_SQL = r"""
    with lines as (
        select r, doc_id, l[place] as line, place, translate(trim(l[place], E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), E'\n') as l from documents),
            unnest(range(1, len(l) + 1)) as u(place)
    ), common as (
        select key, max(doc_id) as largest from lines where length(key) >= 40 group by key having count(distinct r) >= 5
    )
    select r.doc_id, count(*) as n_lines, count(*) filter (key is not null and largest is distinct from r.doc_id) as n_dropped,
        sha256(coalesce(string_agg(line, E'\n' order by place) filter (key is null or largest is not distinct from r.doc_id), '')) as kept_sha256
    from (select lines.r, lines.doc_id, line, place, common.key, largest from lines left join common using (key)) as r
    group by r.r, r.doc_id"""

PHRASES_SQL = r"""
    with pieces as (
        select coalesce(lang, 'und') as lang, regexp_extract_all(u.piece, '[^\x20\x09]+') as w
        from (select lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p from documents),
            unnest(p) as u(piece)
    ), totals as (
        select lang, sum(len(w))::hugeint as n from pieces group by lang
    ), phrases as (
        select lang, size, array_to_string(w[s:s + size - 1], ' ') as phrase, count(*)::hugeint as f
        from pieces, unnest(range(1, 6)) as k(size), unnest(range(1, len(w) - size + 2)) as u(s) group by all having count(*) >= 100
    ), candidates as (
        select lang, size, phrase, f as a, string_split(phrase, ' ') as w from phrases where size > 1
    ), kept as (
        select * from candidates c where not exists (
            select 1 from candidates d where d.lang = c.lang and d.size > c.size and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') and 100 * d.a >= 100 * c.a)
    ), cuts as (
        select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, n, 1000 * c.a * n // (x.f * y.f) as score
        from kept c join totals using (lang), unnest(range(1, c.size)) as u(k)
        join phrases x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
        join phrases y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:c.size], ' ')
    ), lowest as (
        select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
    ), ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
    )
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000"""

SQL = {"op11_collocations": PHRASES_SQL, "op12_line_dedup": LINES_SQL, "op5_suffix_array_dedup": PASSAGES_SQL, "op8_substring_dedup": KEPT_WORDS_SQL}

QUERIES: dict[str, Query] = {
    f.__name__: Query(f, SQL.get(f.__name__))
    for f in (
        op1_bpe, op2_secret_scan, op3_toxicity, op4_quality_rules, op5_suffix_array_dedup, op6_tiff,
        op7_best_fit_packing, op8_substring_dedup, op9_sharding, op10_simhash_near_dedup, op11_collocations, op12_line_dedup, op13_periodic_runs,
    )
}
