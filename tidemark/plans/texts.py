"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joined import joined_texts
from tidemark.operators.links import page_links
from tidemark.operators.near_copies import near_copies
from tidemark.operators.overlap import shared_shingles
from tidemark.operators.spread import held_by_at_least
from tidemark.operators.widespread import most_widespread
from tidemark.plans.registry import Query
from tidemark.sources.tables import table


def near_copy_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Classes of texts linked by a Jaccard similarity of 0.8 of their sets of 5-word shingles."""
    return near_copies(table(spark, data_dir, "documents"))


NEAR_COPY_CLASSES_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_sort(list_distinct(case when len(w) >= 5 then [array_to_string(w[s:s + 4], ' ') for s in range(1, len(w) - 3)]
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
  from words
), reps as (
  select doc_id, s, min(doc_id) over (partition by s) as representative from sets
), own as (
  select doc_id as id, len(s) as n, unnest(s) as shingle from reps where doc_id = representative
), links as (
  select a.id as a, b.id as b from own a join own b on a.shingle = b.shingle and a.id <> b.id
  group by a.id, b.id, a.n, b.n having count(*) * 10 >= 8 * (a.n + b.n - count(*))
), reach as (
  select a as id, b as other from links union select r.id, l.b from reach r join links l on r.other = l.a
), roots as (
  select id, least(id, min(other)) as root from reach group by id
)
select doc_id, representative, coalesce(root, representative) as class_id from reps left join roots on id = representative
"""


def benchmark_overlap(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents and benchmark items that share 8 words in a row."""
    found = shared_shingles(table(spark, data_dir, "documents"), table(spark, data_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("small_id").alias("item_id"), "shared")


def _windows(name: str, key: str) -> str:
    return rf"""select distinct {key}, array_to_string(w[u.s:u.s + 7], ' ') as shingle
  from (select {key}, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from {name}), unnest(range(1, len(w) - 6)) as u(s)"""


BENCHMARK_OVERLAP_SQL = f"""
with d as ({_windows("documents", "doc_id")}), b as ({_windows("benchmark", "item_id")})
select doc_id, item_id, count(*) as shared from d join b using (shingle) group by doc_id, item_id
"""


def common_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Lines that three or more documents hold, with the least three of these."""
    lines = table(spark, data_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    found = held_by_at_least(lines.where("line <> ''"), "line", "doc_id", 3)
    return found.select("line", *[F.get("members", i).alias(n) for i, n in enumerate(("first_doc", "second_doc", "third_doc"))])


COMMON_LINES_SQL = """
select line, l[1] as first_doc, l[2] as second_doc, l[3] as third_doc
from (select line, list_sort(list(distinct doc_id)) as l
      from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where line <> '' group by line)
where len(l) >= 3
"""


def widespread_words(spark: SparkSession, data_dir: str) -> DataFrame:
    """The twenty words, in lower case, that most documents of each language hold."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    docs = table(spark, data_dir, "documents").select("lang", F.array_distinct(words).alias("words"))
    return most_widespread(docs, "lang", "words", 20).withColumnRenamed("value", "word")


WIDESPREAD_WORDS_SQL = r"""
select lang, word, rows, place from (
  select *, row_number() over (partition by lang order by rows desc, word) as place
  from (select lang, word, count(*) as rows
        from (select lang, unnest(list_distinct(regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+'))) as word from documents)
        group by lang, word))
where place <= 20
"""


def conversation_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each conversation as text, a line a turn, in pieces of ten thousand turns."""
    turns = table(spark, data_dir, "conversations").withColumn("line", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return joined_texts(turns, ["conv_id"], ["turn"], "line", longest_group=turns.count())


CONVERSATION_TEXTS_SQL = """
select conv_id, (place - 1) // 10000 as piece, count(*) as rows, string_agg(role || ': ' || text, chr(10) order by turn) as text
from (select *, row_number() over (partition by conv_id order by turn) as place from conversations) group by 1, 2
"""


def link_targets(spark: SparkSession, data_dir: str) -> DataFrame:
    """Targets of links as pages write them: how many links and pages have each."""
    found = page_links(table(spark, data_dir, "pages"))
    per_page = found.groupBy("page_id", "href").agg(F.count("*").alias("links"))
    return per_page.groupBy("href").agg(F.sum("links").alias("links"), F.count("*").alias("pages"))


LINK_TARGETS_SQL = """
select href, count(*) as links, count(distinct page_id) as pages
from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages) group by href
"""


QUERIES = {
    "widespread_words": Query(widespread_words, WIDESPREAD_WORDS_SQL),
    "conversation_texts": Query(conversation_texts, CONVERSATION_TEXTS_SQL),
    "link_targets": Query(link_targets, LINK_TARGETS_SQL),
    "near_copy_classes": Query(near_copy_classes, NEAR_COPY_CLASSES_SQL),
    "benchmark_overlap": Query(benchmark_overlap, BENCHMARK_OVERLAP_SQL),
    "common_lines": Query(common_lines, COMMON_LINES_SQL),
}
