"""Splitting, entities, references and structure of texts as they are taken in. Sequential rules have no SQL; tests/test_ingest.py has brute-force versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import hashing as H
from sparkloom.functions import text as T
from sparkloom.operators import entities as E
from sparkloom.operators import pages as P
from sparkloom.operators import references as R
from sparkloom.operators import splitting as S
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    """Children of 600 in parents of 1500 characters, both cut by paragraphs, lines, sentences, words and at last characters."""
    rows = S.children(S.parents(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "parent_id", "parent_index", "child_index", "chunk_id", F.md5("text").alias("digest"))


@query("chunk_typed")
def chunk_typed(spark, sf_dir):
    """The same by the separators of each document's kind of file. The table names no kinds, so a hash deals its documents to four."""
    kind = F.element_at(F.array(*map(F.lit, ("markdown", "code", "pdf", "text"))), H.bucket(F.lit("kind"), F.col("doc_id"), buckets=4) + 1)
    rows = S.children(S.parents(table(spark, sf_dir, "documents"), separators=S.separators_for(kind, T.language("text"))))
    return rows.select("doc_id", "parent_id", "child_index", "chunk_id", F.md5("text").alias("digest"))


@query("entities_rules")
def entities_rules(spark, sf_dir):
    rows = E.by_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc", "place", "text", "type", "confidence", E.normal_name("text").alias("name"))


@query("entities_names")
def entities_names(spark, sf_dir):
    return E.names(table(spark, sf_dir, "documents"))


@query("entities_agreed")
def entities_agreed(spark, sf_dir):
    """The rules and, as a second extractor that is surer of frequent names, the list of names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    second = E.names(docs, most=40).withColumn("confidence", F.least(F.lit(0.95), 0.5 + 0.05 * F.col("count")))
    return E.agreed(E.by_rules(docs), second).withColumn("confidence", F.round("confidence", 6))


@query(
    "question_expanded",
    r"""WITH q AS (SELECT p_partkey AS query, p_type || ' ' || p_name AS text FROM part), s AS (SELECT lower(p_type) AS term, list_sort(list(DISTINCT string_split(p_name, ' ')[1])) AS l FROM part GROUP BY 1),
    e AS (SELECT query, text, unnest(regexp_extract_all(text, '\b[A-Z]{2,6}\b')) AS entity FROM q), n AS (SELECT query, text, list_filter(l, lambda x: NOT contains(lower(text), lower(x))) AS new FROM e JOIN s ON term = lower(entity)),
    x AS (SELECT query, CASE WHEN len(text || ' ' || array_to_string(new, ' ')) > 3 * len(text) THEN text || ' ' || array_to_string(new[1:3], ' ') ELSE text || ' ' || array_to_string(new, ' ') END AS expanded FROM n WHERE len(new) > 0)
    SELECT q.query, coalesce(expanded, text) AS expanded FROM q LEFT JOIN x USING (query)""",
)
def question_expanded(spark, sf_dir):
    """Questions after parts by type; a type's synonyms are the first words of its parts' names."""
    parts = table(spark, sf_dir, "part")
    asked = parts.select(F.col("p_partkey").alias("query"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    words = parts.groupBy(F.lower("p_type").alias("term")).agg(F.array_sort(F.collect_set(F.split("p_name", " ")[0])).alias("synonyms"))
    return E.expanded(asked, words)


@query("chat_resolved")
def chat_resolved(spark, sf_dir):
    rows = R.resolved(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.md5("text").alias("said"), F.md5("resolved").alias("resolved"))


@query("chat_questions")
def chat_questions(spark, sf_dir):
    """What users ask, with the entities of the ten turns before for pronouns."""
    rows = R.resolved_questions(table(spark, sf_dir, "conversations"), F.col("role") == "user", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.md5("text").alias("said"), F.md5("resolved").alias("resolved"))


@query("text_context")
def text_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(R.with_context("text")).alias("context"), F.md5(R.without_demonstratives("text")).alias("nouns"))


@query("page_tables")
def page_tables(spark, sf_dir):
    """A source's documents are its pages."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    whole = P.with_whole_tables(docs, "source", "doc_id", "text", F.floor(F.col("doc_id") / 4096))
    both = P.with_joined_tables(whole, "source", "doc_id", "text", F.floor(F.col("doc_id") / 4096))
    kinds = {"starts": P.starts_table("text"), "continues": P.continues_table("text"), "open": P.leaves_table_off("text"), "head": P.has_head("text")}
    return both.select("source", "doc_id", "pages", F.md5("text").alias("digest"), *[c.alias(n) for n, c in kinds.items()])
