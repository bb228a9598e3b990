"""Words of questions looked up in tables of stop words and synonyms, however large those are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(questions: DataFrame, words: Column, id_col: str) -> DataFrame:
    """(query, at, word) of each word of an array, in order."""
    return questions.select(F.col(id_col).alias("query"), F.posexplode(words).alias("at", "word"))


def without_stop_words(rows: DataFrame, stop: DataFrame) -> DataFrame:
    """`rows` (query, at, word) without the words of `stop` (word); a question of stop words alone keeps its first."""
    known = stop.select("word").dropna().distinct().withColumn("_stop", F.lit(True))
    marked = rows.join(known, "word", "left").withColumn("_stop", F.coalesce("_stop", F.lit(False)))
    whole = Window.partitionBy("query")
    kept = marked.withColumns({"_left": F.count_if(~F.col("_stop")).over(whole), "_first": F.min("at").over(whole)})
    return kept.filter(~F.col("_stop") | ((F.col("_left") == 0) & (F.col("at") == F.col("_first")))).select("query", "at", "word")


def with_synonyms(rows: DataFrame, synonyms: DataFrame, most: int = 2) -> DataFrame:
    """(query, words, expression): each word and behind it up to `most` of its synonyms (term, synonym) in order of spelling, none twice in a
    question; and the words joined, those with synonyms as a group of alternatives."""
    place = F.row_number().over(Window.partitionBy("term").orderBy("synonym"))
    asked = rows.select(F.col("word").alias("term")).distinct()  # no list is made of terms that no question has
    top = synonyms.join(asked, "term", "left_semi").select("term", "synonym").dropna().distinct().withColumn("_p", place).filter(F.col("_p") <= most)
    lists = top.groupBy("term").agg(F.array_sort(F.collect_list("synonym")).alias("more"))
    met = rows.join(lists, F.col("word") == F.col("term"), "left").select("query", "at", F.concat(F.array("word"), F.coalesce("more", F.array().cast("array<string>"))).alias("group"))
    found = met.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "group"))).alias("l"))
    groups = F.transform("l", lambda x: x["group"])
    marked = F.transform(groups, lambda g: F.when(F.size(g) > 1, F.concat(F.lit("("), F.array_join(g, " OR "), F.lit(")"))).otherwise(F.get(g, F.lit(0))))
    return found.select("query", F.array_distinct(F.flatten(groups)).alias("words"), F.array_join(marked, " ").alias("expression"))
