"""Scores of questions, answers, claims, retrieved chunks, relations, chunks and documents. tests/test_scoring.py has plain Python for those without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.functions import times
from sparkloom.operators import analytics as A
from sparkloom.operators import chunks as C
from sparkloom.operators import chunktypes as K
from sparkloom.operators import dictionary as D
from sparkloom.operators import graph as G
from sparkloom.operators import retrieval as R
from sparkloom.operators import scoring as S
from sparkloom.plans.documents import _TRIPLETS, _graph, _triplets
from sparkloom.plans.registry import query
from sparkloom.plans.structure import _checked
from sparkloom.sources import intake as I
from sparkloom.sources.tables import table


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _like(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}', 'i')" for p in patterns) + ")"


_STRATEGIES = f"""t AS (SELECT conv_id, turn, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM conversations),
    c AS (SELECT *, len(list_filter(string_split_regex(trim(low), '\\s+'), lambda w: w IN ({", ".join(f"'{w}'" for w in S.QUESTION_WORDS)}))) AS q, {" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in S.CONNECTORS)} AS j,
      {" + ".join(f"CASE WHEN {_has('low', words)} THEN {weight} ELSE 0 END" for weight, words in S.INDICATORS)} AS b, length(t) - length(replace(t, '?', '')) AS m1, length(t) - length(replace(t, '？', '')) AS m2, lower(trim(t)) AS a FROM t),
    s AS (SELECT *, CAST(CASE WHEN length(t) < 15 THEN 0 WHEN length(t) < 40 THEN 1 WHEN length(t) < 80 THEN 2 ELSE 3 END + CASE q WHEN 0 THEN 0.5 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END + CASE WHEN j >= 3 THEN 2 WHEN j >= 1 THEN 1 ELSE 0 END
      + CASE WHEN m1 + m2 > 1 THEN 1 ELSE 0 END + least(3.0, b) AS DOUBLE) AS score, a <> '' AND ({_like('a', S.TASK)} OR {_like('a', S.FACT)} OR {_has('a', '?？')}) AS facts, len(regexp_extract_all(a, '[A-Za-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')) AS n FROM c),
    w AS (SELECT *, a <> '' AND ({_like('a', S.FORCE_WEB)} OR ({_like('a', S.FRESH)} AND NOT {_like('a', S.CASUAL)} AND facts)) AS web FROM s)"""


@query(
    "question_strategies",
    f"""WITH {_STRATEGIES} SELECT conv_id, turn, score, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 5 THEN 'medium' ELSE 'complex' END AS level,
      ({_has('t', '和与')} AND {_has('t', S.SPLITS[0][1][:5])}) OR {_has('t', ["以及", "还有", "另外", "and also", "as well as"])} OR length(t) > 50 OR m1 > 1 OR m2 > 1 OR ({_has('t', S.SPLITS[1][1])} AND length(t) > 30) AS needed,
      CASE {" ".join(f"WHEN {_has('t', words)} THEN '{name}'" for name, words in S.SPLITS)} ELSE 'general' END AS how, web,
      a <> '' AND NOT web AND NOT {_like('a', S.TASK)} AND ({_like('a', S.CASUAL)} OR (n > 0 AND n <= 12 AND {_has('a', ["你", "我", "咱们", "我们"])} AND NOT facts)) AS small_talk FROM w""",
)
def question_strategies(spark, sf_dir):
    """Complexity, decomposition, web and small talk of each turn."""
    turns = table(spark, sf_dir, "conversations")
    score, level = S.complexity("text")
    needed, how = S.decomposition("text")
    return turns.select("conv_id", "turn", score.alias("score"), level.alias("level"), needed.alias("needed"), how.alias("how"), S.needs_web("text").alias("web"), S.small_talk("text").alias("small_talk"))


@query("verify_answers")
def verify_answers(spark, sf_dir):
    """Quality and factual spans of the assistants' answers, and how well the document cited last bears them."""
    rows = _checked(spark, sf_dir)
    last = F.get("citations", F.lit(0))
    content = F.get(F.filter("docs", lambda d: d["doc"] == last["doc"]), F.lit(0))["content"]
    support = S.claim_support(F.col("answer"), content, F.size("citations") > 0)
    return rows.select("conv_id", "turn", F.round(S.answer_quality("answer"), 8).alias("quality"), F.array_join(S.factual_spans("answer"), "|").alias("spans"), F.round(support, 8).alias("support"))


@query("retrieve_quality")
def retrieve_quality(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = R.bm25(docs, asked, 5).join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), "source"), "doc")
    chunks = found.select("query", "content", F.round(F.col("score") / (F.col("score") + 50), 6).alias("score"), "source")
    out = S.retrieval_quality(asked.select(F.col("item_id").alias("query"), "text"), chunks)
    return out.select("query", *[F.round(c, 8).alias(c) for c in ("coverage", "relevance", "diversity", "completeness", "overall")])


_WEIGHT = f"""CASE WHEN lower(relation) IN ({", ".join(f"'{x}'" for x in S.NOISY)}) THEN 0.0 WHEN {" OR ".join(f"contains(lower(relation), '{x}')" for x in S.STRONG)} THEN 1.0 ELSE 0.6 END"""


@query(
    "graph_relation_weights",
    f"""WITH {_TRIPLETS}, q AS (SELECT tr.*, least(1.0, n_chars / 4000.0) AS quality FROM tr JOIN documents ON doc_id = tr.doc)
    SELECT doc, head, relation, tail, round(least(1.0, ({_WEIGHT}) * (1 + CASE WHEN quality >= 0.7 THEN 0.3 ELSE quality * 0.3 END)), 8) AS weight FROM q""",
)
def graph_relation_weights(spark, sf_dir):
    """Relations of documents, by what they say and by the length of the document as its quality."""
    quality = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("quality"))
    rows = _triplets(spark, sf_dir).select("doc", "head", "relation", "tail").join(quality, "doc")
    return rows.select("doc", "head", "relation", "tail", F.round(S.relation_weight("relation", F.col("quality")), 8).alias("weight"))


def _signals(spark, sf_dir):
    """Per seed: its neighbours and paths with the weights of their relations, and its relevance to the beginning of its name."""
    edges, seeds = _graph(spark, sf_dir)
    weight = lambda c: S.relation_weight(c, F.lit(0.5))
    near = G.neighbours(edges, seeds).groupBy("entity").agg(F.count("other").alias("neighbours"), F.avg(F.when(F.col("other").isNotNull(), weight("relation"))).alias("neighbour_weight"))
    far = G.two_hops(edges, seeds).groupBy(F.col("source").alias("entity")).agg(F.count("*").alias("paths"), F.avg((weight("rel1") + weight("rel2")) / 2).alias("path_weight"))
    rows = near.join(far, "entity", "left").withColumn("paths", F.coalesce("paths", F.lit(0)))
    tokens = F.array(F.lower(F.substring("entity", 1, 4)), F.lit("tion"))
    return rows.withColumns({"tokens": tokens, "relevance": S.name_relevance(tokens, F.col("entity")), "quality": (F.length("entity") % 5) / 5})


@query("graph_signals")
def graph_signals(spark, sf_dir):
    rows = _signals(spark, sf_dir)
    score, level = S.graph_signal(F.lit(1), *[F.col(c) for c in ("relevance", "neighbours", "neighbour_weight", "paths", "path_weight", "quality")])
    return rows.select("entity", F.round("relevance", 8).alias("relevance"), F.round(score, 8).alias("score"), level.alias("confidence"))


@query("chunk_enriched")
def chunk_enriched(spark, sf_dir):
    """Chunks with type, counts, keywords, entities, flags and importance, beside their position and neighbours."""
    rows = C.chunk_with_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"), 600, 120)
    out = K.enriched(rows, ["doc_id", "chunk_index"])
    found = [F.array_join(F.col("entities")[n], " ").alias(n) for n in K.ENTITIES]
    return out.select("doc_id", "chunk_index", "type", "length", "word_count", F.array_join("keywords", " ").alias("keywords"), *found, "has_question", "has_code", "has_url", "has_email", "position", F.round("importance", 8).alias("importance"))


def _referring(spark, sf_dir):
    """A sentence with references for each part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.concat(F.col("p_name"), F.lit(" [" ), key, F.lit("] as in Section "), size, F.lit("."), key, F.lit(" and TABLE "), size, F.lit(" [see] [Smith 20"), F.lpad(size, 2, "0"), F.lit("], figure x"))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))


_CITED = "list_transform(list_filter(regexp_extract_all(t, '\\[([^\\]]+)\\]', 1), lambda x: regexp_matches(x, '^\\d+$|^[A-Z][a-z]+\\s+\\d{4}')), lambda x: {'id': x, 'text': '[' || x || ']', 'type': 'citation'})"
_CROSSED = "list_transform(regexp_extract_all(t, '(?i)(Chapter|Section|Figure|Table)\\s+\\d+\\.?\\d*'), lambda x: {'id': regexp_extract(x, '\\s+(.*)$', 1), 'text': regexp_extract(x, '^\\w+') || ' ' || regexp_extract(x, '\\s+(.*)$', 1), 'type': 'cross_reference'})"


@query(
    "text_references",
    f"""WITH p AS (SELECT p_partkey, p_name || ' [' || p_partkey || '] as in Section ' || p_size || '.' || p_partkey || ' and TABLE ' || p_size || ' [see] [Smith 20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '], figure x' AS t FROM part)
    SELECT p_partkey, CAST(i - 1 AS INTEGER) AS "at", r.id AS id, r.text AS text, r.type AS type FROM (SELECT p_partkey, list_concat({_CITED}, {_CROSSED}) AS l FROM p), unnest(l) WITH ORDINALITY AS u(r, i)""",
)
def text_references(spark, sf_dir):
    return _referring(spark, sf_dir).select("p_partkey", F.posexplode(K.references("text")).alias("at", "r")).select("p_partkey", "at", "r.*")


@query("text_quality")
def text_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    score = K.document_quality("text", F.floor(F.col("n_chars") / 500), F.col("source") == "src1", F.col("lang") == "en")
    return docs.select("doc_id", F.round(score, 8).alias("quality"))


@query("log_times", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN ts WHEN 3 THEN NULL ELSE date_trunc('day', ts) END AS \"at\" FROM events")
def log_times(spark, sf_dir):
    """Times as logs write them: with Z, with an offset, without zone, not at all, and a day alone."""
    rows = table(spark, sf_dir, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    said = F.when(F.col("event_id") % 5 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 5 == 1, F.concat(iso, F.lit("+02:00"))).when(F.col("event_id") % 5 == 2, iso).when(F.col("event_id") % 5 == 3, F.lit("yesterday")).otherwise(F.substring(iso, 1, 10))
    return rows.select("event_id", times.parsed(said).cast("timestamp_ntz").alias("at"))


@query(
    "ops_routed",
    """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS correct, round(count(*) FILTER (event_type <> 'error') / count(*), 8) AS accuracy, round(avg(value / 200), 6) AS confidence
    FROM events WHERE user_id % 2 = 0 AND value / 200 >= 0.2 AND value / 200 <= 0.9 AND contains(lower(props), '7')""",
)
def ops_routed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "graph").otherwise("vector").alias("route"), F.lit("x").alias("kind"), (F.col("value") / 200).alias("confidence"), F.col("props").alias("question"), (F.col("event_type") != "error").alias("correct")
    )
    return A.routed(rows, route="graph", low=0.2, high=0.9, holds="7").withColumns({"accuracy": F.round("accuracy", 8), "confidence": F.round("confidence", 6)})


_DICTIONARY = """w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) AS word FROM documents), df AS (SELECT word, count(*) AS n FROM w GROUP BY 1),
    stop AS (SELECT word FROM df WHERE n * 4 > (SELECT count(*) FROM documents)), syn AS (SELECT a.word AS term, b.word AS synonym FROM df a JOIN df b ON substr(a.word, 1, 6) = substr(b.word, 1, 6) AND a.word <> b.word WHERE length(a.word) >= 6 AND length(b.word) >= 6 AND a.n >= 3 AND b.n >= 3),
    q AS (SELECT item_id AS query, i - 1 AS pos, u.word FROM benchmark, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) WITH ORDINALITY AS u(word, i)),
    m AS (SELECT *, word IN (SELECT word FROM stop) AS s FROM q), k AS (SELECT query, pos, word FROM (SELECT *, count(*) FILTER (NOT s) OVER (PARTITION BY query) AS l, min(pos) OVER (PARTITION BY query) AS f FROM m) WHERE NOT s OR (l = 0 AND pos = f)),
    t2 AS (SELECT term, list_sort(list(synonym)) AS more FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY synonym) AS p FROM syn) WHERE p <= 2 GROUP BY term)"""


@query(
    "question_dictionary",
    f"""WITH {_DICTIONARY} SELECT query, string_agg(CASE WHEN more IS NULL THEN word ELSE '(' || word || ' OR ' || array_to_string(more, ' OR ') || ')' END, ' ' ORDER BY pos) AS expression FROM k LEFT JOIN t2 ON term = word GROUP BY query""",
)
def question_dictionary(spark, sf_dir):
    """Passages without the words that a quarter of all documents hold, each with two others of its first six letters: both tables come from the documents."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(T.matches(F.lower(T.text("text")), "[a-z]{3,}"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("all"))
    stop = words.crossJoin(F.broadcast(total)).filter(F.col("n") * 4 > F.col("all")).select("word")  # one row
    stem = words.filter((F.length("word") >= 6) & (F.col("n") >= 3)).select("word", F.substring("word", 1, 6).alias("stem"))
    alike = stem.select(F.col("word").alias("term"), "stem").join(stem.select(F.col("word").alias("synonym"), "stem"), "stem").filter("term <> synonym")
    rows = D.tokens(table(spark, sf_dir, "benchmark"), T.matches(F.lower(T.text("text")), "[a-z]{3,}"), "item_id")
    return D.with_synonyms(D.without_stop_words(rows, stop), alike.select("term", "synonym")).select("query", "expression")


def _judgements(spark, sf_dir):
    """A judge's answer to three documents at once, for each event; some of it is missing or spoilt."""
    i = F.col("event_id")
    part = lambda n, score, label: F.concat(F.lit(f"Document {n}:\nSCORE: "), score, F.lit(f"\nLABEL: {label}\nREASONING: of "), i.cast("string"), F.lit("\n\n"))
    said = F.concat(F.lit("Answer\n"), part(1, (i % 13 / 10).cast("string"), "Highly_Relevant"), F.when(i % 3 == 0, F.lit("Document 2: none\n")).otherwise(part(2, F.lit("bad"), "other")), F.when(i % 4 > 0, part(3, F.lit("0.5"), "somewhat_relevant")).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", F.when(i % 7 > 0, said).alias("answer"))


@query("question_judged_all")
def question_judged_all(spark, sf_dir):
    rows = _judgements(spark, sf_dir).select("event_id", F.posexplode(Q.judged_all("answer", F.lit(4))).alias("document", "j"))
    return rows.select("event_id", "document", "j.score", "j.label", "j.reason")


_UPLOADS = """u AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS owner, page_id AS place, CASE page_id % 6 WHEN 0 THEN 'a/report.md' WHEN 1 THEN 'b\\ ai notes.TXT' WHEN 2 THEN 'picture.png' WHEN 3 THEN 'tool.exe' WHEN 4 THEN '_draft.md' ELSE 'paper..pdf' END AS filename,
      CASE WHEN page_id % 6 = 5 AND page_id % 4 = 1 THEN '%PDF-' || coalesce(html, '') WHEN page_id % 11 = 0 THEN '' ELSE html END AS content FROM pages)"""


@query(
    "source_intake",
    f"""WITH {_UPLOADS}, n AS (SELECT *, CASE WHEN filename = '_draft.md' THEN NULL ELSE replace(replace(string_split(filename, '/')[-1], '\\', ''), '..', '') END AS name FROM u),
    k AS (SELECT *, CASE place % 6 WHEN 1 THEN '.txt' WHEN 2 THEN '.png' WHEN 3 THEN '.exe' WHEN 4 THEN '' WHEN 5 THEN '' ELSE '.md' END AS suffix, octet_length(encode(content)) AS size, sha256(content) AS sha FROM n),
    r AS (SELECT owner, sha, min(place) AS document_id FROM k GROUP BY ALL), t AS (SELECT k.*, sum(CASE WHEN suffix IN ('.txt', '.md', '.png') THEN coalesce(size, 0) ELSE 0 END) OVER (PARTITION BY owner ORDER BY place) AS total FROM k),
    v AS (SELECT t.owner, t.place, name, suffix, size, CASE WHEN name IS NULL THEN 'hidden' WHEN suffix NOT IN ('.txt', '.md', '.png') THEN 'unsupported' WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN size > 6000 THEN 'too_large' WHEN total > 30000 THEN 'too_much'
      WHEN suffix = '.png' THEN 'forged' WHEN r.document_id < t.place THEN 'duplicate' ELSE 'accepted' END AS verdict, r.document_id FROM t LEFT JOIN r ON r.owner = t.owner AND r.sha = t.sha)
    SELECT owner, place, name, suffix, CAST(size AS INTEGER) AS size, verdict, CASE WHEN verdict = 'duplicate' THEN document_id END AS document_id, CASE WHEN verdict = 'accepted' THEN CASE WHEN contains(name, 'ai ') THEN 'artificial_intelligence' ELSE 'general' END END AS agent_class FROM v""",
)
def source_intake(spark, sf_dir):
    """Pages as uploads of their hosts; what a host has under an earlier number is registered."""
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    names = F.element_at(F.array(*map(F.lit, ("a/report.md", "b\\ ai notes.TXT", "picture.png", "tool.exe", "_draft.md", "paper..pdf"))), (i % 6 + 1).cast("int"))
    content = F.when((i % 6 == 5) & (i % 4 == 1), F.concat(F.lit("%PDF-"), T.text("html"))).when(i % 11 == 0, "").otherwise(F.col("html"))
    files = pages.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("owner"), i.alias("place"), names.alias("filename"), content.cast("binary").alias("content"))
    earlier = files.select("owner", F.sha2("content", 256).alias("sha256"), F.col("place").alias("document_id"), F.lit("ready").alias("status"))
    first = earlier.groupBy("owner", "sha256", "status").agg(F.min("document_id").alias("document_id"))
    out = I.judged(files, first, max_file_bytes=6000, max_total_bytes=30000)
    own = (F.col("verdict") == "duplicate") & (F.col("document_id") == F.col("place"))  # a file isn't its own duplicate
    agent = F.when(own, T.agent_class(F.regexp_replace("name", r"\.[^.]+$", ""))).otherwise(F.col("agent_class"))
    return out.select("owner", "place", "name", "suffix", "size", F.when(own, "accepted").otherwise(F.col("verdict")).alias("verdict"), F.when(~own, F.col("document_id")).alias("document_id"), agent.alias("agent_class"))
