"""Chunking, index upkeep and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import chunks as C
from sparkloom.operators import graph as G
from sparkloom.plans.registry import query
from sparkloom.sources.shared import written_once
from sparkloom.sources.tables import table


def _windows_sql(text: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"list_transform(range(CAST(CASE WHEN length({text}) <= {size} THEN 1 ELSE ceil((length({text}) - {size}) / {step}.0) + 1 END AS BIGINT)), lambda i: substr({text}, i * {step} + 1, {size}))"


def _chunk_sql(size: int, overlap: int) -> str:
    return f"c AS (SELECT doc_id, i - 1 AS chunk_index, chunk FROM (SELECT doc_id, {_windows_sql('text', size, overlap)} AS w FROM documents WHERE length(text) > 0), unnest(w) WITH ORDINALITY AS u(chunk, i))"


@query("chunk_fixed", f"WITH {_chunk_sql(600, 120)} SELECT doc_id, chunk_index, md5(chunk) AS digest, length(chunk) AS n FROM c")
def chunk_fixed(spark, sf_dir):
    rows = C.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), 600, 120)
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk").alias("digest"), F.length("chunk").cast("long").alias("n"))


@query(
    "chunk_parents_children",
    f"""WITH p AS (SELECT doc_id, i - 1 AS parent_index, t FROM (SELECT doc_id, {_windows_sql('text', 1500, 200)} AS w FROM documents WHERE length(text) > 0), unnest(w) WITH ORDINALITY AS u(t, i))
    SELECT doc_id, parent_index, i - 1 AS child_index, md5(x) AS digest FROM (SELECT doc_id, parent_index, {_windows_sql('t', 600, 120)} AS w FROM p), unnest(w) WITH ORDINALITY AS u(x, i)""",
)
def chunk_parents_children(spark, sf_dir):
    rows = C.parents_and_children(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("parent_index").cast("long").alias("parent_index"), F.col("child_index").cast("long").alias("child_index"), F.md5("text").alias("digest"))


@query(
    "chunk_neighbours",
    f"""WITH {_chunk_sql(600, 120)}, s AS (SELECT *, CASE WHEN length(chunk) > 100 THEN substr(chunk, 1, 100) || '...' ELSE chunk END AS short, max(chunk_index) OVER (PARTITION BY doc_id) AS last FROM c)
    SELECT doc_id, chunk_index, lag(short) OVER w AS previous, lead(short) OVER w AS next, CASE WHEN chunk_index = 0 THEN 'start' WHEN chunk_index = last THEN 'end' ELSE 'middle' END AS position FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
)
def chunk_neighbours(spark, sf_dir):
    rows = C.chunk_with_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"), 600, 120)
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "previous", "next", "position")


@query("chunk_sentences")
def chunk_sentences(spark, sf_dir):
    """Greedy packing is sequential, so there is no SQL; tests have a brute-force version."""
    from sparkloom.functions.text import sentences

    docs = table(spark, sf_dir, "documents").select("doc_id", C.packed_sentences(sentences("text")).alias("c"))
    return docs.select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"))


@query(
    "chunk_edge_lines",
    """WITH p AS (SELECT source AS doc, doc_id AS page, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc, page, len(l) AS n, i - 1 AS i, trim(u.line) AS line FROM p, unnest(l) WITH ORDINALITY AS u(line, i))
    SELECT doc, line, count(*) AS n FROM x WHERE (i < 3 OR i >= n - 3) AND length(line) > 5 GROUP BY doc, line HAVING count(*) >= 3""",
)
def chunk_edge_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return C.repeated_edge_lines(pages)


@query(
    "index_upsert",
    """WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents), n AS (SELECT doc_id, sha256(reverse(coalesce(text, ''))) AS hash FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT -doc_id - 1, sha256(coalesce(text, '')) FROM documents WHERE doc_id % 11 = 0)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)""",
)
def index_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    new = docs.filter("doc_id % 7 = 0").select("doc_id", F.sha2(F.reverse("text"), 256).alias("hash")).unionByName(docs.filter("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.sha2("text", 256).alias("hash")))
    return C.upsert(old, new, "doc_id")


@query("index_duplicates", "WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS hash FROM documents) SELECT doc_id, source FROM h WHERE EXISTS (SELECT 1 FROM h g WHERE g.hash = h.hash AND g.source = h.source AND g.doc_id < h.doc_id)")
def index_duplicates(spark, sf_dir):
    """Documents whose owner has an earlier one with the same content hash."""
    h = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    first = h.groupBy("source", "hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, ["source", "hash"]).filter("doc_id > first").select("doc_id", "source")


@query(
    "index_reconcile",
    """WITH i AS (SELECT source AS s, count(*) AS chunks FROM documents GROUP BY 1), r AS (SELECT 'src' || n_nationkey AS s, n_name AS status FROM nation)
    SELECT coalesce(i.s, r.s) AS source, i.s IS NOT NULL AS indexed, r.s IS NOT NULL AS registered, coalesce(chunks, 0) AS chunks, coalesce(status, 'unknown') AS status FROM i FULL JOIN r ON i.s = r.s""",
)
def index_reconcile(spark, sf_dir):
    """Indexed sources and registered ones side by side."""
    indexed = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"))
    listed = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("source"), F.col("n_name").alias("status"))
    both = indexed.withColumn("i", F.lit(True)).join(listed.withColumn("r", F.lit(True)), "source", "full_outer")
    return both.select("source", F.coalesce("i", F.lit(False)).alias("indexed"), F.coalesce("r", F.lit(False)).alias("registered"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("status", F.lit("unknown")).alias("status"))


_ENT = "[A-Z][A-Za-z0-9_]{2,}"
_TRIPLETS = f"""f AS (SELECT doc_id AS doc, u.e AS entity, u.i FROM documents, unnest(regexp_extract_all(coalesce(text, ''), '{_ENT}')) WITH ORDINALITY AS u(e, i)),
    k AS (SELECT doc, entity, count(*) AS n, min(i) AS first FROM f GROUP BY ALL), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) AS rank FROM k) WHERE rank <= 10),
    p AS (SELECT doc, entity AS head, lead(entity) OVER (PARTITION BY doc ORDER BY rank) AS tail FROM r),
    tr AS (SELECT doc, head, CASE WHEN contains(t, 'depend') OR contains(t, 'based on') THEN 'DEPENDS_ON' WHEN contains(t, 'include') OR contains(t, 'contains') THEN 'INCLUDES' WHEN contains(t, 'use') THEN 'USES' WHEN contains(t, 'store') THEN 'STORES_IN' ELSE 'RELATED_TO' END AS relation, tail
      FROM p JOIN (SELECT doc_id AS doc, lower(coalesce(text, '')) AS t FROM documents) USING (doc) WHERE tail IS NOT NULL),
    ed AS (SELECT head, relation, tail, list_sort(list_distinct(list(source))) AS sources, max(confidence) AS confidence_max, count(*) AS confidence_count, avg(confidence) AS confidence_avg FROM (SELECT tr.*, d.source, (tr.doc % 10) / 10.0 AS confidence FROM tr JOIN documents d ON d.doc_id = tr.doc) GROUP BY head, relation, tail)"""
_UNDIRECTED = "un AS (SELECT head AS h, relation AS r, tail AS t, head AS entity, relation, tail AS other FROM ed UNION ALL SELECT head, relation, tail, tail, relation, head FROM ed WHERE head <> tail)"
_SEEDS = "se AS (SELECT DISTINCT entity FROM r WHERE doc % 50 = 0 AND rank = 1)"


def _triplets(spark, sf_dir, counts=None):
    docs = table(spark, sf_dir, "documents")
    return G.rule_triplets(docs, pattern=_ENT, counts=counts).join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc").withColumn("confidence", (F.col("doc") % 10) / 10)


def _graph(spark, sf_dir):
    """(edges, seeds), both from entities that are counted and written once; the edges are written too, since searches read them twice."""
    counts = written_once(G.entity_counts(table(spark, sf_dir, "documents"), pattern=_ENT), "entities")
    return written_once(G.edges(_triplets(spark, sf_dir, counts)), "edges"), counts.filter("doc % 50 = 0 and rank = 1").select("entity").distinct()


@query("graph_triplets", f"WITH {_TRIPLETS} SELECT doc, head, relation, tail FROM tr")
def graph_triplets(spark, sf_dir):
    return _triplets(spark, sf_dir).select("doc", "head", "relation", "tail")


@query("graph_edges", f"WITH {_TRIPLETS} SELECT head, relation, tail, array_to_string(sources, ',') AS sources, round(confidence_max, 6) AS confidence_max, confidence_count, round(confidence_avg, 6) AS confidence_avg FROM ed")
def graph_edges(spark, sf_dir):
    e = G.edges(_triplets(spark, sf_dir))
    return e.select("head", "relation", "tail", F.array_join("sources", ",").alias("sources"), F.round("confidence_max", 6).alias("confidence_max"), "confidence_count", F.round("confidence_avg", 6).alias("confidence_avg"))


@query("graph_best_triplets", f"WITH {_TRIPLETS} SELECT head, relation, tail, round(max(confidence), 6) AS confidence FROM (SELECT tr.*, (doc % 10) / 10.0 AS confidence FROM tr) WHERE confidence >= 0.5 AND head <> tail GROUP BY ALL")
def graph_best_triplets(spark, sf_dir):
    return G.best_triplets(_triplets(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    "graph_neighbours",
    f"""WITH {_TRIPLETS}, {_UNDIRECTED}, {_SEEDS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY relation, other) AS place FROM (SELECT DISTINCT entity, relation, other FROM un WHERE entity IN (SELECT entity FROM se)))
    SELECT se.entity, relation, other, place FROM se LEFT JOIN (SELECT * FROM n WHERE place <= 10) n ON n.entity = se.entity""",
)
def graph_neighbours(spark, sf_dir):
    return G.neighbours(*_graph(spark, sf_dir)).select("entity", "relation", "other", "place")


@query(
    "graph_two_hops",
    f"""WITH {_TRIPLETS}, {_UNDIRECTED}, {_SEEDS}, pa AS (SELECT DISTINCT a.entity AS source, a.relation AS rel1, a.other AS middle, b.relation AS rel2, b.other AS target FROM un a JOIN un b ON a.other = b.entity
      WHERE a.entity IN (SELECT entity FROM se) AND a.entity <> b.other AND (a.h, a.r, a.t) <> (b.h, b.r, b.t))
    SELECT source, rel1, middle, rel2, target, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY middle, target, rel1, rel2) AS place FROM pa) WHERE place <= 10""",
)
def graph_two_hops(spark, sf_dir):
    return G.two_hops(*_graph(spark, sf_dir)).select("source", "rel1", "middle", "rel2", "target", "place")


@query(
    "graph_search",
    f"""WITH {_TRIPLETS}, {_UNDIRECTED}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY other) AS place FROM (SELECT DISTINCT entity, other FROM un WHERE contains(lower(entity), 'tion') OR contains(lower(entity), 'the')))
    SELECT entity, string_agg(other, ',' ORDER BY other) AS related FROM n WHERE place <= 20 GROUP BY entity""",
)
def graph_search(spark, sf_dir):
    out = G.search(G.edges(_triplets(spark, sf_dir)), ["tion", "the"])
    return out.select("entity", F.array_join("related", ",").alias("related"))


@query("graph_without_source", f"WITH {_TRIPLETS} SELECT head, relation, tail, array_to_string(list_filter(sources, lambda s: s <> 'src1'), ',') AS sources FROM ed WHERE len(list_filter(sources, lambda s: s <> 'src1')) > 0")
def graph_without_source(spark, sf_dir):
    return G.without_source(G.edges(_triplets(spark, sf_dir)), "src1").select("head", "relation", "tail", F.array_join("sources", ",").alias("sources"))


@query(
    "graph_fuzzy",
    """WITH n AS (SELECT DISTINCT substr(n_name, 2) AS name FROM nation), e AS (SELECT DISTINCT n_name AS entity FROM nation UNION SELECT r_name FROM region),
    m AS (SELECT name, entity, levenshtein(lower(name), lower(entity)) AS distance FROM n, e), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, entity) AS p FROM m WHERE distance <= 2) SELECT name, entity, distance FROM b WHERE p = 1""",
)
def graph_fuzzy(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.substr("n_name", F.lit(2)).alias("name")).distinct()
    entities = nation.select(F.col("n_name").alias("entity")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("entity"))).distinct()
    return G.fuzzy_matches(names, entities)


@query(
    "source_pages",
    r"""WITH a AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, url, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
    c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS t FROM b)
    SELECT page_id, md5(t) AS digest, length(t) AS n, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM c""",
)
def source_pages(spark, sf_dir):
    from sparkloom.sources.files import html_text

    rows = table(spark, sf_dir, "pages").select("page_id", "url", html_text("html").alias("t"))
    return rows.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("source_tiers", "SELECT event_id, ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAY AS cold FROM events")
def source_tiers(spark, sf_dir):
    from sparkloom.sources.files import tiers

    hot, cold = tiers(table(spark, sf_dir, "events"), "ts", "2024-01-20 00:00:00")
    return hot.select("event_id", F.lit(False).alias("cold")).unionByName(cold.select("event_id", F.lit(True).alias("cold")))
