"""Keywords, lines, layout, formulas, messages, staged checks and deletion across stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import formulas as M
from sparkloom.functions import messages as J
from sparkloom.functions import text as T
from sparkloom.operators import cascade as C
from sparkloom.operators import deletion as D
from sparkloom.operators import graph as G
from sparkloom.operators import keywords as K
from sparkloom.operators import layout as L
from sparkloom.operators import linetypes as N
from sparkloom.plans.documents import _ENT, _TRIPLETS, _triplets
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


_WORDS = f"""w AS (SELECT doc_id AS doc, u.word FROM documents, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_\\-]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: length(x) >= 2 AND x NOT IN ({_list(T.REWRITE_STOP_WORDS)}))) AS u(word)),
    c AS (SELECT doc, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT doc, word, round(n / sum(n) OVER (PARTITION BY doc) * ln((SELECT count(DISTINCT doc) FROM c) / count(*) OVER (PARTITION BY word)), 9) AS score FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, word) AS place FROM s)"""


@query("text_keywords", f"WITH {_WORDS} SELECT doc, place, word, score FROM k WHERE place <= 10")
def text_keywords(spark, sf_dir):
    return K.tf_idf(table(spark, sf_dir, "documents"))


@query("text_density", f"WITH {_WORDS} SELECT doc, round(least(1.0, avg(score)), 12) AS density FROM k WHERE place <= 10 GROUP BY doc")
def text_density(spark, sf_dir):
    return K.density(K.tf_idf(table(spark, sf_dir, "documents"))).withColumn("density", F.round("density", 12))


@query("text_rank")
def text_rank(spark, sf_dir):
    """Power iteration isn't SQL; tests/test_structure.py has plain Python."""
    return K.text_rank(table(spark, sf_dir, "documents"))


@query("text_prepared")
def text_prepared(spark, sf_dir):
    rows = K.prepared(table(spark, sf_dir, "documents"), languages=("chinese", "mixed", "english"))
    return rows.select("doc", "language", F.md5("text").alias("digest"), "token_count", F.array_join("keywords", " ").alias("keywords"), F.md5("searchable").alias("searchable"))


@query(
    "eval_keyword_coverage",
    f"""WITH d AS (SELECT item_id AS doc_id, text FROM benchmark), {_WORDS.replace('documents', 'd')}, q AS (SELECT doc AS query, list(word) AS keys FROM k WHERE place <= 5 GROUP BY doc),
    p AS (SELECT item_id AS query, doc_id AS doc, d.text FROM benchmark b JOIN documents d ON substr(b.text, 1, 1) = substr(d.text, 1, 1))
    SELECT p.query, doc, round(coalesce(len(list_intersect(keys, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_\\-]+|[\\x{{4e00}}-\\x{{9fff}}]'))) / len(keys), 0), 8) AS coverage FROM p LEFT JOIN q ON q.query = p.query""",
)
def eval_keyword_coverage(spark, sf_dir):
    """A question's keywords among the words of the documents that begin with the same letter."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    pairs = asked.select(F.col("item_id").alias("query"), F.substring("text", 1, 1).alias("c")).join(docs.select(F.col("doc_id").alias("doc"), F.substring("text", 1, 1).alias("c")), "c").select("query", "doc")
    return K.coverage(pairs, K.tf_idf(asked, id_col="item_id"), docs).withColumn("coverage", F.round("coverage", 8))


@query("text_lines")
def text_lines(spark, sf_dir):
    return N.typed(table(spark, sf_dir, "documents")).select("doc", "block", "type", "level", F.md5("content").alias("digest"))


def _boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    at = {"page": F.col("l_suppkey"), "block": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 7).cast("long")), "x": F.round(F.col("l_discount") * 1000) + 300 * (F.col("l_linenumber") % 3), "y": F.pmod(F.round(F.col("l_extendedprice") * 7).cast("long"), F.lit(9973))}
    size = {"width": 40 + 7 * (F.col("l_linenumber") % 5), "height": 10 + F.pmod("l_orderkey", F.lit(23)), "text": F.concat_ws(" ", F.when(F.col("l_linenumber") == 4, "•"), "l_returnflag", "l_linestatus")}
    return rows.select(*[c.alias(n) for n, c in (at | size).items()])


_BOXES = """b AS (SELECT l_suppkey AS page, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(round(l_extendedprice * 7) AS BIGINT) AS block, round(l_discount * 1000) + 300 * (l_linenumber % 3) AS x, CAST(round(l_extendedprice * 7) AS BIGINT) % 9973 AS y, 40 + 7 * (l_linenumber % 5) AS width,
    10 + l_orderkey % 23 AS height, CASE WHEN l_linenumber = 4 THEN '• ' ELSE '' END || l_returnflag || ' ' || l_linestatus AS text FROM lineitem)"""


@query(
    "layout_columns",
    f"""WITH {_BOXES}, e AS (SELECT page, x, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT page, n, x - lag(x) OVER (PARTITION BY page ORDER BY x) AS gap FROM e), m AS (SELECT *, avg(gap) OVER (PARTITION BY page) AS mean FROM g)
    SELECT page, CAST(CASE WHEN sum(n) < 3 THEN 1 ELSE 1 + count(*) FILTER (gap > mean * 2) END AS INTEGER) AS columns FROM m GROUP BY page""",
)
def layout_columns(spark, sf_dir):
    return L.columns(_boxes(spark, sf_dir), "page", "x")


@query("layout_order")
def layout_order(spark, sf_dir):
    """Rows are anchored at their first box, one after the other; tests/test_structure.py has plain Python."""
    return L.reading_order(_boxes(spark, sf_dir), "page", "block", "x", "y").select("page", "block", "columns", "row_y", "place")


@query(
    "layout_kinds",
    f"""WITH {_BOXES}, s AS (SELECT *, avg(height) OVER (PARTITION BY page) AS mean, max(height) OVER (PARTITION BY page) AS top, lag(x) OVER (PARTITION BY page ORDER BY y, block) AS before,
      count(*) OVER near AS beside, max(width) OVER near AS wide, min(width) OVER near AS narrow FROM b WINDOW near AS (PARTITION BY page ORDER BY y RANGE BETWEEN 9 PRECEDING AND 9 FOLLOWING)),
    r AS (SELECT *, (x + width / 2) / 1000 AS middle FROM s)
    SELECT page, block, CASE WHEN height >= mean * 1.5 AND length(text) <= 30 AND ((middle > 0.3 AND middle < 0.7) OR height >= top * 0.9) THEN 'title' WHEN starts_with(text, '•') OR coalesce(x > before + 20, false) THEN 'list_item'
      WHEN beside >= 3 AND wide < narrow * 2 THEN 'table_cell' WHEN height > mean * 1.2 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN height / mean >= 2.0 THEN 1 WHEN height / mean >= 1.5 THEN 2 WHEN height / mean >= 1.2 THEN 3 ELSE 0 END AS level FROM r""",
)
def layout_kinds(spark, sf_dir):
    return L.with_kinds(_boxes(spark, sf_dir), "page", "block", "text", "x", "y", "width", "height", 1000).select("page", "block", "type", "level")


def _formula_texts(spark, sf_dir):
    """A sentence with formulas for each part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.concat(
        F.lit("For "), F.col("p_name"), F.lit(" we have $x_"), key, F.lit(r" = \frac{a^2}{\sqrt{"), size, F.lit(r"}} + \alpha$ and E = m*c^"), F.when(F.col("p_size") % 3 == 0, "2").otherwise("n"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(", so that $$y = \\sum b / k_1$$ holds.")).otherwise(F.lit("; F = a + b - 3, G = H.")), F.lit(" Cost $5 to $9 each."),
    )
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))


@query("text_formulas")
def text_formulas(spark, sf_dir):
    rows = _formula_texts(spark, sf_dir)
    found = rows.select("p_partkey", F.explode(M.formulas("text")).alias("f"))
    return found.select("p_partkey", "f.type", "f.position", "f.raw", M.in_words(F.col("f.type"), F.col("f.formula")).alias("words"), *[F.array_join(c, " ").alias(n) for n, c in M.parts(F.col("f.formula")).items()])


@query("text_formulas_explained")
def text_formulas_explained(spark, sf_dir):
    return _formula_texts(spark, sf_dir).select("p_partkey", M.explained("text").alias("text"))


@query("graph_formula_relations")
def graph_formula_relations(spark, sf_dir):
    found = _formula_texts(spark, sf_dir).select("p_partkey", F.explode(M.formulas("text")).alias("f"))
    return found.select("p_partkey", F.col("f.formula").alias("formula"), F.explode(M.relations(F.col("f.formula"))).alias("r")).select("p_partkey", "formula", "r.*")


@query("text_redacted_messages")
def text_redacted_messages(spark, sf_dir):
    """A conversation turn as a nested message with the turn's text, an address and a link twice, next to the events' own JSON."""
    turns = table(spark, sf_dir, "conversations")
    mail = F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.org"))
    part = F.struct(F.lit("text").alias("type"), F.concat(T.text("text"), F.lit(" mail "), mail).alias("text"))
    link = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("https://host/"), F.col("turn").cast("string")).alias("url"), F.lit("password: abcd").alias("data")).alias("image_url"))
    whole = F.to_json(F.struct(F.col("role"), F.struct(F.array(F.to_json(part), F.to_json(link)).alias("parts"), F.array(part).alias("content")).alias("content"), mail.alias("id"), mail.alias("note")))
    rows = turns.select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("message"), whole.alias("json"))
    events = table(spark, sf_dir, "events").select(F.concat_ws("-", F.lit("event"), "event_id").alias("message"), F.col("props").alias("json"))
    return J.redacted(rows.unionByName(events), "json").select("message", F.md5("json").alias("digest"))


def _checked(spark, sf_dir):
    """The assistants' turns with figures, the turns before as documents, and citations of the last one and (every fifth) of none."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    name = F.concat_ws("-", "conv_id", "turn")
    figures = F.concat(F.lit(" In "), (2000 + F.col("turn") % 4).cast("string"), F.lit(" it was "), (100 + F.col("conv_id") * (F.col("turn") % 3)).cast("string"), F.when(F.col("turn") % 6 == 5, F.concat(F.lit(", ask user"), "conv_id", F.lit("@example.org"))).otherwise(F.lit("")))
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.concat(T.text("text"), figures)).withColumn("doc", F.struct(name.alias("doc"), F.col("said").alias("content")))
    before = F.collect_list("doc").over(w.rowsBetween(-5, -1))
    last = F.lag("doc").over(w)
    cited = F.when(F.col("turn") % 7 == 1, F.array()).when(F.col("turn") % 5 == 3, F.array(F.struct(F.lit("none").alias("doc"), F.lit("7").alias("content")))).otherwise(F.array(F.struct(last["doc"].alias("doc"), F.concat(F.lit("at "), (F.col("turn") * 40).cast("string")).alias("content"))))
    return turns.withColumns({"docs": before, "citations": cited.cast("array<struct<doc:string,content:string>>")}).filter("role = 'assistant'").select("conv_id", "turn", F.col("said").alias("answer"), "docs", "citations")


@query("verify_cascade")
def verify_cascade(spark, sf_dir):
    """Stages feed one another and the last is a function that a caller brings; tests/test_cascade.py has plain Python."""
    out = C.validated(_checked(spark, sf_dir), judge=C.support_judge(), sentences=True)
    return out.select("conv_id", "turn", F.size("stages").alias("stages"), "reached", F.array_join("issues", ",").alias("issues"), "confidence")


def _stores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parents = docs.select(F.concat_ws("-", F.lit("p"), "doc_id").alias("parent_id"), "source", T.text("text").alias("text"))
    chunks = parents.select("parent_id", "source", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 600))).alias("chunk"))
    names = G.entity_counts(docs, pattern=_ENT)
    mentions = names.join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc").select("entity", "source").distinct()
    return {"chunks": chunks, "parents": parents.drop("text"), "registry": docs.select("source").distinct(), "mentions": mentions, "edges": G.edges(_triplets(spark, sf_dir)), "entities": names.select("entity").distinct()}


@query(
    "index_deleted",
    f"""WITH {_TRIPLETS}, g AS (SELECT 'src' || n_nationkey AS source FROM nation WHERE n_regionkey = 0), me AS (SELECT DISTINCT entity, d.source FROM r JOIN documents d ON d.doc_id = r.doc), en AS (SELECT DISTINCT entity FROM r),
    x AS (SELECT head, relation, tail, unnest(sources) AS source FROM ed), e3 AS (SELECT DISTINCT head, relation, tail FROM x WHERE source NOT IN (SELECT source FROM g)),
    m2 AS (SELECT * FROM me WHERE source NOT IN (SELECT source FROM g)), alive AS (SELECT entity FROM m2 UNION SELECT head FROM e3 UNION SELECT tail FROM e3),
    ch AS (SELECT source, 1 + length(coalesce(text, '')) // 600 AS n FROM documents),
    t AS (SELECT 'chunks' AS store, (SELECT sum(n) FROM ch) AS was, (SELECT sum(n) FROM ch WHERE source NOT IN (SELECT source FROM g)) AS rows UNION ALL SELECT 'parents', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE source NOT IN (SELECT source FROM g))
      UNION ALL SELECT 'registry', (SELECT count(DISTINCT source) FROM documents), (SELECT count(DISTINCT source) FROM documents WHERE source NOT IN (SELECT source FROM g)) UNION ALL SELECT 'mentions', (SELECT count(*) FROM me), (SELECT count(*) FROM m2)
      UNION ALL SELECT 'edges', (SELECT count(*) FROM ed), (SELECT count(*) FROM e3) UNION ALL SELECT 'entities', (SELECT count(*) FROM en), (SELECT count(*) FROM en WHERE entity IN (SELECT entity FROM alive)))
    SELECT store, CAST(was - rows AS BIGINT) AS removed, CAST(rows AS BIGINT) AS rows FROM t""",
)
def index_deleted(spark, sf_dir):
    """What is removed from and left in each store when the sources of one region go."""
    stores = _stores(spark, sf_dir)
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    return D.counts(stores, D.without_sources(stores, gone))
