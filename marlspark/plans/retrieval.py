"""Retrieval queries: BM25, vectors, fusion, expansion, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.functions import text
from marlspark.operators import context, search, vector_best
from marlspark.plans.base import query, read

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
BM25 = rf"""
t AS (SELECT doc_id, lang, source, {TOKENS} AS terms FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS avgdl FROM t),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
p AS (SELECT doc_id, lang, source, len(terms) AS dl, unnest(terms) AS term FROM t),
c AS (SELECT doc_id, lang, source, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
r AS (SELECT query_id, doc_id, any_value(lang) AS lang, any_value(source) AS source,
        round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM c JOIN d USING (term) JOIN q USING (term), s GROUP BY query_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _lexical(spark: SparkSession, sf_dir: str, k: int, keep: object = None) -> DataFrame:
    columns = ["doc_id", "text"] if keep is None else ["doc_id", "text", "lang"]
    return search.bm25(_docs(spark, sf_dir).select(*columns), _questions(spark, sf_dir), k, keep)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark text."""
    return _lexical(spark, sf_dir, 10)


@query(f"WITH {BM25} SELECT doc_id, score, rank FROM k WHERE query_id = 0 AND rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of one text."""
    asked = _questions(spark, sf_dir).where("query_id = 0")
    return search.bm25(_docs(spark, sf_dir).select("doc_id", "text"), asked, search.TOP_K).select("doc_id", "score", "rank")


@query(
    f"""WITH {BM25}, f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE lang = 'es')
    SELECT * FROM f WHERE rank <= 10"""
)
def bm25_category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one category only; the corpus counts stay those of all documents."""
    return _lexical(spark, sf_dir, 10, F.col("lang") == "es")


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    # The stated query set: every vector whose id is divisible by 20.
    asked = rows.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))
    return rows, asked


VECTORS = """
v AS (SELECT q.vec_id AS query_id, p.vec_id AS id, p.label, q.label AS query_label,
        round(greatest(-1, least(1, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])))), 6) AS similarity
      FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0)"""


@query(f"WITH {VECTORS}, k AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM v) SELECT * FROM k WHERE rank <= 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each query vector."""
    points, asked = _points(spark, sf_dir)
    return search.vector_search(points.drop("label"), asked.drop("query_label"), search.CANDIDATES)


@query(
    f"WITH {VECTORS}, k AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM v WHERE similarity >= 0.45) SELECT * FROM k WHERE rank <= 20"
)
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of at least the least similarity."""
    points, asked = _points(spark, sf_dir)
    return search.vector_search(points.drop("label"), asked.drop("query_label"), search.CANDIDATES, search.MIN_SIMILARITY)


@query(
    f"""WITH {VECTORS}, f AS (SELECT v.* FROM v LEFT JOIN labels l ON l.doc_id = v.id WHERE v.label = query_label AND coalesce(l.quality, 1) = 1),
    k AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM f) SELECT * FROM k WHERE rank <= 20"""
)
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of the query's category that are active; a missing flag counts as active."""
    points, asked = _points(spark, sf_dir)
    state = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    active = points.join(state, "id", "left").where(F.coalesce("quality", F.lit(1)) == 1).drop("quality")
    dealt = active.repartition(spark.sparkContext.defaultParallelism, "id")  # few files are few tasks else
    found = vector_best.vector_best(dealt, asked.withColumn("own", F.lit(True)), search.CANDIDATES, same=("label", "query_label"), odd=True)
    return search.top_per_query(found.select("query_id", "id", "similarity"), search.CANDIDATES, "similarity", F.asc_nulls_last("id"))


@query(
    f"""WITH {BM25}, {VECTORS},
    b AS (SELECT query_id, doc_id, rank, score FROM k WHERE rank <= 20),
    w AS (SELECT query_id, id AS doc_id, similarity AS score, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM v WHERE similarity >= 0.45),
    x AS (SELECT * FROM w WHERE rank <= 20 AND query_id IN (SELECT item_id FROM benchmark)),
    f AS (SELECT coalesce(b.query_id, x.query_id) AS query_id, coalesce(b.doc_id, x.doc_id) AS doc_id, b.rank AS bm25_rank, b.score AS bm25_score,
            x.rank AS vector_rank, x.score AS similarity, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS rrf_score
          FROM b FULL JOIN x ON b.query_id = x.query_id AND b.doc_id = x.doc_id),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM f)
    SELECT * FROM g WHERE rank <= 5"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vector candidates fused by reciprocal rank; vectors of the same id stand for the query texts."""
    points, asked = _points(spark, sf_dir)
    known = asked.drop("query_label").join(_questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    vector = search.vector_search(points.drop("label"), known, search.CANDIDATES, search.MIN_SIMILARITY)
    vector = vector.select("query_id", F.col("id").alias("doc_id"), "rank", F.col("similarity").alias("score"))
    return search.fuse(_lexical(spark, sf_dir, search.CANDIDATES), vector, search.TOP_K)


@query(
    f"""WITH {BM25}, b AS (SELECT query_id, doc_id, rank, score FROM k WHERE rank <= 20),
    e2 AS (SELECT count(*) AS n FROM embeddings), t2 AS (SELECT query_id, doc_id % e2.n AS vec_id FROM b, e2 WHERE rank = 2),
    v AS (SELECT t2.query_id, y.vec_id AS doc_id, round(greatest(-1, least(1, list_dot_product(CAST(z.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 6) AS score FROM t2 JOIN embeddings z ON z.vec_id = t2.vec_id, embeddings y),
    x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v WHERE score >= 0.1) WHERE rank <= 20),
    f AS (SELECT coalesce(b.query_id, x.query_id) AS query_id, coalesce(b.doc_id, x.doc_id) AS doc_id, b.rank AS bm25_rank, x.rank AS vector_rank, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS rrf_score
          FROM b FULL JOIN x ON b.query_id = x.query_id AND b.doc_id = x.doc_id),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM f)
    SELECT * FROM g WHERE rank <= 10"""
)
def hybrid_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion where both branches meet: a query's vector is that of its second best document, so this and its neighbours come from both sides or either."""
    lexical = _lexical(spark, sf_dir, search.CANDIDATES)
    points = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = lexical.where(F.col("rank") == 2).select("query_id", (F.col("doc_id") % n).alias("id")).join(points, "id").select("query_id", F.col("embedding").alias("vector"))
    vector = search.vector_search(points, asked, search.CANDIDATES, 0.1)
    fused = search.fuse(lexical, vector.select("query_id", F.col("id").alias("doc_id"), "rank", F.col("similarity").alias("score")), 10)
    return fused.select("query_id", "doc_id", "bm25_rank", "vector_rank", "rrf_score", "rank")


def _sources_hit(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    best = _lexical(spark, sf_dir, k)
    return best.join(_docs(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")


@query(
    f"""WITH {BM25}, b AS (SELECT * FROM k WHERE rank <= 20), f AS (SELECT query_id, source, min(rank) AS first FROM b GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS key_rank FROM f),
    e AS (SELECT query_id, d.doc_id AS chunk_id, o.source, key_rank, row_number() OVER (PARTITION BY query_id ORDER BY key_rank, d.doc_id) AS position
          FROM documents d JOIN o ON d.source = o.source WHERE key_rank <= 3)
    SELECT query_id, chunk_id, source, CAST(key_rank AS INTEGER) AS key_rank, CAST(position AS INTEGER) AS position FROM e WHERE position <= 101"""
)
def doc_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents (here: sources) of the best chunks, at most three, 100 chunks and one to tell of more."""
    chosen = search.ordered_distinct(_sources_hit(spark, sf_dir), "source", 3)
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "source")
    return search.expand_documents(chunks, chosen, "source", 100).select("query_id", "chunk_id", "source", "key_rank", "position")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") > 8000, "long").when(F.col("n_chars") > 400, "plain")
    path = F.filter(F.array("lang", size), lambda x: x.isNotNull())
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), path.alias("path"))


PATHS = "h AS (SELECT doc_id AS chunk_id, source AS document_id, CASE WHEN n_chars > 8000 THEN [lang, 'long'] WHEN n_chars > 400 THEN [lang, 'plain'] ELSE [lang] END AS path FROM documents)"
SCOPES = f"{BM25}, {PATHS}, b AS (SELECT k.query_id, h.document_id, CASE WHEN rank % 2 = 0 THEN path ELSE path[1:1] END AS scope, min(rank) AS rank FROM k JOIN h ON h.chunk_id = k.doc_id WHERE rank <= 5 GROUP BY ALL)"


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lexical(spark, sf_dir, 5).join(_paths(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id"), "doc_id")
    scope = F.when(F.col("rank") % 2 == 0, F.col("path")).otherwise(F.slice("path", 1, 1))
    return hits.select("query_id", "document_id", scope.alias("scope"), "rank").groupBy("query_id", "document_id", "scope").agg(F.min("rank").alias("rank"))


@query(f"WITH {SCOPES} SELECT b.query_id, h.chunk_id, CAST(min(b.rank) AS INTEGER) AS scope_rank FROM h JOIN b ON h.document_id = b.document_id AND h.path[1:len(b.scope)] = b.scope GROUP BY ALL")
def section_expansion_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks under the scopes of the best chunks, at their least scope rank."""
    return search.expand_sections(_paths(spark, sf_dir), _scopes(spark, sf_dir))


@query(
    f"""WITH {PATHS}, a AS (SELECT DISTINCT document_id, path AS scope FROM h)
    SELECT document_id, array_to_string(scope, '/') AS scope FROM a WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.document_id = a.document_id AND len(o.scope) > len(a.scope) AND o.scope[1:len(a.scope)] = a.scope)"""
)
def scope_anti_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes that no longer scope of their document starts with."""
    scopes = _paths(spark, sf_dir).select("document_id", F.col("path").alias("scope")).distinct()
    return search.drop_prefix_scopes(scopes).select("document_id", F.array_join("scope", "/").alias("scope"))


@query(
    f"""WITH {PATHS}, a AS (SELECT DISTINCT document_id, path[1:1] AS scope FROM h),
    c AS (SELECT h.document_id, a.scope, h.path[len(a.scope) + 1] AS child, min(chunk_id) AS pos FROM h JOIN a ON h.document_id = a.document_id AND h.path[1:len(a.scope)] = a.scope AND len(h.path) > len(a.scope) GROUP BY ALL)
    SELECT a.document_id, a.scope[1] AS scope, coalesce(string_agg(child, ',' ORDER BY pos), '') AS children FROM a LEFT JOIN c USING (document_id, scope) GROUP BY ALL"""
)
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct children of each top section, in order."""
    chunks = _paths(spark, sf_dir)
    scopes = chunks.select("document_id", F.slice("path", 1, 1).alias("scope")).distinct()
    return search.direct_children(chunks, scopes).select("document_id", F.get("scope", F.lit(0)).alias("scope"), F.array_join("children", ",").alias("children"))


@query(
    f"""WITH {PATHS}, w AS (SELECT *, row_number() OVER (PARTITION BY document_id, path[1] = 'en', CASE WHEN path[1] = 'en' THEN coalesce(path[2], '-') ELSE CAST(chunk_id AS VARCHAR) END ORDER BY chunk_id) AS n FROM h)
    SELECT document_id, chunk_id FROM w WHERE n = 1"""
)
def condense_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each child of a broad scope; all others stay."""
    chunks = _paths(spark, sf_dir)
    scopes = chunks.where(F.get("path", F.lit(0)) == "en").select("document_id", F.array(F.lit("en")).alias("scope")).distinct()
    return search.condense(chunks, scopes).select("document_id", "chunk_id")


FORM = "trim(regexp_replace(replace(strip_accents(lower(coalesce(text, ''))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    rf"""WITH g AS (SELECT conv_id, turn, ['Chính sách đổi trả: ', 'Chi tiết ', 'Liệt kê ', 'có áo ở đâu ', ''][(conv_id + turn) % 5 + 1] || coalesce(text, '') AS text FROM conversations), f AS (SELECT conv_id, turn, {FORM} AS v FROM g)
    SELECT conv_id, turn, regexp_matches(v, '{text.POLICY}') AS policy, regexp_matches(v, '{text.POLICY}') OR regexp_matches(v, '{text.SECTION}') AS section,
           regexp_matches(v, '{text.LISTING}') OR regexp_matches(v, '{text.WHERE_IS}') AS document FROM f"""
)
def intent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which context each message asks for; most are opened with a phrase that asks for one."""
    opening = F.get(F.array(*map(F.lit, ["Chính sách đổi trả: ", "Chi tiết ", "Liệt kê ", "có áo ở đâu ", ""])), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    form = text.query_form(F.concat(opening, F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.needs_policy(form).alias("policy"), text.needs_section(form).alias("section"), text.needs_document(form).alias("document")
    )


STOP = "[" + ", ".join(f"'{w}'" for w in [*text.STOPWORDS, ""]) + "]"


@query(
    rf"""WITH {BM25}, q2 AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split({FORM}, ' '), lambda x: NOT list_contains({STOP}, x))) AS a FROM benchmark),
    h AS (SELECT doc_id, list_distinct(list_filter(string_split({FORM.replace("coalesce(text, '')", "string_split(coalesce(text, ''), chr(10))[1]")}, ' '), lambda x: NOT list_contains({STOP}, x))) AS b FROM documents),
    o AS (SELECT k.query_id, k.doc_id, len(a) AS n, len(b) AS m, len(list_intersect(a, b)) AS shared FROM k JOIN q2 USING (query_id) JOIN h USING (doc_id) WHERE rank <= 5)
    SELECT query_id, doc_id, CAST(shared AS INTEGER) AS shared, n >= 3 AND shared >= 3 AND (shared::DOUBLE / n >= 0.5 OR shared::DOUBLE / greatest(m, 1) >= 0.6) AS strong FROM o"""
)
def heading_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query asks for the section whose heading (a document's first line) a hit has."""
    asked = _questions(spark, sf_dir).select("query_id", text.key_terms(text.query_form(F.col("query"))).alias("a"))
    heads = _docs(spark, sf_dir).select("doc_id", text.key_terms(text.query_form(F.get(F.split("text", "\n"), F.lit(0)))).alias("b"))
    rows = _lexical(spark, sf_dir, 5).join(asked, "query_id").join(heads, "doc_id")
    return rows.select("query_id", "doc_id", F.size(F.array_intersect("a", "b")).alias("shared"), text.heading_overlap(F.col("a"), F.col("b")).alias("strong"))


def _form(value: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower({value})), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


def _terms(value: str) -> str:
    return f"list_distinct(list_filter(string_split({_form(value)}, ' '), lambda x: NOT list_contains({STOP}, x)))"


SHARED = "len(list_intersect(terms, h))"


@query(
    rf"""WITH {BM25}, g AS (SELECT doc_id, source AS document_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')[1:12] AS w FROM documents),
    p2 AS (SELECT doc_id, document_id, list_concat(['1. ' || array_to_string(w[1:4], ' '), '1.' || (doc_id % 3 + 1) || ' ' || array_to_string(w[5:8], ' ')],
             CASE WHEN doc_id % 2 = 1 THEN [array_to_string(w[9:12], ' ')] ELSE [] END) AS path FROM g),
    q2 AS (SELECT item_id AS query_id, {_form("text")} AS form, {_terms("text")} AS terms FROM benchmark),
    r2 AS (SELECT k.query_id, document_id, path, rank, terms, form, list_transform(path, lambda v: {_terms("v")}) AS heads FROM k JOIN p2 USING (doc_id) JOIN q2 USING (query_id) WHERE rank <= 5),
    s2 AS (SELECT *, list_transform(heads, lambda h: {SHARED}) AS scores,
             len(list_filter(heads, lambda h: len(terms) >= 3 AND {SHARED} >= 3 AND ({SHARED}::DOUBLE / len(terms) >= 0.5 OR {SHARED}::DOUBLE / greatest(len(h), 1) >= 0.6))) > 0
             OR regexp_matches(form, '{text.POLICY}') OR regexp_matches(form, '{text.SECTION}') AS wide FROM r2),
    t2 AS (SELECT *, bool_or(wide) OVER (PARTITION BY query_id) AS broad FROM s2),
    l2 AS (SELECT *, coalesce(list_max(list_transform(path, lambda v, i: CASE WHEN regexp_matches(v, '{text.NUMBERED}') THEN i END)), 0) AS last FROM t2),
    m2 AS (SELECT *, regexp_extract(regexp_extract(path[last], '^(\d+(?:\.\d+)*)', 1), '^(.*)\.\d+$', 1) AS parent FROM l2),
    o2 AS (SELECT *, CASE WHEN last > 0 AND length(parent) > 0 THEN list_max(list_transform(path, lambda v, i: CASE WHEN i < last AND regexp_extract(v, '^(\d+(?:\.\d+)*)[.)]?\s+', 1) = parent THEN i END)) END AS above FROM m2),
    u2 AS (SELECT query_id, document_id, terms, CASE WHEN broad AND list_max(scores) >= 2 THEN path[1:list_position(scores, list_max(scores))] WHEN broad AND above > 0 THEN path[1:above] WHEN last > 0 THEN path[1:last] ELSE path END AS scope, min(rank) AS rank FROM o2 GROUP BY ALL),
    v2 AS (SELECT *, len(list_intersect(terms, {_terms("scope[len(scope)]")})) AS last FROM u2 x WHERE NOT EXISTS
            (SELECT 1 FROM u2 y WHERE x.query_id = y.query_id AND x.document_id = y.document_id AND len(y.scope) > len(x.scope) AND y.scope[1:len(x.scope)] = x.scope)),
    w2 AS (SELECT *, max(last) OVER (PARTITION BY query_id) AS strongest FROM v2)
    SELECT query_id, document_id, array_to_string(scope, '/') AS scope, CAST(rank AS INTEGER) AS rank FROM w2 WHERE strongest < 2 OR last = strongest"""
)
def section_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that the best hits stand for; a document's path is made of its first words, numbered as in an outline."""
    w = F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 12)
    part = lambda i: F.array_join(F.slice("w", i, 4), " ")
    path = F.array(F.concat(F.lit("1. "), part(1)), F.concat(F.lit("1."), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(" "), part(5)))
    paths = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("document_id"), w.alias("w")).select("doc_id", "document_id", F.when(F.col("doc_id") % 2 == 1, F.concat(path, F.array(part(9)))).otherwise(path).alias("path"))
    hits = _lexical(spark, sf_dir, 5).select("query_id", "doc_id", "rank").join(paths, "doc_id")
    return search.select_scopes(hits, _questions(spark, sf_dir)).select("query_id", "document_id", F.array_join("scope", "/").alias("scope"), "rank")


ASKED = "asked AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Tổng quan ' ELSE '' END || text AS text FROM benchmark)"


@query(
    rf"""WITH {ASKED}, {BM25.replace("FROM benchmark", "FROM asked")},
    g AS (SELECT doc_id, coalesce(lang, 'none') AS document_id, ['PHẦN ' || CASE WHEN doc_id % 4 < 2 THEN 'I' ELSE 'II' END || ' ' || coalesce(lang, 'none')]
            || CASE WHEN doc_id % 7 > 0 THEN [(1 + doc_id % 3) || '. ' || CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] ELSE [] END
            || CASE WHEN doc_id % 7 > 3 THEN [(1 + doc_id % 3) || '.' || (1 + doc_id % 5) || ' ' || array_to_string(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')[1:4], ' ')] ELSE [] END AS path FROM documents),
    q2 AS (SELECT item_id AS query_id, {_form("text")} AS form, {_terms("text")} AS terms FROM asked),
    r2 AS (SELECT k.query_id, document_id, path, rank, terms, form, list_transform(path, lambda v: {_terms("v")}) AS heads FROM k JOIN g USING (doc_id) JOIN q2 USING (query_id) WHERE rank <= 5),
    s2 AS (SELECT *, list_transform(heads, lambda h: {SHARED}) AS scores,
             len(list_filter(heads, lambda h: len(terms) >= 3 AND {SHARED} >= 3 AND ({SHARED}::DOUBLE / len(terms) >= 0.5 OR {SHARED}::DOUBLE / greatest(len(h), 1) >= 0.6))) > 0
             OR regexp_matches(form, '{text.POLICY}') OR regexp_matches(form, '{text.SECTION}') AS wide FROM r2),
    t2 AS (SELECT *, bool_or(wide) OVER (PARTITION BY query_id) AS broad FROM s2),
    u2 AS (SELECT query_id, document_id, terms, CASE WHEN broad AND list_max(scores) >= 2 THEN path[1:list_position(scores, list_max(scores))] WHEN broad THEN path[1:least(2, len(path))] ELSE path END AS scope, min(rank) AS rank FROM t2 GROUP BY ALL),
    v2 AS (SELECT *, len(list_intersect(terms, {_terms("scope[len(scope)]")})) AS last FROM u2 x WHERE NOT EXISTS
            (SELECT 1 FROM u2 y WHERE x.query_id = y.query_id AND x.document_id = y.document_id AND len(y.scope) > len(x.scope) AND y.scope[1:len(x.scope)] = x.scope)),
    w2 AS (SELECT *, max(last) OVER (PARTITION BY query_id) AS strongest FROM v2),
    x2 AS (SELECT query_id, document_id, scope, row_number() OVER (PARTITION BY query_id ORDER BY rank, document_id, scope) AS scope_rank, count(*) OVER (PARTITION BY query_id) > 3 AS more FROM w2 WHERE strongest < 2 OR last = strongest),
    e2 AS (SELECT x2.query_id, g.document_id, g.doc_id AS chunk_id, any_value(g.path) AS path, min(scope_rank) AS scope_rank, any_value(more) AS more FROM x2 JOIN g ON g.document_id = x2.document_id AND g.path[1:len(x2.scope)] = x2.scope WHERE x2.scope_rank <= 3 GROUP BY ALL),
    f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY scope_rank, chunk_id) AS spot, more OR count(*) OVER (PARTITION BY query_id) > 100 AS limited FROM e2),
    h2 AS (SELECT f2.*, x2.scope AS part FROM f2 LEFT JOIN x2 ON x2.query_id = f2.query_id AND x2.scope_rank <= 3 AND x2.document_id = f2.document_id AND f2.path[1:len(x2.scope)] = x2.scope AND regexp_matches({_form("x2.scope[len(x2.scope)]")}, '^phan\s+[ivxlcdm]+\b') WHERE spot <= 100),
    i2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, coalesce(part, path), CASE WHEN part IS NULL THEN chunk_id::VARCHAR ELSE coalesce('/' || path[len(part) + 1], '') END ORDER BY spot) AS n FROM h2)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot) AS INTEGER) AS position, document_id, chunk_id, CAST(scope_rank AS INTEGER) AS scope_rank, limited FROM i2 WHERE n = 1"""
)
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that shows sections, end to end: hits, the scopes they stand for, the first three expanded to 100 chunks, parts condensed.

    A document (here: a language) has two parts with numbered sections; every third query asks for an overview.
    """
    docs, key = _docs(spark, sf_dir), F.col("doc_id")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.when(F.col("item_id") % 3 == 0, "Tổng quan ").otherwise(""), "text").alias("query"))
    kind = F.coalesce("lang", F.lit("none"))
    number = (key % 3 + 1).cast("string")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 4), " ")
    heads = [
        F.concat(F.lit("PHẦN "), F.when(key % 4 < 2, "I").otherwise("II"), F.lit(" "), kind),
        F.when(key % 7 > 0, F.concat(number, F.lit(". "), F.when(F.col("n_chars") > 2000, "long").otherwise("short"))),
        F.when(key % 7 > 3, F.concat(number, F.lit("."), (key % 5 + 1).cast("string"), F.lit(" "), words)),
    ]
    chunks = docs.select(key.alias("chunk_id"), kind.alias("document_id"), F.array_compact(F.array(*heads)).alias("path"))
    best = search.bm25(docs.select("doc_id", "text"), asked, 5)
    hits = best.join(chunks.withColumnRenamed("chunk_id", "doc_id"), "doc_id").select("query_id", "document_id", "path", "rank")
    return search.expand_selected(chunks, search.select_scopes(hits, asked))


@query()
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each query: its best chunks in order, within 6,000 characters."""
    rows = _lexical(spark, sf_dir, 5).join(_docs(spark, sf_dir).select("doc_id", "text", "source", "lang"), "doc_id")
    rows = rows.select("query_id", "rank", F.col("source").alias("title"), F.array("lang").alias("path"), F.col("text").alias("content"))
    return context.assemble(rows)


@query(
    """WITH s AS (SELECT DISTINCT source, lang FROM documents),
    a AS (SELECT page_id, 'src' || (page_id % 20) AS source, regexp_extract(url, '://[^/]*/([a-z]{2})/', 1) AS lang FROM pages)
    SELECT s.source, s.lang, coalesce(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id), '') AS assets FROM s LEFT JOIN a USING (source, lang) GROUP BY ALL"""
)
def asset_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the list of their sections' assets, empty where there are none."""
    sources = _docs(spark, sf_dir).select("source", "lang").distinct()
    assets = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id") % 20).alias("source"), F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1).alias("lang"))
    nested = assets.groupBy("source", "lang").agg(F.array_sort(F.collect_list("page_id")).alias("assets"))
    return sources.join(nested, ["source", "lang"], "left").select("source", "lang", F.coalesce(F.array_join("assets", ","), F.lit("")).alias("assets"))


@query(
    f"""WITH {BM25}, w AS (SELECT query_id, doc_id, score, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS next, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM r)
    SELECT query_id, doc_id, score, round(score - coalesce(next, 0), 6) AS margin FROM w WHERE n = 1"""
)
def bm25_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each query and its lead over the second."""
    best = _lexical(spark, sf_dir, 2).groupBy("query_id").agg(F.max_by("doc_id", -F.col("rank")).alias("doc_id"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    return best.select("query_id", "doc_id", "score", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))


@query(
    """WITH m AS (SELECT conv_id, trim(CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN '   ' WHEN conv_id % 11 = 5 THEN repeat(text, 40) WHEN conv_id % 13 = 6 THEN repeat(text, 12) ELSE text END) AS text FROM conversations),
    o AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars, max(length(text)) AS longest, min(length(text)) AS shortest FROM m GROUP BY conv_id)
    SELECT conv_id, CAST(n AS BIGINT) AS n, CAST(chars AS BIGINT) AS chars, CASE WHEN n > 12 THEN 'too_many' WHEN shortest < 1 THEN 'empty' WHEN longest > 20000 THEN 'too_long' WHEN chars > 24000 THEN 'too_long_together' ELSE 'ok' END AS state FROM o"""
)
def history_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether chat histories are within bounds: messages, each without outer blanks and not empty, length of each, length of all. Some have a blank message or longer ones."""
    turn, c = F.col("text"), F.col("conv_id")
    given = F.when((c % 9 == 4) & (F.col("turn") == 1), "   ").when(c % 11 == 5, F.repeat(turn, F.lit(40))).when(c % 13 == 6, F.repeat(turn, F.lit(12))).otherwise(turn)
    size = F.length(F.trim(given))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"), F.max(size).alias("longest"), F.min(size).alias("shortest"))
    state = F.when(F.col("n") > 12, "too_many").when(F.col("shortest") < 1, "empty").when(F.col("longest") > 20000, "too_long").when(F.col("chars") > 24000, "too_long_together").otherwise("ok")
    return rows.select("conv_id", "n", "chars", state.alias("state"))


@query(
    f"""WITH {BM25}, g AS (SELECT query_id, string_agg('[S' || rank || ']', ' ' ORDER BY rank) AS c FROM k WHERE rank <= 3 GROUP BY query_id)
    SELECT item_id AS query_id, concat_ws(' ', trim(b.text), g.c) AS answer FROM benchmark b LEFT JOIN g ON g.query_id = item_id"""
)
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with the numbers of its three best sources behind it."""
    ids = _lexical(spark, sf_dir, 3).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ids"))
    rows = _questions(spark, sf_dir).join(ids, "query_id", "left")
    return rows.select("query_id", F.when(F.col("ids").isNull(), F.trim("query")).otherwise(text.citations(F.col("query"), F.col("ids"))).alias("answer"))
