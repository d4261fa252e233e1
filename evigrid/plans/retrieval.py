"""Retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import retrieval as R
from evigrid.sources.tables import table

#: SQL of the tokenizer, shared by the oracles.
TERMS = r"""list_reduce(list_transform(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[가-힣]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*'),
  lambda w: CASE WHEN NOT regexp_matches(w, '^[가-힣]') THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END), lambda a, b: a || b, CAST([] AS VARCHAR[]))"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", T.search_terms(F.col("text")).alias("terms"))
    return each.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), id_col="doc_id", text_col="text", query_id="query_id", query_col="text")


def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(all_matches(spark, sf_dir), 20).select("query_id", "rank", "id", "score")


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_matches(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("matches"), F.round(F.max("score"), 6).alias("best"))


def vector_hits(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    return R.nearest(vectors, queries, 20, id_col="vec_id", vector_col="embedding", filters=("label",))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    return vector_hits(v, v.filter("vec_id % 100 = 0")).select("query_id", "rank", "id", "score")


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks with its text and with the vector of its id."""
    lexical = R.top(all_matches(spark, sf_dir), 20).select("query_id", "id", "rank")
    v = table(spark, sf_dir, "embeddings")
    asked = v.join(_queries(spark, sf_dir).select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    vector = vector_hits(v, asked).select("query_id", "id", "rank")
    return R.fuse([lexical, vector], 12).select("query_id", "rank", "id", "score", "routes")


def literal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.literal_count(F.col("text"), "of the").alias("of_the"), T.literal_count(F.col("text"), "tion").alias("tion")).filter("of_the > 0 or tion > 0")


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(R.density(F.col("text"), "(?:the|le|der|el)[^a-z]"), 6).alias("density"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequencies(R.term_lists(table(spark, sf_dir, "documents"), "doc_id", "text")).filter("df >= 5")


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = R.corpus_of(R.term_lists(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return corpus.select("n", "total", F.round(F.col("total") / F.col("n"), 6).alias("avg_len"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at most 160 characters that stand in at least max(3, 20 %) of a source's documents."""
    return R.repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits carry a text hash; a third of them is spoilt, and must be rejected."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    hits = d.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit("stale")).otherwise(F.col("h")).alias("h"))
    return R.admit(hits, d, ("lang",), id_col="doc_id", hash_col="h").groupBy("lang").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))


def evidence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_top20(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.char_length("text") / 4).alias("tokens")), "id")
    return R.pack_evidence(hits.select(F.col("query_id").alias("claim"), "rank", F.col("id").alias("bundle"), "tokens", F.floor(F.col("tokens") / 3).alias("shared")))


BM25 = (
    """
WITH d AS (SELECT doc_id AS id, """
    + TERMS.format("text")
    + """ AS terms FROM documents WHERE trim(coalesce(text, '')) <> ''),
corpus AS (SELECT count(*) AS n, sum(len(terms)) AS total FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest("""
    + TERMS.format("text")
    + """) AS term FROM benchmark),
p AS (SELECT id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * n / total))) AS raw
      FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN corpus GROUP BY query_id, id)
"""
)
KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label FROM embeddings WHERE {asked}),
k AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM embeddings e JOIN q ON e.label IS NOT DISTINCT FROM q.label),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM k QUALIFY rank <= 20)
"""
RANKED = """, l AS (SELECT query_id, id, round(raw, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS INTEGER) AS rank FROM s WHERE raw > 0 QUALIFY rank <= 20)
"""

QUERIES = {
    "q1_search_terms": (terms, f"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {TERMS.format('text')} AS t FROM documents)"),
    "q2_bm25_top20": (bm25_top20, BM25 + RANKED + "SELECT query_id, rank, id, score FROM l"),
    "q3_bm25_exhaustive": (bm25_all, BM25 + "SELECT query_id, count(*) AS matches, round(max(raw), 6) AS best FROM s WHERE raw > 0 GROUP BY query_id"),
    "q4_knn_filtered": (knn_filtered, KNN.format(asked="vec_id % 100 = 0") + "SELECT query_id, rank, id, score FROM v"),
    "q5_rank_fusion": (rank_fusion, BM25 + RANKED + KNN.format(asked="vec_id IN (SELECT item_id FROM benchmark)").replace("WITH q AS", ", q2 AS").replace("JOIN q ON", "JOIN q2 ON").replace("q.label", "q2.label") + """
, r AS (SELECT query_id, id, rank FROM l UNION ALL SELECT query_id, id, rank FROM v), g AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS routes FROM r GROUP BY query_id, id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score, routes FROM g QUALIFY rank <= 12"""),
    "q6_evidence_packing": (evidence_packing, None),
    "q7_admitted_hits": (admission, "SELECT lang, count(*) FILTER (doc_id % 3 <> 0) AS admitted, count(*) FILTER (doc_id % 3 = 0) AS rejected FROM documents GROUP BY lang"),
    "q9_literal_hits": (literal_hits, r"""WITH s AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents), c AS (
SELECT doc_id, CAST((length(t) - length(replace(t, 'ofthe', ''))) / 5 AS BIGINT) AS of_the, CAST((length(t) - length(replace(t, 'tion', ''))) / 4 AS BIGINT) AS tion FROM s)
SELECT * FROM c WHERE of_the > 0 OR tion > 0"""),
    "a11_repeated_lines": (repeated_lines, r"""WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source)
SELECT l.source, line, count(*) AS pages FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source WHERE line <> '' AND length(line) <= 160 GROUP BY l.source, line, n HAVING count(*) >= greatest(3, 0.2 * n)"""),
    "a12_keyword_density": (keyword_density, "SELECT doc_id, round(len(regexp_extract_all(text, '(?:the|le|der|el)[^a-z]')) * 1000.0 / greatest(length(text), 200), 6) AS density FROM documents"),
    "a14_document_frequency": (document_frequency, f"WITH t AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents WHERE trim(text) <> '') SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 5"),
    "a14_corpus_statistics": (corpus_statistics, f"SELECT count(*) AS n, CAST(sum(len({TERMS.format('text')})) AS BIGINT) AS total, round(sum(len({TERMS.format('text')})) / count(*), 6) AS avg_len FROM documents WHERE trim(text) <> ''"),
}
