"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fertility, hamming, language, packing, pages, partenum, periodic, phrases, pieces, quality, repeats, urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), partenum.Threshold(85, 100, 4))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("score", "distance")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, targets=packing.equal_targets(docs))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pieces.decode(pieces.encode(docs))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_crc32"), F.char_length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("phrase_rate")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.MEASURES)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


def repeating(doc_id: Column, text: Column) -> Column:
    """The texts of the contract: in a tenth of the documents, the words from a on repeat the first p of them."""
    word = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    changed = F.transform(F.array(word), lambda w: F.struct(w.alias("w"), F.pmod(g, F.size(w)).alias("a")))
    changed = F.transform(changed, lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + F.pmod(g, F.lit(8))))).alias("p")))
    tail = lambda x: F.transform(F.sequence(x["a"], F.size(x["w"]) - 1), lambda i: F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))
    changed = F.transform(changed, lambda x: F.array_join(F.concat(F.slice(x["w"], F.lit(1), x["a"].cast("int")), tail(x)), " "))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(changed, F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic.find_runs(docs, text_col=repeating(F.col("doc_id"), F.col("text")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    out = out.withColumn("longest", F.when(F.size("runs") > 0, longest))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"), (-F.col("longest.m")).alias("length"), F.col("longest.p").alias("period"),
        F.floor(-F.col("longest.m") * 1000 / F.col("longest.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_quality": op2_quality,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_hamming_topk": op4_hamming_topk,
        "op5_packing": op5_packing,
        "op6_html_text": op6_html_text,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_url_filter": op8_url_filter,
        "op9_language_id": op9_language_id,
        "op10_ann": op10_ann,
        "op11_fertility": op11_fertility,
        "op12_collocations": op12_collocations,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_hamming_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.code) + 1), lambda i: CAST(q.code[i] <> c.code[i] AS INTEGER))) AS BIGINT) AS distance
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.code) = len(c.code) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
""",
        "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), single AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM cut
), pairs AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS p FROM cut WHERE len(w) > 1
), triples AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS p FROM cut WHERE len(w) > 2
), f AS (
  SELECT lang, [phrase] AS p, count(*)::HUGEINT AS f FROM single GROUP BY ALL
  UNION ALL SELECT lang, p, count(*)::HUGEINT AS f FROM pairs GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, p, count(*)::HUGEINT AS f FROM triples GROUP BY ALL HAVING count(*) >= 10
), total AS (SELECT lang, count(*) AS n FROM single GROUP BY lang
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM f c CROSS JOIN (VALUES (1), (2)) ks(k) JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)] WHERE len(c.p) > k
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), longer AS (
  SELECT lang, p[1:2] AS p, f FROM f WHERE len(p) = 3 UNION ALL SELECT lang, p[2:3] AS p, f FROM f WHERE len(p) = 3
), kept AS (
  SELECT best.* FROM best ANTI JOIN longer ON best.lang = longer.lang AND best.p = longer.p AND 100 * longer.f >= 50 * best.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
        "op8_url_filter": """
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), urls AS (SELECT DISTINCT host, path FROM split
), best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, split.host, split.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
""",
    }
