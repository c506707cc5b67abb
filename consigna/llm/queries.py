"""The operators as queries on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consigna.llm import arc, chat, collocations, decontaminate, importance, jaccard, lengths, mixing, pii, quality, ring, site_tree, toxicity
from consigna.llm.common import QUERIES as LLM_QUERIES
from consigna.llm.common import query, table

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]

LLM_ORACLE: dict[str, str] = {}


@query("op2_chat")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    ranks = lengths.vocabulary()
    return chat.digests(chat.read_back(chat.format_conversations(turns.union(extra), ranks), ranks))


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality.fit_rules(docs, table(spark, folder, "labels"))
    return quality.score_quality(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_lengths")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.length_histogram(lengths.token_lengths(table(spark, folder, "documents"), [], lengths.vocabulary()))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query("op3_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.annotate(table(spark, folder, "documents"))


@query("op4_html")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return site_tree.extract(table(spark, folder, "pages"))


@query("op7_jaccard")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op8_warc")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return arc.archive_round_trip(table(spark, folder, "pages"))


@query("op11_collocations")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


LLM_ORACLE["op11_collocations"] = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: ws[i:i + k - 1])) AS w
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, w, count(*) AS f FROM grams GROUP BY lang, k, w),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, w, f AS a FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT c.lang, c.w, c.a, cut, x.f AS l, y.f AS r, ((c.a::HUGEINT * 2000000) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.w = c.w[1:cut] JOIN f y ON y.lang = c.lang AND y.w = c.w[cut + 1:c.k]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) AS p FROM cuts) WHERE p = 1),
inner_parts AS (SELECT lang, w[i:i + m - 1] AS w, a FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (
  SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k > 2))),
longer AS (SELECT lang, w, max(a) AS most FROM inner_parts GROUP BY lang, w),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.w, ' ')) AS rank,
    array_to_string(b.w, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.w = b.w WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


@query("op12_ring")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ring.shard_documents(table(spark, folder, "documents"))


@query("op13_importance")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
