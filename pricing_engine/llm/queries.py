"""The operators as queries over whole test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricing_engine.llm import chat, decontamination, language, licenses, quality
from pricing_engine.llm.common import fold, table
from pricing_engine.llm.jaccard import jaccard_components
from pricing_engine.llm.line_dedup import drop_frequent_lines, host_of, page_text
from pricing_engine.llm.mixing import mixed
from pricing_engine.llm.negatives import hard_negatives, in_steps, whole_vectors
from pricing_engine.llm.passages import repeated_passages
from pricing_engine.llm.simhash import near_groups
from pricing_engine.llm.sketches import compared_with_next
from pricing_engine.llm.whitening import whitened
from pricing_engine.session import staged


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labelled ones that are not held out."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    stats = staged(quality.with_statistics(table(spark, sf_dir, "documents")), "stats")
    model = quality.learned(stats, table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices of all documents."""
    return licenses.found_licenses(table(spark, sf_dir, "documents"))


def op3_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one full of control strings, read back from their examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.digests(chat.examples(turns.unionByName(extra)))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that are near duplicates of others."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the group that near fingerprints link."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    return language.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all pages without the boilerplate lines of their hosts."""
    lines = F.split(page_text(F.col("html")), "\n").alias("text")
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), lines)
    # tags are cut out and lines split once
    return drop_frequent_lines(staged(pages, "pages"), "host", "text")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate"
    )


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents, and their likeness to the edited and to the next text."""
    return compared_with_next(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items into documents."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of those whose three-word shingles are alike by 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all vectors along their first four components."""
    rows = table(spark, sf_dir, "embeddings").filter(whole_vectors("embedding"))
    found = whitened(rows.select("vec_id", in_steps("embedding").alias("x")))
    # the operator's sum has any size; the query's column is a long, null beyond it
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all, with every seventh label shifted."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").filter(whole_vectors("embedding"))
    rows = rows.select("vec_id", shifted.alias("label"), in_steps("embedding").alias("x"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {q.__name__: q for q in (op1_quality, op2_licenses, op3_chat_examples, op4_passages, op5_simhash_groups, op6_language, op7_line_dedup, op8_mix_sources, op9_sketches, op10_decontamination, op11_jaccard_join, op12_whitening, op13_hard_negatives)}

OP7_SQL = r"""
WITH shown AS (
  SELECT page_id, url, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages
), broken AS (
  SELECT page_id, url, regexp_replace(regexp_replace(h,
    '(?i)</?(article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
    '<[^>]*>', '', 'g') AS t FROM shown
), p AS (
  SELECT page_id, t, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]*)', 2)), '^www\.', '') AS host FROM broken
), l AS (
  SELECT page_id, host, u.line, u.i FROM p, LATERAL (SELECT unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i) u
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM l
), totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host
), counts AS (SELECT host, key, count(DISTINCT page_id) AS n FROM k WHERE key <> '' GROUP BY host, key
), frequent AS (
  SELECT host, key FROM counts JOIN totals USING (host) WHERE n >= 2 AND n > pages * CAST(0.1 AS DOUBLE)
)
SELECT page_id, host, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS text,
  count(*) AS n_lines, count(f.key) AS n_dropped
FROM k LEFT JOIN frequent f USING (host, key) GROUP BY page_id, host
"""

ORACLES = {"op7_line_dedup": OP7_SQL}
