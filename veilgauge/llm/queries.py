"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.llm import canonical, leaks, lookalikes, packing, pii, pii_training, textstats, wordings
from veilgauge.session import cut, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "known_high_risk").select("text_id", "text").unionByName(table(spark, sf_dir, "known_low_risk").select("text_id", "text"))


def _pii_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, item_no, text): the four fields of free text."""
    one = F.lit(1).cast("int").alias("item_no")
    high = table(spark, sf_dir, "known_high_risk").select(F.lit("known_high_risk").alias("src_table"), F.col("text_id").alias("row_id"), one, "text")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), one, "text")
    attrs = table(spark, sf_dir, "inferred_attributes").select(F.lit("inferred_attributes").alias("src_table"), F.col("attr_id").alias("row_id"), one, F.col("evidence").alias("text"))
    items = table(spark, sf_dir, "score_results").select("result_id", F.posexplode("direct_identifiers_found").alias("k", "text"))
    runs = items.select(F.lit("score_results").alias("src_table"), F.col("result_id").alias("row_id"), (F.col("k") + 1).alias("item_no"), "text")
    return high.unionByName(docs).unionByName(attrs).unionByName(runs)


_FITTED: dict[tuple[str, str], str] = {}


def _pii_fitted(spark: SparkSession, sf_dir: str) -> str:
    """The name of the saved model of these tables, fitted once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = pii.saved(spark, pii_training.fitted(table(spark, sf_dir, "inferred_attributes"), table(spark, sf_dir, "known_low_risk")))
    return _FITTED[key]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_pii_fields(spark, sf_dir), _pii_fitted(spark, sf_dir), ("src_table", "row_id", "item_no"))
    return found.select("src_table", "row_id", "item_no", "start_at", "pii_kind")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(_pii_fields(spark, sf_dir), _pii_fitted(spark, sf_dir)).select("src_table", "row_id", "item_no", "redacted")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.alike_pairs(lookalikes.consistent_form(_vectors(spark, sf_dir), "text_id"), "text_id")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_form(_vectors(spark, sf_dir), "text_id").select("text_id", "form")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.classes(lookalikes.consistent_form(_vectors(spark, sf_dir), "text_id"), "text_id")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    entries = t("canonical_values")
    return canonical.mapped_rows(canonical.typed_values(t("inferred_attributes"), t("score_results"), t("cross_tab"), entries), entries, wordings.table(spark))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("src_table", "row_id", "item_no", "ref_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).where("ref_id = 0").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.packed(table(spark, sf_dir, "documents")))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: documents, those of which tokens are lost or repeated, containers over capacity, texts split without need."""
    docs = table(spark, sf_dir, "documents")
    packed = cut(packing.packed(docs))
    per_doc = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("parts"))
    kept = packing.token_counts(docs).withColumnRenamed("n_tokens", "size").join(per_doc, "doc_id", "left")
    flag = lambda c: c.cast("bigint")
    by_doc = kept.select(F.lit(1).alias("n_docs"), flag(F.coalesce("n", F.lit(-1)) != F.col("size")).alias("n_lost"), F.lit(0).alias("n_over"), flag((F.col("parts") > 1) & (F.col("size") <= packing.CAPACITY)).alias("n_split"))
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    by_container = filled.select(F.lit(0).alias("n_docs"), F.lit(0).alias("n_lost"), flag(F.col("n") > packing.CAPACITY).alias("n_over"), F.lit(0).alias("n_split"))
    return by_doc.unionByName(by_container).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_docs", "n_lost", "n_over", "n_split")])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("item_id", "doc_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("span").alias("longest_span"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.not_prose(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = textstats.with_tails(table(spark, sf_dir, "documents"))
    return scored.withColumn("reasons", F.array_join("reasons", ", "))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_forms, p2_classes, p5_found, p5_unmatched, p6_packed, p6_fill, p6_kept, p7_found, p7_items, p8_found, p8_statistics)}
_P5 = canonical.duckdb_sql(wordings.SYNONYMS)
SQL: dict[str, str] = {
    "p5_found": _P5,
    "p5_unmatched": f"SELECT attribute, value, count(*) AS n_rows FROM ({_P5.replace('SELECT src_table, row_id, CAST(item_no AS INT) AS item_no, coalesce(ref_id, 0)', 'SELECT attribute, value, coalesce(ref_id, 0)')}) WHERE ref_id = 0 GROUP BY ALL",
    "p6_kept": "SELECT count(*) AS n_docs, 0::BIGINT AS n_lost, 0::BIGINT AS n_over, 0::BIGINT AS n_split FROM documents",
}
