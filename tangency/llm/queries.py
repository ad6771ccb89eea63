"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.llm import chat, importance, infill, language, mixing, packing, repetition, simhash, substrings, topk, toxicity, warc, webpage
from tangency.llm.common import shared_dir, table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, ties and repeats as in simhash.near_duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix; nulls, ties and repeats as in mixing.mix."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence; nulls and repeats as in packing.pack_documents."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed of every document; nulls, repeats and short texts as in substrings.remove_repeats."""
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector; unusable vectors, ties and repeats as in topk.top_k."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; nulls and texts without letters as in language.identify."""
    return language.identified(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; nulls, broken markup and empty pages as in webpage.extracted."""
    return webpage.extracted(table(spark, sf_dir, "pages"))


def op8_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document; nulls and empty texts as in repetition.quality."""
    return repetition.quality(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of maximal conversations; nulls, ties and repeats as in chat.rendered_turns."""
    return chat.rendered_turns(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; nulls and repeats as in toxicity.score."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document; nulls, empty texts, marks and repeats as in infill.transformed."""
    rows = infill.transformed(table(spark, sf_dir, "documents"))
    text = infill.restored("output", "form")
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (text, "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document; nulls, ties and repeats as in importance.resampled."""
    rows = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled; nulls, ties and repeats as in warc.write_captures."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_captures(pages, folder)
    rows = warc.read_captures(spark, folder)
    return rows.select(F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_source_mix,
        op3_best_fit_packing,
        op4_suffix_dedup,
        op5_exact_top_k,
        op6_language_id,
        op7_main_text,
        op8_repetition_quality,
        op9_chat_format,
        op10_toxicity,
        op11_fill_in_middle,
        op12_importance_resampling,
        op13_warc_captures,
    )
}
ORACLES: dict[str, str] = {
    "op5_exact_top_k": topk.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_warc_captures": warc.ORACLE,
}
