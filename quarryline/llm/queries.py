"""Queries over the corpus operators, one per operator, at production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import alignment, blocks, decontaminate, fim, html, licenses, mixing, rules, secrets, simhash, suffixes, warc
from quarryline.llm.common import held_out, stash, table
from quarryline.llm.quality import fit_compression_model


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_compression_model(docs, table(spark, sf_dir, "labels"), allowed=~held_out(F.col("id")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stash(rules.with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    verdict = rules.learn_rules(stats, labels)
    failed = rules.base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict.kept()).alias("kept"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = stash(licenses.licence_words(docs).drop("text"))
    found = licenses.matched(words, licenses.index_of(words))
    places, templates = F.col("licenses.places"), F.col("licenses.templates")
    base = F.array_distinct(F.transform(places, lambda x: x["label"]))
    starts = F.transform(places, lambda x: x["at"])
    own = F.transform(templates, lambda x: x["label"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform(templates, lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "licenses.n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.round(F.greatest(share, F.when(F.size(places) > 0, 0.5).otherwise(0.0)), 9).alias("score"),
    )


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(text).alias("n"), mixing.letter_weight(text).alias("w"))
    mixed = mixing.mix(docs, size=F.col("n"), weight=F.col("w"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.sort_array(F.transform("hits.items", lambda x: x.cast("string"))), ",")
    n_hit = decontaminate.hit_words(F.col("hits"))
    return found.select("doc_id", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("secrets.base_spans")
    counts = [secrets.count_kind(base, k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.render(base), 256).alias("base_sha256"), secrets.render(F.col("secrets.spans")).alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.assemble(fim.pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str, vocabularies: str = "/opt/tokenizers") -> DataFrame:
    held = alignment.Tokenizers.read(f"{vocabularies}/byte_bpe_50k.json", f"{vocabularies}/piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), held)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_source_mixing": op5_source_mixing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc_archives": op10_warc_archives,
    "op11_passage_dedup": op11_passage_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op5_source_mixing": mixing.MIXING_SQL,
    "op6_benchmark_decontamination": decontaminate.DECONTAMINATION_SQL,
    "op10_warc_archives": warc.WARC_SQL,
}
