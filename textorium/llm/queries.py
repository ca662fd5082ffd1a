"""Queries of the operators over the test tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, decontamination, html_text, language_id, language_model, line_dedup, merkle, mixing, quality_classifier, quality_rules, secrets, simhash, suffix_dedup
from .common import table


def op1_hierarchical_bayes(spark, d):
    return quality_classifier.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_host_rules(spark, d):
    return quality_rules.quality_rules(table(spark, d, "documents"))


def op3_sainte_lague_mix(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_blocks(spark, d):
    out = html_text.extract(table(spark, d, "pages"), "page_id", "html", "url")
    return out.select("page_id", "url", "text", "n_chars")


def op5_recursive_secrets(spark, d):
    found = secrets.find_secrets(table(spark, d, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_line_chunk_dedup(spark, d):
    out = line_dedup.dedup(table(spark, d, "documents").select("doc_id", "text"), whole=True)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed_lines"), "text")


def op7_spaced_seeds(spark, d):
    return decontamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op8_byte_network(spark, d):
    docs = table(spark, d, "documents")
    out = language_id.identify(docs, language_id.learn(docs))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_covering_simhash(spark, d):
    out = simhash.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_suffix_arrays(spark, d):
    out = suffix_dedup.dedup(table(spark, d, "documents"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_pcy_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


def op12_log_bilinear(spark, d):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return language_model.scores(table(spark, d, "documents"), held_out)


def op13_merkle_manifest(spark, d):
    out = merkle.verified(table(spark, d, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_hierarchical_bayes, op2_host_rules, op3_sainte_lague_mix, op4_line_blocks, op5_recursive_secrets,
        op6_line_chunk_dedup, op7_spaced_seeds, op8_byte_network, op9_covering_simhash,
        op10_suffix_arrays, op11_pcy_collocations, op12_log_bilinear, op13_merkle_manifest,
    )
}

SQL = {"op2_host_rules": quality_rules.SQL, "op3_sainte_lague_mix": mixing.sql(), "op11_pcy_collocations": collocations.SQL, "op13_merkle_manifest": merkle.sql()}
