"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.llm import (
    decontaminate, hard_negatives, language_gru, lexical, mixing, multi_index, packing, quality_rules, run_index,
    sharding, simhash, toxicity, warc,
)
from riskflow.llm.common import table


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return run_index.cut_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_quality(spark, sf_dir):
    return quality_rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark, sf_dir):
    return language_gru.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark, sf_dir):
    return warc.archive_index(table(spark, sf_dir, "pages"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_neighbors(spark, sf_dir):
    return multi_index.nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_decontaminate(spark, sf_dir):
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(found.id.alias("doc_id"), "item_id", "n_windows", "matched", "changed_slots")


def op9_shard(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pack(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0
    )


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_neighbors": op8_neighbors,
    "op9_shard": op9_shard,
    "op10_decontaminate": op10_decontaminate,
    "op11_lexical_search": op11_lexical_search,
    "op12_pack": op12_pack,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
