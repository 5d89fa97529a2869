"""The queries opN_<name> and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import (byte_bpe, centroid_clusters, chat_format, decontaminate, embedding_dedup, language_id, mixing, sharding, simhash, substring_dedup, token_store,
    toxicity, vector_codes)
from .shared import table


def op1_chat_format(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(chat_format.format_turns(turns.unionByName(chat_format.injection_probe(spark))))


def op2_toxicity(spark, d):
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_token_store(spark, d):
    import public_tokenizers

    store = token_store.write(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.verify(spark, store)


def op5_projection_forest(spark, d):
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


def op4_rank_order(spark, d):
    return language_id.predictions(table(spark, d, "documents"))


def op6_poisson_mix(spark, d):
    return mixing.poisson_mix(table(spark, d, "documents"))


def op7_stratified_shards(spark, d):
    return sharding.shard_rows(table(spark, d, "documents").select("doc_id", "text", "source"), 40).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


def op8_simhash(spark, d):
    out = simhash.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_winnowing(spark, d):
    return decontaminate.digest(decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")))


def op10_block_anchors(spark, d):
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, d, "documents")))


def op11_byte_bpe(spark, d):
    import public_tokenizers

    return byte_bpe.digest(byte_bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op12_adaptive_bounds(spark, d):
    return centroid_clusters.clusters(table(spark, d, "embeddings"))[0]


def op13_partial_distance(spark, d):
    return vector_codes.digest(*vector_codes.encode(table(spark, d, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_toxicity, op3_token_store, op5_projection_forest, op4_rank_order, op6_poisson_mix,
    op7_stratified_shards, op8_simhash, op9_winnowing, op10_block_anchors, op11_byte_bpe, op12_adaptive_bounds, op13_partial_distance)}
ORACLES = {
    "op1_chat_format": chat_format.SQL, "op4_rank_order": language_id.SQL, "op5_projection_forest": embedding_dedup.SQL,
        "op6_poisson_mix": mixing.SQL, "op7_stratified_shards": sharding.SQL, "op8_simhash": simhash.SQL,
    "op9_winnowing": decontaminate.SQL, "op10_block_anchors": substring_dedup.SQL,
    "op12_adaptive_bounds": centroid_clusters.SQL, "op13_partial_distance": vector_codes.SQL,
}
