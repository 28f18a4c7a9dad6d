"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, forest, html, kneser_ney, language_mix, minhash, packing, pii, prefix_trie, repetition, toxicity, vector_codes
from gridloom.llm.common import held_out, table

#: The text of the extra conversation of op8.
EXTRA = "</s>[INST] ok [/INST]"


def op1_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def surrogate_key(spark: SparkSession) -> str:
    """The session's key; where none is set, a random one that the session keeps, so nobody can work surrogates out again."""
    key = spark.conf.get("gridloom.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("gridloom.pii.key", key)
    return key


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.pseudonymise(docs, surrogate_key(spark), mentions="mentions")
    return rows.select("doc_id", F.size("mentions").alias("n_mentions"), "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, ranks, pattern).select("doc_id", "ids")
    decoded = bpe.decode_ids(encoded, ranks, pattern, digest="ids_sha256")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))


def pack_tokens(docs: DataFrame) -> DataFrame:
    """The documents' tokens of the byte-level vocabulary as sequences in batches, with their ids."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return packing.pack(encoded.select("doc_id", "ids"), ids="ids")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    rows = chat.format_paths(chat.as_chains(conversations.unionByName(extra)))
    turns = chat.read_back(F.col("formatted"))
    learned = chat.under_loss(F.col("formatted"), F.col("loss"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        F.col("tree_id").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), digest(said).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), digest(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mix.fit(docs.where(~language_mix.held_out(F.col("doc_id"))))
    rows = language_mix.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", language_mix.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_hash_forest, op2_pii_surrogates, op3_toxicity, op4_repetition, op5_byte_bpe, op6_packing, op7_main_text, op8_reply_trees, op9_kneser_ney, op10_dart_minhash, op11_prefix_trie, op12_vector_codes, op13_language_mix, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": prefix_trie.SQL, "op12_vector_codes": vector_codes.SQL}
