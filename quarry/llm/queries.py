"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (bpe, language_ppm, lattice_dedup, merkle_manifest, minhash_dedup, packing, pii, prefix_trie, quality_classifier,
                        quality_rules, records, token_counts, url_filters)
from quarry.llm.common import Scratch, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn(docs))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    # all spans by kind as listed, then start
    rank = F.transform(F.concat("base", "added"), lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(
        "doc_id", *[F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(rank)).alias("spans"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def derived_edits(docs: DataFrame) -> DataFrame:
    """One to four edits a document, from hashes of its id: a cut of up to 40
    characters at one place, and up to 60 characters of another place put in."""
    size = F.char_length("text")
    draw = lambda k: F.pmod(F.xxhash64("doc_id", "seq", F.lit(k)), F.greatest(size, F.lit(1)))
    many = docs.where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(1), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int"))).alias("seq"))
    return many.select("doc_id", "seq", draw(1).alias("start"), F.pmod(F.xxhash64("doc_id", "seq", F.lit(2)), F.lit(41)).alias("n_delete"),
                       F.expr("substring(text, cast(pmod(xxhash64(doc_id, seq, 3), greatest(char_length(text), 1)) as int) + 1, "
                              "cast(pmod(xxhash64(doc_id, seq, 4), 61) as int))").alias("insert"))


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.recount(docs, derived_edits(docs), tokenizer_path(BYTE_BPE))


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality_classifier.train(quality_classifier.training_bags(docs, table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, weights).select(
        "doc_id", (~quality_classifier.learnable()).alias("held_out"), F.col("quality_score_").alias("score"),
        (F.col("quality_score_") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.components(table(spark, sf_dir, "embeddings"), 0.9)


def op8_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "token-records").root
    records.write(table(spark, sf_dir, "documents"), f"{root}/shards", tokenizer_path(BYTE_BPE), end_id=2)
    return records.write_index(spark, f"{root}/shards", f"{root}/index").select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(WORD_BPE)
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op11_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    # a row without doc_id is learned from
    model = language_ppm.learn(docs, F.coalesce(~held_out, F.lit(True)))
    return language_ppm.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_half_depth_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    return prefix_trie.build(*prefix_trie.rebuild(prefix_trie.turns(table(spark, sf_dir, "conversations"), scratch), scratch), scratch)


def tampered_leaf() -> Column:
    """The leaf after its text's A-Z are lower-cased, where 3 divides the CRC-32 of doc_id; else null."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, merkle_manifest.leaf(F.translate("text", upper, upper.lower())))


def op13_midstate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "merkle")
    leaves = merkle_manifest.ordered_leaves(table(spark, sf_dir, "documents"), tampered_leaf(), scratch)
    return merkle_manifest.fold(merkle_manifest.build(leaves, scratch), scratch)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii, op2_sum_of_squares_packing, op3_edit_aware_counts, op4_redirect_equivalence, op5_attention_mil, op6_robust_outliers,
    op7_lattice_hashing, op8_min_max_hashing, op9_token_records, op10_streaming_bpe,
    op11_partial_matching, op12_half_depth_trie, op13_midstate_tree)}
