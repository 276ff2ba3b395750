"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, langid, licenses, mixing, ppm, secrets, simhash, substrings, tokencount, topk, urlfilter, vectorcodes
from .common import bucket, materialize, spread

Query = Callable[[SparkSession, str], DataFrame]

HELD_MODULUS, HELD_REMAINDER = 4, 2
#: Longest context, in bytes, by which texts are scored.
LM_ORDER = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_model(docs: DataFrame) -> langid.LanguageModel:
    held = F.coalesce(bucket("doc_id", HELD_MODULUS) == HELD_REMAINDER, F.lit(False))
    return langid.train(docs, langid.vocabulary(model_path()), keep=~held)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    model = language_model(docs)
    held = F.coalesce(bucket("doc_id", HELD_MODULUS) == HELD_REMAINDER, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return tokencount.count_tokens(docs, model_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    n = F.size("places").cast("long")
    first, last = F.get("places", F.lit(0)).cast("long"), F.get("places", F.size("places") - 1).cast("long")
    return found.select("doc_id", "n_words", n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), "base_labels", "labels", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources are brought to the same weight; whole documents are repeated and shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), order=LM_ORDER)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = secrets.joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vectorcodes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = materialize(coded.select("vec_id", "code", "error", "label"), "codes")
    # Written, so that the join's sides are plain and a hot label's rows can be split.
    per_label = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    digits = ",".join(str(x) for book in codebooks for entry in book.tolist() for x in entry)
    digest = F.lit(hashlib.sha256(digits.encode()).hexdigest())
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fim.restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_license_scan returns of the base phrases: the part of it that SQL can express."""
    return op4_license_scan(spark, sf_dir).drop("labels", "score")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_token_counts returns of the texts' sizes: the part of it that SQL can express."""
    return op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def queries() -> dict[str, Query]:
    found = [license_base, token_bytes, op1_language_id, op2_token_counts, op3_decontamination, op4_license_scan, op5_exact_topk, op6_simhash_near_dedup, op7_source_mixing, op8_url_filter, op9_lm_scoring, op10_secret_scan, op11_substring_dedup, op12_vector_codes, op13_fill_in_middle]
    return {f.__name__: f for f in found}
