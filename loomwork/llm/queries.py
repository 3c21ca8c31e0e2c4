"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, flac, html_layout, jaccard, langid, mixing, near_vectors, ngram_lm, pieces, sql, token_counts, toxicity, url_templates
from .common import fold, table

#: Share of all tokens that mixing draws.
MIX_SHARE = 0.3
TOKEN_LIMIT = 4096
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def topic_of(text: Column) -> Column:
    """A topic by form: tables, records with long numbers, licences, or prose."""
    return F.when(text.contains(" | "), "table").when(text.contains("icense"), "licence").when(text.rlike("[0-9]{4}"), "record").otherwise("prose")


def mix_dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = mixing.mix(docs, mix_dimensions(), share=MIX_SHARE)
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "sampled")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tenth = table(spark, sf_dir, "documents"), fold("doc_id", 10)
    part = F.when(tenth == 0, ngram_lm.UNSEEN).when(tenth == 9, ngram_lm.HELD).otherwise(ngram_lm.ESTIMATE)
    scored = ngram_lm.score_texts(docs, part)
    return scored.select("doc_id", (tenth == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = flac.decode_flac(flac.encode_flac(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.profiles(docs.where(fold("doc_id", 3) != 1))
    return langid.identify(docs, learned).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "fit")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_texts(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_texts(table(spark, sf_dir, "documents"), model_path())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_layout.extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    return toxicity.score(docs, machine).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the session's, where it names one; else each run has its own and encodes all distinct texts."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), model_path(), cache=spark.conf.get("spark.loomwork.tokenCounts", None))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path(BYTE_TOKENIZER), model_path()
    aligned = alignment.settled_digests(alignment.align_texts(table(spark, sf_dir, "documents"), *paths))
    counted = alignment.with_link_counts(aligned, *paths)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_near_vectors, op3_ngram_lm, op4_flac, op5_language, op6_jaccard, op7_pieces, op8_html_layout, op9_url_templates, op10_toxicity, op11_token_counts, op12_alignment, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": sql.mixing(), "op9_url_templates": sql.url_templates(), "op13_collocations": sql.collocations()}
