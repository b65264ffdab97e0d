"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import main_text
from .common import read
from .decontaminate import contaminated
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .media_gif import text_media
from .nnpu import score_toxicity
from .oracles import ORACLES
from .packing import MAX_LOSS, pack
from .quotes import link_quotes
from .subword import score_quality
from .url_templates import oracle_sql as url_sql
from .url_templates import url_filter


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("lines_cut").cast("long").alias("lines_cut"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


def op2_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_loss=MAX_LOSS, head_is_prompt=True, with_ids=False)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), whole=True, split=True)
    return found.select("doc_id", "item_id", "windows", *[F.col(c).cast("long").alias(c) for c in ("first_word", "last_word")], "exact").distinct()


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read(spark, sf_dir, "conversations"), partial=True)


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_jaccard_groups": op2_jaccard_groups,
    "op3_gif_media": op3_gif_media,
    "op4_url_templates": op4_url_templates,
    "op5_vector_packing": op5_vector_packing,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_subword_quality": op7_subword_quality,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_nnpu_toxicity": op9_nnpu_toxicity,
    "op10_block_lstm": op10_block_lstm,
}
ORACLE_SQL: dict[str, str] = ORACLES | {"op4_url_templates": url_sql()}
