"""The queries of this package, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), words=3, num=90, den=100)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.line_dedup import line_dedup

    found = line_dedup(table(spark, folder, "documents"), min_lines=2)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from pathlib import Path

    import public_tokenizers

    from sealbook.llm.token_files import read_token_files, with_checksums, write_token_files
    from sealbook.operators.durable import shared_folder

    path = shared_folder(spark)
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    write_token_files(table(spark, folder, "documents"), path, tokenizer, end_id=0)
    return with_checksums(read_token_files(spark, path))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.substring_dedup import substring_dedup

    found = substring_dedup(table(spark, folder, "documents"), size=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.quality import quality_rules

    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.html_text import extract

    return extract(table(spark, folder, "pages"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.pii import BASE, personal_data

    found = personal_data(table(spark, folder, "documents"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(kind) for kind in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and the text decoded from them, as checksums."""
    import public_tokenizers

    from sealbook.llm.sentencepieces import load_vocabulary, round_trip
    from sealbook.llm.token_files import with_checksums

    vocabulary = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    found = round_trip(table(spark, folder, "documents"), vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"), "ids")
    return with_checksums(found)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.decontamination import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.periodic_runs import digests, periodic_runs

    return digests(periodic_runs(table(spark, folder, "documents"), planted=True))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"), min_words=2, max_words=3, least=10, nested_percent=50, top=2000)


def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from sealbook.llm.top_products import top_products

    return top_products(table(spark, folder, "embeddings"), is_query=F.col("id") % 100 == 0, k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query takes a session and the folder of the tables."""
    found = [f for name, f in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
