"""From raw documents to token ids, in stages over whole tables.

Each stage takes the documents that the one before kept and gives a DataFrame that is written and read
again before the next. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealbook.llm.common import WORD, ids
from sealbook.llm.decontamination import without_contaminated
from sealbook.llm.jaccard import near_duplicates
from sealbook.llm.line_dedup import without_repeated_runs
from sealbook.llm.sentencepieces import load_vocabulary, round_trip
from sealbook.llm.toxicity import without_toxic
from sealbook.operators.durable import durable, release_shuffles

#: Near copies share four fifths of their shingles of five words.
SHINGLE_WORDS, LEAST_PERCENT = 5, 80
#: A passage of so many words on one line is a repeat by itself.
LONE_WORDS = 50
#: Nodes of the near-copy join are hashes of so many bits; a test shortens them.
HASH_BITS = (1 << 63) - 1


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The rows whose text the toxicity model, fitted on the labels, does not reject."""
    return without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows; runs of two lines or more, and lines of LONE_WORDS words, that were there before are cut from their texts.

    A text that is nothing but repeats becomes empty, and its row stays for the stages that follow.
    """
    return without_repeated_runs(docs, min_lines=2, lone_words=LONE_WORDS)


def numbered(docs: DataFrame) -> DataFrame:
    """``row``, ``id`` and ``node`` of every row: one number for each pair of doc_id and text.

    The number is a hash, so that no copy of the texts is needed to keep it. Where different pairs have the same hash,
    told by a second one, all but one of them get negative numbers instead.
    """
    hashed = docs.select(F.struct("*").alias("row"), *ids(docs)).select(
        "row", "id", F.xxhash64("id", "text").bitwiseAND(HASH_BITS).alias("h"), F.xxhash64("text", "id", F.lit(1)).alias("h2")
    )
    shared = hashed.groupBy("h").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).filter("low != high")
    others = hashed.select("h", "h2").join(shared, "h").filter("h2 != low").select("h", "h2").distinct()
    others = durable(others.withColumn("other", -1 - F.monotonically_increasing_id()))
    return hashed.join(others, ["h", "h2"], "left").select("row", "id", F.coalesce("other", "h").alias("node"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of the smallest id of each group; of several texts with that id, the first by text.

    Each pair of id and text is a node of its own, so texts that share a doc_id, or have none, are one group only if they are near copies.
    Texts without words are copies if both id and text are the same.
    """
    rows = numbered(docs)
    text = F.col("row.text").cast("string")
    groups = near_duplicates(rows.select(F.col("node").alias("doc_id"), text.alias("text")), words=SHINGLE_WORDS, num=LEAST_PERCENT, den=100)
    release_shuffles(spark)
    same = F.concat_ws(":", F.col("id").cast("string"), F.coalesce("digest", F.lit("null")))
    digest = F.when(~text.rlike(WORD), F.sha2(text, 256)).alias("digest")
    seats = durable(
        rows.select("node", "id", digest).distinct().join(groups.withColumnRenamed("doc_id", "node").distinct(), "node")
        .select("node", "id", F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(same).alias("label"))
    )
    # A node is one id and one text: of a group the smallest id stays, and of its texts the first.
    least = seats.groupBy("label").agg(F.min(F.struct("id")).alias("s")).select("label", "s.id")
    seated = durable(seats.join(least, ["label", "id"]))
    alone = seated.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    several = seated.join(alone.filter("n > 1").select("label"), "label", "left_semi").select("node", "label")
    texts = rows.join(several, "node").groupBy("label").agg(F.min_by("node", F.struct(text.alias("text"), "node")).alias("node"))
    kept = durable(alone.filter("n = 1").select("node").unionByName(texts.select("node")))
    # Repeated rows share a node, and one of them stays.
    found = rows.join(kept, "node", "left_semi")
    repeated = durable(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"))
    first = found.join(repeated, "node", "left_semi").groupBy("node").agg(F.first("row").alias("row"))
    return found.join(repeated, "node", "left_anti").select("row.*").unionByName(first.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The rows that hold no passage of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the ``text`` decoded from them."""
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return round_trip(docs, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece", tokenize),
]

# Trained models, edit budgets and byte-pair merges are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i + 1 < len(STAGES):
            docs = durable(docs)
            release_shuffles(spark)
    return docs
