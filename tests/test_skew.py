"""One id, one stream, one window with most of the rows."""

from pyspark.sql import functions as F

from sealbook.operators.ingest import State, ingest, ingest_counts
from sealbook.operators.skew import join_hot
from sealbook.operators.validate import valid_deliveries
from sealbook.settings import Settings
from tests.conftest import BASE, NOW


def test_hot_ids_are_spread_and_joined_once(spark):
    many = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, "alone").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("n")
    )
    one = many.where("k != 'alone'").groupBy("k").agg(F.count("*").alias("copies")).withColumn("v", F.length("k"))
    joined = join_hot(many, one, "k", F.col("n"), "copies", rows_per_salt=500)
    assert joined.count() == 20_000
    assert joined.where(F.col("v") != F.length("k")).count() == 0
    assert [r.k for r in joined.where("v is null").collect()] == ["alone"]
    assert sorted(joined.columns) == ["k", "n", "v"]


def test_a_third_of_all_deliveries_share_one_id(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "one").otherwise(F.format_string("%08d", "id")).alias("event_id"),
        F.lit("c").alias("customer_id"), F.lit("api_calls").alias("metric"),
        F.when(F.col("id") == 300, "2").otherwise("1").alias("quantity"),
        (F.lit(BASE) + F.col("id")).alias("event_time_ms"), F.lit(BASE).cast("bigint").alias("ingest_time_ms"),
        F.lit("{}").alias("payload"), F.col("id").alias("arrival"),
    )
    admission = ingest(valid_deliveries(rows, NOW), State(), Settings())
    assert {r.disposition: r.deliveries for r in ingest_counts(admission.dispositions).collect()} == {
        "accepted": 6001, "deduped": 2999,
    }
    assert admission.accepted.count() == 6001
    filed = admission.corrections.collect()
    assert [(c.event_id, c.quantity_micros) for c in filed] == [("one", 2_000_000)]


def test_hot_ids_and_others_are_judged_alike(spark):
    """Sealed and open windows, conflicts and known ids; once with every id in one task, once with most of them as hot ones."""
    n = F.col("id")
    rows = spark.range(3_000).select(
        F.when(n % 3 == 0, F.concat(F.lit("hot"), (n % 2).cast("string"))).otherwise(F.format_string("%04d", n % 700)).alias("event_id"),
        F.lit("c").alias("customer_id"), F.lit("api_calls").alias("metric"), (1 + n % 7).cast("string").alias("quantity"),
        (F.lit(BASE) + n * 17 % 60_000).alias("event_time_ms"), F.lit(BASE).cast("bigint").alias("ingest_time_ms"),
        F.lit("{}").alias("payload"), F.reverse(F.format_string("%05d", n)).alias("arrival"),
    )
    valid = valid_deliveries(rows, NOW)
    first = ingest(valid.where("arrival < '3'"), State(), Settings())
    held = first.windows.withColumn("state", F.when(F.col("window_open_ms") < BASE + 30_000, "sealed").otherwise("open"))
    state = State(log=first.accepted, windows=held, corrections=first.corrections)

    def found(**limit):
        a = ingest(valid.where("arrival >= '3'"), state, Settings(), **limit)
        told = a.dispositions.select("arrival", "event_id", "disposition", "conflict")
        return [sorted(map(tuple, t.collect())) for t in (told, a.accepted, a.corrections, a.windows)]

    alone, together = found(rows_per_task=2), found()
    assert alone == together and len(together[0]) == 2_100
    assert {d for _, _, d, _ in together[0]} == {"accepted", "deduped", "quarantined"} and together[2]


def test_deliveries_are_shuffled_once(spark, tmp_path):
    """One exchange by id is all that a batch into an empty state takes, for the dispositions and for the corrections."""
    spark.range(100).select(
        F.col("id").cast("string").alias("event_id"), F.lit("c").alias("customer_id"), F.lit("m").alias("metric"), F.lit("1").alias("quantity"),
        F.lit(BASE).alias("event_time_ms"), F.lit(BASE).alias("ingest_time_ms"), F.lit("{}").alias("payload"), F.col("id").alias("arrival"),
    ).write.parquet(str(tmp_path / "in"))
    admission = ingest(valid_deliveries(spark.read.parquet(str(tmp_path / "in")), NOW), State(), Settings())
    for rows in (admission.dispositions, admission.corrections):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
