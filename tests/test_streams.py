"""Streams in several batches give what the batch jobs give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pressroom import views
from pressroom.operators import clusters, dedup, entities, sources
from pressroom.streaming import streams

DATA = "/root/testdata/sf0.001"



def test_exact_url_in_batches(spark, tmp_path):
    pages = views.pages(spark, DATA).select("id", "url", "crawled_at")
    pages = pages.unionByName(pages.select((F.col("id") + 1000).alias("id"), "url", (F.col("crawled_at") + F.expr("INTERVAL 1 DAY")).alias("crawled_at")))
    pages = pages.unionByName(spark.createDataFrame([(5000, None, datetime(2024, 2, 1)), (5001, None, datetime(2024, 2, 1))], pages.schema))
    folder = f"file://{tmp_path}"
    for k, part in enumerate((pages.where("id < 20"), pages.where("id >= 20 AND id < 1010"), pages.where("id >= 1010"))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streams.read_stream(spark, f"{folder}/in", pages.schema)
        streams.run_keyed(streams.exact_url_stream(stream), f"{folder}/checkpoint", path=f"{folder}/out")
        assert spark.read.parquet(f"{folder}/out").count() == [20, pages.where("id < 1010").count(), pages.count()][k]
    found = {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("id", "url_hash", "duplicate_of").collect()}
    assert found == {tuple(r) for r in dedup.exact_url(pages).collect()}


def test_states_in_batches(spark, tmp_path):
    logs = views.crawl_logs(spark, DATA)
    folder = f"file://{tmp_path}"
    cuts = logs.selectExpr("percentile_approx(started_at, array(0.3, 0.6)) AS c").first().c
    parts = (logs.where(F.col("started_at") < cuts[0]), logs.where((F.col("started_at") >= cuts[0]) & (F.col("started_at") < cuts[1])), logs.where(F.col("started_at") >= cuts[1]))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streams.read_stream(spark, f"{folder}/in", logs.schema)
        keep = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
        # Each run goes on from the checkpoint of the one before.
        streams.run_keyed(streams.source_states(stream), f"{folder}/checkpoint", keep, mode="update")
    rows = {}
    for r in spark.read.parquet(f"{folder}/out").orderBy("n").collect():
        rows[r.source_id] = r
    health = {r.source_id: (r.status, r.consecutive_errors, r.days_without_new) for r in sources.health(logs).collect()}
    frequency = {r.source_id: (r.interval_minutes, round(r.average_new, 9), r.crawl_count) for r in sources.frequency(logs).collect()}
    assert {k: (r.status, r.consecutive_errors, r.days_without_new) for k, r in rows.items()} == health
    assert {k: (r.interval_minutes, round(r.average_new, 9), r.crawl_count) for k, r in rows.items() if r.crawl_count} == frequency


def test_cascade_in_batches(spark, tmp_path):
    """Days of articles one after the other get the verdicts and clusters of all at once."""
    named = entities.extract_entities(views.articles(spark, DATA), views.dictionary(spark))
    vectors = views.table(spark, DATA, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    named = named.withColumn("entities", entities.entity_set(F.col("entities"))).join(vectors, "id", "left")
    named = named.select("id", "crawled_at", "language", "title", "entities", F.col("embedding").cast("array<float>").alias("embedding")).cache()
    folder = f"file://{tmp_path}"
    start = named.agg(F.min("crawled_at")).first()[0]
    days = [start, start + timedelta(days=1), start + timedelta(days=2), start + timedelta(days=400)]
    for first, last in zip(days, days[1:], strict=False):
        named.where((F.col("crawled_at") >= first) & (F.col("crawled_at") < last)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        streams.run_once(streams.read_stream(spark, f"{folder}/in", named.schema), f"{folder}/checkpoint", streams.cascade_batches(f"{folder}/out", cosine=0.4))
    found = {r.id: (r.dedup_level, r.duplicate_of) for r in spark.read.parquet(f"{folder}/out").collect()}
    whole = dedup.cascade(named, dedup.near_titles(named), dedup.similar_vectors(named, 0.4))
    assert found == {r.id: (r.dedup_level, r.duplicate_of) for r in whole.collect()}
    roots = {r.id: r.cluster for r in streams.stream_clusters(spark, f"{folder}/out").collect()}
    assert roots == {r.id: r.cluster for r in clusters.assign_clusters(whole).collect()}


def test_history_is_read_by_folder(spark, tmp_path):
    """A batch reads the days of its look-back and the batches before it; replayed, it writes its own folders anew."""
    path = f"file://{tmp_path}/out"
    made = lambda first, n: spark.range(first, first + n).select("id", (F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("crawled_at"))
    for batch, (first, n) in enumerate([(0, 10), (10, 10), (18, 4), (18, 4)]):
        streams._write(made(first, n), path, min(batch, 2))
    assert spark.read.parquet(path).count() == 24
    stored = streams._before(spark, path, "id long, crawled_at timestamp", 2, datetime(2024, 1, 15, 12))
    assert sorted(r.id for r in stored.collect()) == [15, 16, 17, 18, 19]
    plan = stored._jdf.queryExecution().toString()
    filters = next(line for line in plan.split("\n") if "PartitionFilters" in line)
    assert "crawl_date" in filters.split("PartitionFilters")[1].split("]")[0] and "batch" in filters.split("PartitionFilters")[1].split("]")[0]
    assert streams._before(spark, f"{path}-none", "id long, crawled_at timestamp", 2, None).count() == 0


def test_a_batch_of_many_days_writes_a_file_for_a_month(spark, tmp_path):
    """And not one for each day and task; the next batch finds its look-back there."""
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int") * 12)
    none = F.lit(None).cast("array<float>").alias("embedding")
    rows = spark.range(400).repartition(4).select("id", at.alias("crawled_at"), F.lit("en").alias("language"), F.concat(F.lit("story number "), F.col("id") % 9).alias("title"), F.array().cast("array<string>").alias("entities"), none).cache()
    job = streams.cascade_batches(f"file://{tmp_path}/out")
    job(rows.where("id < 300"), 0)
    job(rows.where("id >= 300"), 1)
    folders = {f.parent.name for f in (tmp_path / "out").glob("*/batch=0")}
    assert folders == {f"crawl_date=2024-{day}" for day in ("01-31", "02-29", "03-31", "04-30", "05-31")}
    assert len(list((tmp_path / "out").glob("*/batch=0/*.parquet"))) <= 8 and len(list((tmp_path / "out").glob("*/batch=1"))) == 50
    found = {r.id: (r.dedup_level, r.duplicate_of) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    whole = dedup.cascade(rows, dedup.near_titles(rows), dedup.similar_vectors(rows))
    assert found == {r.id: (r.dedup_level, r.duplicate_of) for r in whole.collect()} and found[300][0] == 2


LOG = "id long, source_id long, started_at timestamp, status string, articles_found int, articles_new int"


def _states(spark, folder, parts, **options):
    """The last state of each source after parts of logs (source, day, status), a batch each."""
    n = 0
    for part in parts:
        rows = []
        for source, day, status in part:
            n += 1
            rows.append((n, source, datetime(2024, 1, 1) + timedelta(days=day), status, 4, 1))
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streams.read_stream(spark, f"{folder}/in", spark.createDataFrame([], LOG).schema)
        keep = lambda df, k: df.withColumn("k", F.lit(k)).write.mode("append").parquet(f"{folder}/out")
        streams.run_keyed(streams.source_states(stream, **options), f"{folder}/checkpoint", keep, mode="update")
    return {r.source_id: (r.status, r.consecutive_errors, r.crawl_count) for r in spark.read.parquet(f"{folder}/out").orderBy("k").collect()}


def test_idle_sources_are_archived_and_late_logs_left_out(spark, tmp_path):
    parts = [[(1, 0, "success"), (2, 0, "error"), (3, 0, "success")], [(1, 5, "success"), (2, 40, "success")], [(3, 20, "success"), (2, 41, "success")], [(2, 80, "error"), (1, 81, "success")]]
    found = _states(spark, f"file://{tmp_path}", parts, idle_days=30)
    # Source 3 went idle; its log of day 20 came when day 40 was over. Source 1 was archived after day 35 and came back.
    assert found == {1: ("active", 0, 3), 2: ("active", 1, 2), 3: ("archived", 0, 1)}


def test_states_go_on_from_the_batch_fold(spark, tmp_path):
    past = [(k, 1, datetime(2023, 12, 1) + timedelta(hours=k), "error", 0, 0) for k in range(4)] + [(k, 2, datetime(2023, 12, 1) + timedelta(hours=k), "success", 4, 4) for k in range(3)]
    initial = streams.initial_states(spark.createDataFrame(past, LOG))
    found = _states(spark, f"file://{tmp_path}", [[(1, 0, "error"), (2, 0, "success"), (3, 0, "error")]], initial=initial)
    assert found == {1: ("degraded", 5, 0), 2: ("active", 0, 4), 3: ("active", 1, 0)}


def test_a_steady_query(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, datetime(2024, 1, 1), "success", 1, 1)], LOG).write.parquet(f"{folder}/in")
    stream = streams.read_stream(spark, f"{folder}/in", spark.createDataFrame([], LOG).schema)
    query = streams.run_steadily(stream, f"{folder}/checkpoint", path=f"{folder}/out", every="1 second")
    try:
        query.processAllAvailable()
        assert spark.read.parquet(f"{folder}/out").count() == 1 and query.isActive
    finally:
        query.stop()
