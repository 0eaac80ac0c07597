import hashlib

import pytest
from pyspark.sql import functions as F

from seepage.operators import body, dedup, scoring
from seepage.operators.matching import run
from seepage.plans.detect import detect
from seepage.streaming import clustered, stream
from seepage.streaming.clustered import ClusteredTable, KnownFingerprints
from tests.conftest import SF

SCHEMA = "target string, url string, status int, body string, fetched_at timestamp"


def captures(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return pages.select(
        F.regexp_extract("url", "^https?://[^/?#]+", 0).alias("target"), "url", F.lit(200).alias("status"),
        F.col("html").alias("body"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("fetched_at"))


def source(spark, folder, files_per_batch=1):
    return stream.stream_responses(spark, folder, schema=captures(spark).schema, files_per_batch=files_per_batch)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def find(batch):
    return dedup.dedup(scoring.score(run(batch, body.source_hits())))


def test_batches_add_only_new_findings_and_equal_one_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    captures(spark).repartition(3).write.parquet(folder)
    finish(stream.write_findings(source(spark, folder), f"{tmp_path}/table", f"{tmp_path}/state", find=find))
    got = spark.read.parquet(f"{tmp_path}/table")
    assert got.filter("batch >= 0").select("batch").distinct().count() > 1
    wanted = find(captures(spark))
    assert sorted(r.fingerprint for r in got.collect()) == sorted(r.fingerprint for r in wanted.collect())

    # a second run over the same captures, with a new state, finds nothing new
    finish(stream.write_findings(source(spark, folder), f"{tmp_path}/table2", f"{tmp_path}/state2", find=find))
    more = str(tmp_path / "in")
    captures(spark).limit(5).write.mode("append").parquet(more)
    finish(stream.write_findings(source(spark, folder), f"{tmp_path}/table2", f"{tmp_path}/state2", find=find))
    assert spark.read.parquet(f"{tmp_path}/table2").count() == wanted.count()


def test_default_finder_sees_scripts(spark, tmp_path):
    key = "AK" + "IA" + "IOSFODNN7EXAMPLE"
    rows = [("https://a.io", "https://a.io/", 200, "<script src='/x.js'></script>", None),
            ("https://a.io", "https://a.io/x.js", 200, f'k="{key}"', None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    query = stream.write_findings(
        source(spark, folder), f"{tmp_path}/table", f"{tmp_path}/state", modules=["javascript", "secrets"])
    finish(query)
    titles = {r.title for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert titles == {"AWS Access Key exposed in JavaScript", "AWS Access Key discovered"}


@pytest.mark.parametrize("script_first", [False, True])
def test_page_and_script_in_different_batches(spark, tmp_path, script_first):
    key = "AK" + "IA" + "IOSFODNN7EXAMPLE"
    rows = [("https://a.io", "https://a.io/", 200, "<script src='/x.js'></script>", None),
            ("https://a.io", "https://a.io/x.js", 200, f'k="{key}"', None),
            ("https://b.io", "https://b.io/", 200, "<script src='https://a.io/x.js'></script>", None),
            ("https://a.io", "https://a.io/x.js", 200, f'k="{key}"', None)]
    folder = str(tmp_path / "in")
    for row in rows[::-1] if script_first else rows:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        finish(stream.write_findings(source(spark, folder), f"{tmp_path}/table", f"{tmp_path}/state", modules=["javascript", "secrets"]))
    got = sorted(r.fingerprint for r in spark.read.parquet(f"{tmp_path}/table").collect())
    whole = detect(spark.createDataFrame(rows, SCHEMA), modules=["javascript", "secrets"])
    assert got == sorted(r.fingerprint for r in whole.collect()) and len(got) == 3
    assert not list((tmp_path / "table-hits").iterdir())


def test_counts_and_distinct(spark, tmp_path):
    folder = str(tmp_path / "in")
    captures(spark).repartition(2).write.parquet(folder)
    scored = scoring.score(run(captures(spark), body.source_hits()))
    found = stream.stream_findings(source(spark, folder), [body.source_hits()])

    finish(stream.write_latest(stream.live_counts(found), f"{tmp_path}/c", f"{tmp_path}/cs"))
    wanted = {r.severity: r.n for r in scored.groupBy("severity").agg(F.countDistinct("fingerprint").alias("n")).collect()}
    assert {r.severity: r.n for r in spark.read.parquet(f"{tmp_path}/c").collect()} == wanted

    for name, delay in (("d", None), ("w", "10 days")):
        distinct = stream.distinct_findings(found, delay).select("fingerprint")
        finish(distinct.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option(
            "checkpointLocation", f"{tmp_path}/{name}s").trigger(availableNow=True).start())
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect())) == sorted(
            map(tuple, scored.select("fingerprint").distinct().collect()))


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    page = "<!-- some remark -->"

    def add(*times):
        rows = [("https://a.io", f"https://a.io/{t}", 200, page) for t in times]
        spark.createDataFrame(rows, "target string, url string, status int, body string").withColumn(
            "fetched_at", F.timestamp_seconds(F.regexp_extract("url", "[0-9]+$", 0).cast("long"))
        ).coalesce(1).write.mode("append").parquet(folder)
        counts = stream.windowed_counts(
            stream.stream_findings(source(spark, folder), [body.source_hits()]), "10 minutes", "1 hour")
        finish(stream.write_latest(counts, f"{tmp_path}/t", f"{tmp_path}/s", "update"))
        table = spark.read.parquet(f"{tmp_path}/t").groupBy(F.unix_timestamp("window_start").alias("w")).agg(F.max("n").alias("n"))
        return {r.w: r.n for r in table.collect()}

    assert add(600, 700) == {600: 2}
    assert add(7200) == {600: 2, 7200: 1}
    # the watermark stands at 3600 now: 800 is too late, 7300 is not
    assert add(800, 7300) == {600: 2, 7200: 2}


def prints(spark, *numbers):
    return spark.createDataFrame([(hashlib.sha256(b"%d" % n).hexdigest(), n) for n in numbers], "fingerprint string, n int")


def opened(df):
    """How many files the scan of ``df`` opens."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numFiles").get().value()


def test_a_batch_opens_only_the_clusters_that_it_needs(spark, tmp_path):
    known = KnownFingerprints(spark, f"{tmp_path}/known", digits=2, rows=1, merge_every=0)
    for batch in range(3):
        known.add(prints(spark, *range(200 * batch, 200 * batch + 200)), batch)
    assert opened(known.table.read(3)) > 300
    fresh = prints(spark, 5, 404, 9001, 9002)
    maybe = known.maybe_known(fresh, 3)
    prefixes = known.table.prefixes(maybe)
    wanted = set(known.table.prefixes(prints(spark, 5, 404)))
    # a bitmap may be wrong, but not often
    assert wanted <= set(prefixes) and len(prefixes) <= 3
    # three parts, one folder of a prefix each
    assert opened(known.table.read(3, prefixes)) <= 3 * len(prefixes)
    assert sorted(r.n for r in known.new_only(fresh, 3).collect()) == [9001, 9002]
    # a batch that runs again doesn't see itself
    assert known.new_only(prints(spark, 450), 2).count() == 1
    assert known.new_only(prints(spark, 450), 3).count() == 0


def test_bitmaps_of_large_parts(spark, tmp_path):
    known = KnownFingerprints(spark, f"{tmp_path}/known", digits=1, merge_every=0, rows=1, keys=10)
    known.add(prints(spark, *range(1000)), 0)
    known.add(prints(spark, *range(1000, 1005)), 1)
    assert {r.depth for r in known.filters.read(2).select("depth").distinct().collect()} == {0, 2}
    found = known.new_only(prints(spark, *range(900, 1100)), 2)
    assert sorted(r.n for r in found.collect()) == list(range(1005, 1100))


def test_twenty_batches_with_merges_equal_one(spark, tmp_path):
    known = KnownFingerprints(spark, f"{tmp_path}/known", digits=1, merge_every=4, rows=5)
    kept = []
    for batch in range(20):
        own = prints(spark, *range(7 * batch, 7 * batch + 12))
        new = known.new_only(own, batch)
        numbers = sorted(r.n for r in new.collect())
        known.add(new, batch)
        kept += numbers
    assert kept == list(range(7 * 19 + 12))
    assert len(known.table.live(20)) <= 6 and len(known.filters.live(20)) <= 6
    assert known.table.read(20).count() == len(kept)


def test_an_unfinished_merge_does_not_count(spark, tmp_path):
    table = ClusteredTable(spark, f"{tmp_path}/t", "k", "k string, v int", digits=1, merge_every=0)
    for batch in range(3):
        table.write(spark.createDataFrame([(f"k{batch}", batch)], "k string, v int"), batch)
    table._write(spark.createDataFrame([("x", 9)], "k string, v int"), "part=u000000000001")
    (tmp_path / "t" / "part=u000000000001" / "_SUCCESS").unlink()
    assert sorted(r.v for r in table.read(3).collect()) == [0, 1, 2]
    table.merge(3)
    assert table.live(3) == ["part=u000000000002"] and sorted(r.v for r in table.read(4).collect()) == [0, 1, 2]
    assert table.read(0) is None and table.read(3, []).collect() == []


def test_table_of_an_earlier_version(spark, tmp_path):
    folder = str(tmp_path / "in")
    captures(spark).coalesce(1).write.parquet(folder)
    finish(stream.write_findings(source(spark, folder), f"{tmp_path}/table", f"{tmp_path}/state", find=find))
    before = spark.read.parquet(f"{tmp_path}/table").count()
    clustered.remove_folder(spark, f"{tmp_path}/table-known")
    captures(spark).coalesce(1).write.mode("append").parquet(folder)
    finish(stream.write_findings(source(spark, folder), f"{tmp_path}/table", f"{tmp_path}/state", find=find))
    assert spark.read.parquet(f"{tmp_path}/table").count() == before


def test_a_frequent_fingerprint_reaches_the_state_once_per_task(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 700).cast("string"))).alias("fingerprint"),
        F.lit("Low").alias("severity"), F.timestamp_seconds(F.col("id")).alias("timestamp"))
    rows.write.parquet(folder)
    seen = stream.first_in_task(rows).groupBy("fingerprint").count().filter("fingerprint = 'hot'").first()["count"]
    # by the task it may come again with a later time, once per Arrow batch
    assert seen <= 4
    found = spark.readStream.schema(rows.schema).parquet(folder)
    finish(stream.write_latest(stream.live_counts(found), f"{tmp_path}/c", f"{tmp_path}/s"))
    wanted = rows.select("fingerprint").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/c").first().n == wanted
    latest = stream.first_in_task(rows).filter("fingerprint = 'hot'").agg(F.max("timestamp").alias("t")).first().t
    assert latest == rows.filter("fingerprint = 'hot'").agg(F.max("timestamp").alias("t")).first().t


@pytest.mark.parametrize("script_first", [False, True])
def test_pages_meet_scripts_in_a_stream_join(spark, tmp_path, script_first):
    key = "AK" + "IA" + "IOSFODNN7EXAMPLE"
    rows = [("https://a.io", "https://a.io/", 200, "<script src='/x.js'></script><script src='https://c.io/y.js'></script>", 1000),
            ("https://a.io", "https://a.io/x.js", 200, f'k="{key}"', 1600),
            ("https://b.io", "https://b.io/", 200, "<script src='https://a.io/x.js'></script>", 2000),
            # two days later: too far from the pages
            ("https://c.io", "https://c.io/y.js", 200, f'k="{key}"', 2000 + 2 * 86400)]
    folder = str(tmp_path / "in")
    for row in (rows[:3][::-1] + rows[3:] if script_first else rows):
        spark.createDataFrame([row], "target string, url string, status int, body string, at long").select(
            "target", "url", "status", "body", F.timestamp_seconds("at").alias("fetched_at")).coalesce(1).write.mode("append").parquet(folder)
        found = stream.stream_script_findings(source(spark, folder), "2 hours", "1 day").select("target", "title", "url")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        finish(query)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    title = "AWS Access Key exposed in JavaScript"
    assert got == [("https://a.io", title, "https://a.io/x.js"), ("https://b.io", title, "https://a.io/x.js")]
    # the last file has moved the watermark past what the first three can meet
    last = [p for p in query.recentProgress if p.stateOperators]
    assert last and last[-1].stateOperators[0].numRowsTotal <= 1
