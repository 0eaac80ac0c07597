"""The same detectors on captures that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seepage.operators import javascript
from seepage.operators.dedup import dedup
from seepage.operators.headers import headers as header_findings
from seepage.operators.matching import Detector, as_raw, body_units, explode_hits
from seepage.operators.scoring import score
from seepage.plans.detect import body_detectors, detect
from seepage.rules.scoring import MODULES
from seepage.schema import RESPONSES
from seepage.sources.checkpoint import remove_folder
from seepage.streaming.clustered import ClusteredTable, KnownFingerprints


def stream_responses(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = RESPONSES, files_per_batch: int = 100
) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_findings(responses: DataFrame, detectors: Collection[Detector] | None = None) -> DataFrame:
    """Scored findings of a stream; a narrow plan without state.

    External scripts need a second capture and are left to
    ``write_findings``, which sees whole micro-batches.
    """
    wanted = [m for m in MODULES if m != "javascript"]
    raw = as_raw(explode_hits(body_units(responses), list(detectors) if detectors else body_detectors(wanted)))
    if detectors is None and "headers" in responses.columns:
        raw = raw.unionByName(header_findings(responses))
    return score(raw)


def first_in_task(findings: DataFrame) -> DataFrame:
    """One row per fingerprint and task of a micro-batch: the latest one, so that no other row outlives it in a watermark.

    A task hands on a row as soon as it has seen it and a later one again, so
    it remembers one time per fingerprint.
    """
    names = findings.columns
    timed = "timestamp" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            keys = batch.column("fingerprint").to_pylist()
            times = batch.column("timestamp").cast(pa.int64()).fill_null(-(2**63)).to_pylist() if timed else [0] * len(keys)
            latest: dict[str, int] = {}
            for i, (key, time) in enumerate(zip(keys, times)):
                if key not in latest or time > times[latest[key]]:
                    latest[key] = i
            kept = sorted(i for key, i in latest.items() if key not in seen or times[i] > seen[key])
            seen.update((keys[i], times[i]) for i in kept)
            yield batch.take(pa.array(kept, pa.int64()))

    return findings.mapInArrow(run, findings.schema)


def distinct_findings(findings: DataFrame, delay: str | None = None) -> DataFrame:
    """Drop repeated fingerprints.

    Each task reduces its rows first, so a fingerprint that holds a third of
    a micro-batch reaches the state as one row per task.  With ``delay`` the
    state is bounded by the watermark and a fingerprint may come again later;
    without it every fingerprint is kept for ever.
    """
    reduced = first_in_task(findings)
    if delay is None:
        return reduced.dropDuplicates(["fingerprint"])
    return reduced.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def live_counts(findings: DataFrame, delay: str | None = None) -> DataFrame:
    """Running totals per severity after de-duplication (complete or update mode).

    Only the columns that count travel to the state.
    """
    narrow = findings.select("fingerprint", "severity", *(["timestamp"] if delay else []))
    return distinct_findings(narrow, delay).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(findings: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Totals per window and severity; rows later than ``delay`` are dropped."""
    return (
        findings.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width).alias("w"), "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "n")
    )


def _credit_over_batches(folder: str, batch_id: int) -> Callable[[DataFrame], DataFrame]:
    """Credit the scripts of this and all earlier batches to the pages of all of them.

    New references meet all scripts.  Earlier references meet only script hits
    that no earlier capture of the script had.  Both lie clustered by script,
    and only the clusters of the batch's own scripts are read.
    """
    key = ["script_url", "title", "confidence"]

    def credited(hits: DataFrame) -> DataFrame:
        def kept(rows: DataFrame, name: str) -> tuple[DataFrame, ClusteredTable]:
            table = ClusteredTable(hits.sparkSession, f"{folder}/{name}", "script_url", rows.schema)
            table.write(rows, batch_id)
            return table.read_batch(batch_id), table

        references, all_references = kept(javascript.page_references(hits), "references")
        found, all_found = kept(javascript.script_findings(hits), "scripts")
        touched = all_found.prefixes(references.select("script_url").unionByName(found.select("script_url")))
        earlier, known = all_references.read(batch_id, touched), all_found.read(batch_id, touched)
        fresh = found if known is None else found.join(known.select(*key), key, "left_anti")
        out = javascript.credit(references, found if known is None else found.unionByName(known))
        return out if earlier is None else out.unionByName(javascript.credit(earlier, fresh))

    return credited


def stream_script_findings(responses: DataFrame, delay: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Scored findings in external scripts, credited to the pages that load them, as a stream-stream join.

    A page and its script meet if they were fetched at most ``within`` apart,
    in either order.  Rows older than the watermark (``delay``) are dropped,
    and both sides leave the state when no row can meet them any more, so it is
    bounded whatever the age of the stream.  A page that names a script
    several times, or a script that is fetched again, gives repeated findings;
    ``distinct_findings`` or ``write_findings`` remove them.  Rows without a
    time meet nothing.  ``write_findings`` without this join is exact over any
    distance.
    """
    fetched = responses.filter(F.col("status").isin(*javascript.js.STATUSES) & F.col("fetched_at").isNotNull()).withWatermark("fetched_at", delay)
    units = body_units(fetched)
    scripts = explode_hits(units.filter(javascript.is_external()), [javascript.script_hits()]).filter("hit.kind = 'script'").select(
        F.col("hit.url").alias("script_url"), F.col("hit").alias("found"), F.col("fetched_at").alias("found_at"))
    pages = explode_hits(units, [javascript.reference_hits()]).select(
        "target", "origin", "fetched_at", F.col("hit.url").alias("loaded"), F.col("hit.source_pos").alias("pos"))
    near = F.expr(f"found_at >= fetched_at - interval {within} and found_at <= fetched_at + interval {within}")
    met = pages.join(scripts, (F.col("loaded") == F.col("script_url")) & near)
    return score(as_raw(met.select("target", "origin", "fetched_at", F.col("found").withField("source_pos", F.col("pos")).withField("kind", F.lit("finding")).alias("hit"))))


def write_findings(
    responses: DataFrame,
    path: str,
    checkpoint: str,
    modules: Collection[str] = tuple(MODULES),
    find: Callable[[DataFrame], DataFrame] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Append new findings of every micro-batch to a table below ``path``.

    A batch is de-duplicated in emission order, then reduced to fingerprints
    that no earlier batch has written.  These lie clustered in ``path``-known,
    and a batch opens only the clusters in which it may have a fingerprint.  A
    batch that is run again replaces its own folders, so a lost driver neither
    drops nor repeats a finding.

    Script hits and script references stay in ``path``-links, so that a page
    and its script may arrive in different batches, in either order and at any
    distance.  The hits and findings of a running batch lie in ``path``-hits and
    ``path``-fresh and are deleted after it.
    """
    spark = responses.sparkSession
    known = KnownFingerprints(spark, f"{path}-known")
    started = False

    def detected(batch: DataFrame, batch_id: int, scratch: str) -> DataFrame:
        def held(hits: DataFrame) -> DataFrame:
            hits.write.mode("overwrite").parquet(scratch)
            return spark.read.schema(hits.schema).parquet(scratch)

        return detect(batch, modules=modules, materialize=held, credit=_credit_over_batches(f"{path}-links", batch_id))

    def add(batch: DataFrame, batch_id: int) -> None:
        nonlocal started
        scratch = f"{path}-hits/{batch_id}"
        found = find(batch) if find else detected(batch, batch_id, scratch)
        if not started:
            # an empty first folder makes the table readable from the start
            found.limit(0).write.mode("ignore").parquet(f"{path}/batch=-1")
            started = True
            written = spark.read.parquet(path).filter((F.col("batch") >= 0) & (F.col("batch") < batch_id))
            if not known.table.live(batch_id) and not written.isEmpty():
                # a table that was written without these clusters
                known.add(written, batch_id - 1)
        # looked at twice: for its prefixes and for its rows
        fresh = f"{path}-fresh/{batch_id}"
        dedup(found).write.mode("overwrite").parquet(fresh)
        new = known.new_only(spark.read.schema(found.schema).parquet(fresh), batch_id)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        known.add(spark.read.schema(found.schema).parquet(f"{path}/batch={batch_id}"), batch_id)
        for folder in (scratch, fresh):
            remove_folder(spark, folder)

    writer = responses.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_latest(table: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keep the newest version of a small aggregate in ``path``.

    ``complete`` rewrites the aggregate, ``update`` adds a folder per batch.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    return (
        table.writeStream.outputMode(mode).foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


