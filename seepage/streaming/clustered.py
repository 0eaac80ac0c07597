"""Tables that a stream adds to and looks things up in, clustered by a hash of their key.

Each batch is a part of its own; below it rows lie in one folder per prefix of
the key's hash, the longer the more rows the part has.  A lookup names the
prefixes that it needs and opens no other folder.  From time to time all parts are merged into one, so that the number of
folders does not grow with the age of the stream.  A part counts once it is
complete; a batch that runs again replaces its own part and never sees it.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seepage.sources.checkpoint import remove_folder

#: Hexadecimal digits of a prefix at most, rows for one folder, and batches between two merges.
DIGITS, ROWS, MERGE = 3, 20_000, 16
#: Keys for one bitmap of a filter, and the bits of one (that of Spark's bitmap functions).
KEYS, BITS = 2000, 32768


class ClusteredTable:
    """Parts of rows (``schema``) with a ``prefix``, which is made of the column ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType | str, digits: int = DIGITS, merge_every: int = MERGE, rows: int = ROWS):
        self.spark, self.folder, self.key, self.digits, self.merge_every, self.rows = spark, folder, key, digits, merge_every, rows
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _digest(self) -> Column:
        return F.sha2(F.col(self.key).cast("string").cast("binary"), 256)

    def prefixes(self, rows: DataFrame) -> list[str]:
        """Those that ``rows`` need; at most 16^digits."""
        return sorted(r[0] for r in rows.select(F.left(self._digest(), F.lit(self.digits)).alias("p")).distinct().collect() if r[0])

    def _parts(self) -> dict[str, bool]:
        """Names of the parts and whether they are complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return {}
        names = [s.getPath().getName() for s in store.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return {n: store.exists(done(f"{self.folder}/{n}/_SUCCESS")) for n in names if re.fullmatch(r"part=[bu]\d+", n)}

    def live(self, before: int) -> list[str]:
        """Parts that together hold all batches before ``before`` once: the newest merged one and later batches."""
        parts = [(n[5], int(n[6:]), n) for n, complete in self._parts().items() if complete]
        merged = max(((number, n) for kind, number, n in parts if kind == "u" and number < before), default=(-1, None))
        later = sorted(n for kind, number, n in parts if kind == "b" and merged[0] < number < before)
        return [n for n in (merged[1], *later) if n]

    def read(self, before: int, prefixes: Collection[str] | None = None) -> DataFrame | None:
        """Rows of all batches before ``before``, from the folders of ``prefixes`` only; None if there is no such batch."""
        live = self.live(before)
        if not live:
            return None
        # text, also where all prefixes are digits
        whole = StructType([*self.schema.fields, *StructType.fromDDL("part string, prefix string").fields])
        rows = self.spark.read.option("basePath", self.folder).schema(whole).parquet(*[f"{self.folder}/{n}" for n in live])
        if prefixes is not None:
            # small parts have shorter prefixes
            names = sorted({"x" + p[:k] for p in prefixes for k in range(self.digits + 1)})
            rows = rows.filter(F.col("prefix").isin(names) if names else F.lit(False))
        return rows.drop("part", "prefix")

    def read_batch(self, batch_id: int) -> DataFrame:
        """The rows of one batch, from its part."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/part=b{batch_id:012d}")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Replace the part of a batch; once in a while merge the parts before it."""
        self._write(rows, f"part=b{batch_id:012d}")
        if self.merge_every and batch_id and batch_id % self.merge_every == 0:
            self.merge(batch_id)

    def _write(self, rows: DataFrame, part: str) -> None:
        n, digits = rows.count(), 0
        while digits < self.digits and n > self.rows * 16**digits:
            digits += 1
        placed = rows.withColumn("prefix", F.concat(F.lit("x"), F.left(self._digest(), F.lit(digits)))).filter("prefix is not null")
        # a prefix with many rows is split over tasks, small ones share a task
        placed.hint("rebalance", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.folder}/{part}")

    def merge(self, before: int) -> None:
        """One part of all batches before ``before``; these are done, since batch ``before`` runs."""
        old = self.live(before)
        if len(old) < 2:
            return
        self._write(self.read(before).distinct(), f"part=u{before - 1:012d}")
        for name in old:
            remove_folder(self.spark, f"{self.folder}/{name}")


class KnownFingerprints:
    """The fingerprints that earlier batches of a stream have reported.

    Beside the clustered fingerprints lie bitmaps, a twentieth of their size:
    a fingerprint that is not in the bitmaps of its prefix is new without a
    look at any fingerprint.  Only the prefixes of the others are opened.
    """

    def __init__(self, spark: SparkSession, folder: str, digits: int = DIGITS, merge_every: int = MERGE, rows: int = ROWS, keys: int = KEYS):
        self.table = ClusteredTable(spark, f"{folder}/fingerprints", "fingerprint", "fingerprint string", digits, merge_every, rows)
        # a bitmap lies with the cluster of its keys: the digits of their hashes that it covers
        self.filters = ClusteredTable(spark, f"{folder}/filters", "cluster", "cluster string, depth int, part_id string, bits binary", digits, 0, rows)
        self.keys = keys

    def _bits(self, rows: DataFrame) -> DataFrame:
        """(fingerprint, hash, cluster, bit): two bits for each fingerprint."""
        digest = F.sha2(F.col("fingerprint").cast("binary"), 256)
        return rows.select("fingerprint", digest.alias("digest")).select("fingerprint", "digest", F.explode(F.array(*[
            (F.conv(F.substring("digest", at, 8), 16, 10).cast("long") % BITS) for at in (33, 49)])).alias("bit"))

    def _depth(self, n: int) -> int:
        """Digits that tell the bitmaps of a part apart."""
        depth = 0
        while self.keys * 16**depth < n and depth < 8:
            depth += 1
        return depth

    def maybe_known(self, fresh: DataFrame, batch_id: int) -> DataFrame | None:
        """The fingerprints of ``fresh`` that the bitmaps do not rule out; None without earlier batches."""
        found = self.filters.read(batch_id)
        if found is None:
            return None
        # one number per depth
        depths = [r[0] for r in found.select("depth").distinct().collect()] or [0]
        places = self._bits(fresh.select("fingerprint").distinct()).select("*", F.explode(F.array(*[F.lit(d).cast("int") for d in depths])).alias("depth"))
        places = places.withColumn("cluster", F.expr("left(digest, depth)"))
        clusters = self.filters.prefixes(places)
        found = self.filters.read(batch_id, clusters)
        holds = F.expr("(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bit % 8 as int)) & 1") == 1
        hits = places.join(found, ["cluster", "depth"]).groupBy("fingerprint", "part_id").agg(F.min(holds.cast("int")).alias("all_bits"))
        return hits.filter("all_bits = 1").select("fingerprint").distinct()

    def new_only(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        """The rows of ``fresh`` whose fingerprint no batch before ``batch_id`` has."""
        maybe = self.maybe_known(fresh, batch_id)
        prefixes = self.table.prefixes(maybe) if maybe is not None else []
        if not prefixes:
            return fresh
        return fresh.join(self.table.read(batch_id, prefixes).select("fingerprint"), "fingerprint", "left_anti").select(*fresh.columns)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Remember the fingerprints of a batch."""
        rows = rows.select("fingerprint")
        self._add_filter(rows, batch_id)
        self.table.write(rows, batch_id)
        if self.table.merge_every and batch_id and batch_id % self.table.merge_every == 0:
            before = self.table.read(batch_id)
            if before is not None and len(self.filters.live(batch_id)) > 1:
                old = self.filters.live(batch_id)
                self._add_filter(before, batch_id - 1, "u")
                for name in old:
                    remove_folder(self.table.spark, f"{self.filters.folder}/{name}")

    def _add_filter(self, rows: DataFrame, batch_id: int, kind: str = "b") -> None:
        depth = self._depth(rows.count())
        bitmaps = self._bits(rows).groupBy(F.left("digest", F.lit(depth)).alias("cluster")).agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.filters._write(bitmaps.select("cluster", F.lit(depth).alias("depth"), F.lit(f"{kind}{batch_id}").alias("part_id"), "bits"), f"part={kind}{batch_id:012d}")
