"""Conflict-constrained best-fit packing of documents into sequences.

Each document is cut into whole sequences of ``capacity`` words and one rest.
Rests are packed by decreasing size: the open bins are kept in the order of
their residual, the search starts at the first bin that is large enough and
goes on to the successor until the bitmaps of sources and duplicate clusters
in the bin have no bit in common with the piece.  That bin is the tightest
compatible one.  If there is none, a new bin is opened.

Pieces are dealt out by hash to groups of about ``GROUP`` pieces, which are
packed independently; repeated rows are numbered first, so that copies of one
row spread over the groups as well.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.mixing import n_words
from seepage.llm.ngram_join import sized_components
from seepage.llm.tables import stored

#: Words of a sequence, and pieces that one task packs together.
CAPACITY, GROUP = 2048, 4096
#: Rests of one source that a sequence may hold.
LANES = 3


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, lanes: int = 1) -> list[int]:
    """Bin of each piece (size, source number, cluster number), in the order given.

    A source has ``lanes`` bits in a bin's source bitmap, one for each piece
    that the bin may hold of it; a cluster has one bit.
    """
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        cluster_bit, source_bits = 1 << cluster, ((1 << lanes) - 1) << (source * lanes)
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            b = bins[at][1]
            if sources[b] & source_bits != source_bits and not clusters[b] & cluster_bit:
                break
            at += 1
        if at < len(bins):
            residual, b = bins.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        free = ~sources[b] & source_bits
        sources[b] |= free & -free
        clusters[b] |= cluster_bit
        if residual > size:
            insort(bins, (residual - size, b))
        out.append(b)
    return out


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, source, cluster, copy, first_word, n_words) of (doc_id, source, cluster, size) rows."""
    counted = docs.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("_n"))
    # in two steps: a row that is repeated very often never becomes one long array
    runs = counted.select("*", F.explode(F.expr(f"sequence(0, (_n - 1) div {GROUP})")).alias("_run"))
    copies = runs.select("*", F.explode(F.expr(f"sequence(_run * {GROUP} + 1, least(_n, (_run + 1) * {GROUP}))")).alias("copy"))
    last = F.expr(f"cast((size - 1) div {capacity} as int)")
    cut = copies.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    start = F.col("_k").cast("long") * capacity
    return cut.select("doc_id", "source", "cluster", "copy", start.alias("first_word"), F.least(F.lit(capacity).cast("long"), F.col("size") - start).alias("n_words"))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, lanes: int = LANES) -> DataFrame:
    """(bin_group, bin, slot, doc_id, copy, first_word, n_words) per piece of (doc_id, source, cluster, size).

    No bin holds more than ``capacity`` words, more than ``lanes`` rests of one
    source or two rests of one cluster; a whole sequence is a bin of its own.  Rows without
    words give no piece.  A null source is a source; a null cluster conflicts
    with nothing but the other copies of the same id.
    """
    cut = pieces(docs, capacity)
    total = docs.filter("size > 0").count()
    groups = max(1, -(-total // group))
    cluster = F.coalesce(F.concat(F.lit("c"), F.col("cluster").cast("string")), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("d"))
    dealt = cut.select(
        F.pmod(F.xxhash64("doc_id", "source", "copy"), F.lit(groups)).alias("bin_group"), "doc_id", "source", cluster.alias("cluster"), "copy", "first_word", "n_words")
    whole = dealt.filter(F.col("n_words") == capacity)
    rests = dealt.filter(F.col("n_words") < capacity)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending"), ("copy", "ascending")])
        source, cluster = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist() for c in ("source", "cluster"))
        bins = best_fit(list(zip(table.column("n_words").to_pylist(), source, cluster)), capacity, lanes)
        filled: dict[int, int] = {}
        slots = []
        for b in bins:
            slots.append(filled.get(b, 0))
            filled[b] = slots[-1] + 1
        out = table.select(["bin_group", "doc_id", "copy", "first_word", "n_words"])
        return out.add_column(1, "bin", pa.array([f"r{b}" for b in bins])).add_column(2, "slot", pa.array(slots, pa.int32()))

    packed = rests.groupBy("bin_group").applyInArrow(fill, "bin_group long, bin string, slot int, doc_id long, copy long, first_word long, n_words long")
    # a bin's name within its group: r and a number for packed rests, w and the piece for whole sequences
    name = F.concat_ws("-", F.lit("w"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("source"), F.lit(""))), F.col("copy"), F.col("first_word"))
    alone = whole.select("bin_group", name.alias("bin"), F.lit(0).alias("slot"), "doc_id", "copy", "first_word", "n_words")
    return packed.unionByName(alone)


def pack_near_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pack`` for (doc_id, text, source): sizes in words, and the texts of a component of near copies are a cluster."""
    sized = sized_components(docs)
    return pack(stored(sized.withColumnRenamed("component", "cluster"), "sizes"), capacity, group)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pack`` for (doc_id, text, source): sizes in words, and texts that are equal but for ASCII case are a cluster."""
    text = F.coalesce("text", F.lit(""))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col("doc_id").cast("long"), "source", F.md5(lowered.cast("binary")).alias("cluster"), n_words(F.col("text")).alias("size"))
    return pack(stored(rows, "sizes"), capacity, group)
