"""Substring dedup over words: a de Bruijn graph of token k-mers, compacted through joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise
from .repeats import Units, checked, cleaned_documents, distinct_segments, packed_documents, removed_spans, row_id, segments, shared_anchors

#: Words of a window, and of the m-gram that anchors it.
WINDOW = 13
ANCHOR = 7


def kmer_edges(pieces: DataFrame, k: int = WINDOW) -> DataFrame:
    """Token k-mers of distinct segments as edges: ``skey, at, edge binary, tail long, head long, origin, last``.

    An edge leads from the k-mer's first k - 1 words to its last k - 1 (their
    64-bit hashes); the edge itself is named by 128 bits of its words.
    """

    kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = ["skey", "at", "edge", "tail", "head", "doc", "pos", "last"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows: list[tuple] = []
        for batch in batches:
            for key, doc, start, last, content in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                words = content.split(b" ")
                head = signed(xxh3_64_intdigest(b" ".join(words[: k - 1])))
                for i in range(len(words) - k + 1):
                    tail, head = head, signed(xxh3_64_intdigest(b" ".join(words[i + 1 : i + k])))
                    rows.append((key, i, xxh3_128_digest(b" ".join(words[i : i + k])), tail, head, doc, start + i, last))
                    if len(rows) >= 20_000:
                        yield table(rows)
                        rows = []
        yield table(rows)

    flat = pieces.select("skey", "origin.doc_id", "origin.start", "last", "content")
    out = flat.mapInArrow(cut, "skey binary, at int, edge binary, tail long, head long, doc long, pos int, last long")
    return out.select("skey", "at", "edge", "tail", "head", F.struct("doc", "pos").alias("origin"), "last")


def compact_paths(edges: DataFrame) -> DataFrame:
    """Compact repeated nonbranching paths: ``skey, at, n, first, source``.

    Edges of two documents at least stay. A node with one such edge in and one
    out doesn't branch; a segment's consecutive edges through such nodes make
    one path as long as their first occurrences are consecutive words of one
    source document. ``first`` is that document, ``source`` the word there.
    """
    kept = edges.groupBy("edge").agg(F.min("origin").alias("source"), F.max("last").alias("last"), F.first("tail").alias("tail"), F.first("head").alias("head"))
    kept = materialise(kept.where("last > source.doc").select("edge", "tail", "head", "source"), "debruijn-kept")
    ends = kept.select(F.explode(F.array(F.struct(F.col("tail").alias("node"), F.lit(1).alias("out")), F.struct(F.col("head").alias("node"), F.lit(0).alias("out")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.count_if(F.col("e.out") == 0).alias("into"))
    through = nodes.where("out = 1 AND into = 1").select(F.col("node").alias("tail"), F.lit(True).alias("straight"))
    placed = kept.join(through, "tail", "left").select("edge", "source", F.coalesce("straight", F.lit(False)).alias("straight"))
    rows = edges.select("skey", "at", "edge").join(placed, "edge").select("skey", "at", "source.doc", "source.pos", "straight")
    line = Window.partitionBy("skey").orderBy("at")
    goes_on = (F.lag("at").over(line) == F.col("at") - 1) & (F.lag("doc").over(line) == F.col("doc")) & (F.lag("pos").over(line) == F.col("pos") - 1) & F.col("straight")
    rows = rows.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("begins").over(line))
    return rows.groupBy("skey", "path").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"), F.min("doc").alias("first"), F.min("pos").alias("source")).drop("path")


def repeated_spans(packed: DataFrame, shared: DataFrame, units: Units) -> DataFrame:
    """``rid, spans``: the word spans of each row that windows of smaller documents cover.

    Segments are runs of k-mers with one anchor. If all documents agree on the
    words around an anchor, they are one path as they stand. Where they differ,
    the graph branches: those segments' k-mers become edges and are compacted.
    Each step is written to the shared folder and then dropped.
    """
    found = materialise(segments(packed, shared, units), "debruijn-segments")
    pieces = materialise(distinct_segments(found), "debruijn-pieces")
    branching = pieces.groupBy("anchor").agg(F.count("*").alias("ways")).where("ways > 1")
    edges = materialise(kmer_edges(pieces.join(branching, "anchor", "left_semi"), units.k), "debruijn-edges")
    alone = pieces.where("last > origin.doc_id").join(branching, "anchor", "left_anti")
    whole = alone.select("skey", F.lit(0).alias("at"), F.col("windows").alias("n"), F.col("origin.doc_id").alias("first"), F.col("origin.start").alias("source"))
    paths = whole.unionByName(compact_paths(edges))
    origins = materialise(paths.groupBy("skey").agg(F.collect_list(F.struct("at", "n", "first", "source")).alias("runs")), "debruijn-paths")
    discard(pieces, edges)
    spans = materialise(removed_spans(found, origins, units.k), "debruijn-spans")
    discard(found, origins)
    return spans


def remove_repeated_windows(
    docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """Remove each word that a window of ``k`` words covers whose words also start in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, n_spans, kept_sha256`` and with
    ``carry`` also ``kept`` (the words left, joined by one blank; untouched texts
    as they are) and ``row`` (the other columns by position). Windows are judged
    on the input. Null texts have no words; texts of fewer than k words keep all;
    rows with a null doc_id are neither judged nor judge; repeated rows, and
    different texts that share a doc_id, don't remove each other and keep their
    own spans; ids that are no whole numbers are an error; an empty table gives
    no rows.
    """
    units = Units("word", k, anchor)
    packed = packed_documents(checked(docs, doc_id), doc_id, text, carry)
    spans = repeated_spans(packed, shared_anchors(docs.select(row_id(doc_id, text).alias("rid"), F.col(text).alias("text")), units), units)
    return cleaned_documents(packed, spans, units).withColumnRenamed("units", "n_words")
