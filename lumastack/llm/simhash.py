"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees of shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: A tree holds at most this many fingerprints; larger shards are split, and every pair of parts is searched.
TREE = 2_048

_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles' XXH64 values, repeats included; a bit is set if over half of them have it. No words: 0."""
    from xxhash import xxh64_intdigest

    words = _WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    n = len(last)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        spans = zip(starts[at : min(at + 8192, n)].tolist(), last[at : at + 8192].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every whole text; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(v.as_py(), shingle) for v in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Keys of a metric tree: a node's children are keyed by their whole Hamming distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, key: int) -> None:
        if self.root is None:
            self.root = [key, {}]
            return
        node = self.root
        while d := (key ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [key, {}]
                return
            node = child

    def within(self, key: int, radius: int) -> list[int]:
        """Keys at most ``radius`` away: only edges within radius of the distance are followed."""
        found, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            d = (key ^ node[0]).bit_count()
            if d <= radius:
                found.append(node[0])
            if node[1]:
                open_ += [child for e, child in node[1].items() if d - radius <= e <= d + radius]
        return found


def shard_links(tree_keys: list[int], asked: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``radius`` among ``asked`` and the tree's keys: a spanning forest, not all pairs."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out = []
    same = tree_keys is asked
    if not same:
        for key in tree_keys:
            tree.add(key)
    for key in asked:
        for near in tree.within(key, radius):
            if (a := root(near)) != (b := root(key)):
                parent[b] = a
                out.append((near, key))
        if same:
            tree.add(key)
    return out


def radius_links(keys: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links ``a, b`` that connect all distinct 64-bit ``fp`` within ``radius`` of each other.

    Two such fingerprints agree on one of radius + 1 bands of bits, so each
    band's value is a shard, whose members go to one tree. A shard with more
    than ``tree`` members is split by hash into parts; every pair of parts is a
    task's group of its own (one part's tree, asked by the other's members), so
    no group outgrows two parts and no link is lost.
    """
    bands = radius + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    band = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    entries = keys.select("fp", F.posexplode(F.array(*band)).alias("band", "value"))
    sizes = entries.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.expr(f"cast(ceil(n / {tree}) as int)"))
    large = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")),
        )
    )
    placed = entries.join(sizes, ["band", "value"]).withColumn("part", F.pmod(F.xxhash64("fp", "band"), F.col("parts")).cast("int"))
    placed = placed.withColumn("pair", F.explode(large)).select("band", "value", "pair.i", "pair.j", "part", "fp")
    group = ["band", "value", "i", "j"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame(columns=[*group, "part", "fp"])

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            key = rows[group].to_numpy()
            edges = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            fps, parts, out = rows.fp.to_numpy(), rows.part.to_numpy(), []
            for lo, hi, (_, _, i, j) in zip([0, *edges], [*edges, len(rows)], key[[0, *edges]], strict=True):
                mine = [x & 0xFFFFFFFFFFFFFFFF for x in fps[lo:hi].tolist()]
                if i == j:
                    out += shard_links(mine, mine, radius)
                else:
                    of = parts[lo:hi] == i
                    out += shard_links([x for x, t in zip(mine, of, strict=True) if t], [x for x, t in zip(mine, of, strict=True) if not t], radius)
            flat = np.array(out, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": flat[:, 0], "b": flat[:, 1]})

        for batch in batches:
            rows = pd.concat([rest, batch]) if len(rest) else batch
            if not len(rows):
                continue
            key = rows[group].to_numpy()
            open_ = np.flatnonzero(np.any(key != key[-1], axis=1))
            cut = open_[-1] + 1 if len(open_) else 0
            if cut:
                yield links(rows.iloc[:cut])
            rest = rows.iloc[cut:]
        if len(rest):
            yield links(rest)

    return placed.repartition(*group).sortWithinPartitions(*group, "part", "fp").mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id, links``.

    component_id is the smallest doc_id that links of at most ``radius``
    differing bits reach; ``links`` is how many other documents share the
    component. Texts without words, and null texts, have fingerprint zero, which
    links like any other. Repeated rows stay; a null doc_id is never the
    smallest.
    """
    fps = materialise(fingerprints(docs, doc_id, text, shingle), "simhash")
    keys = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-keys")
    labels = connected_components(radius_links(keys.select("fp"), radius))
    rooted = keys.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), (F.sum("n") - 1).alias("links"))
    by_key = rooted.select("fp", "root").join(groups, "root").select("fp", "component_id", "links")
    return fps.join(by_key, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")
