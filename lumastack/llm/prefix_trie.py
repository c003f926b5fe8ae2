"""Conversation prefix trie: count-min screening finds the prefixes that may be shared; only those are shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, discard, integral, materialise

#: Rows of the count-min sketch, and the most cells of each. Two bits a cell: at most 64 MB in all.
ROWS = 4
CELLS = 1 << 26
#: Cells of a part of the sketch, the unit that tasks pass on.
PART = 1 << 16
#: Ids of one piece of a node's list of ends.
PIECE = 4_096
#: A node with over this share of all children is one of at most as many that are looked up by broadcast.
HEAVY = 1_000

NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seq, digest, words``: each conversation's turns in order (null turns first, then by role and text), as digests and word counts; null ids are left out."""
    integral(conversations, conv_id)
    said = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c_) for c, c_ in ((role, "role"), (text, "text"))]
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), *said)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("int").alias("seq"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c rebuilt: the first h turns of c - c % ``group``, then c's own after its first h; h = crc32(c) % ``most``.

    ``seq`` orders the turns of a conversation; a row with ``seq`` -1 and a
    null digest stands for the conversation itself, so turnless ones stay.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.where("seq = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), heads.alias("h"))
    bases = turns.where((F.col("conv_id") % group == 0) & (F.col("seq") < most - 1)).select(F.col("conv_id").alias("base"), "seq", "digest", "words")
    begun = ids.join(bases, "base").where(F.col("seq") < F.col("h")).select("conv_id", "seq", "digest", "words")
    return begun.unionAll(turns.where(F.col("seq") >= heads)).unionAll(ids.select("conv_id", F.lit(-1), F.lit(None).cast("binary"), F.lit(0).cast("long")))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, pa, pb, words, last``: the 128-bit digest of every prefix and of the prefix before it.

    A conversation's rows are streamed in order, so its length takes no memory;
    each digest is chained from the one before.
    """
    columns = ["conv_id", "depth", "a", "b", "pa", "pb", "words", "last"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    root = hashlib.md5(b"").digest()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which is a conversation's end if another one follows

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            digests = np.frombuffer(b"".join(r[2] + r[3] for r in rows), dtype="<i8").reshape(-1, 4)
            conv, depth, words, last = ([r[i] for r in rows] for i in (0, 1, 4, 5))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((conv, depth, *digests.T, words, last), types, strict=True)], columns)

        for part in batches:
            rows = []
            for conv, _, digest, words in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        rows.append((*held, True))
                    held = (conv, 0, root, root, 0)
                if digest is not None:
                    rows.append((*held, False))
                    held = (conv, held[1] + 1, hashlib.md5(held[2] + digest).digest(), held[2], words)
            if rows:
                yield batch(rows)
        if held is not None:
            yield batch([(*held, True)])

    dealt = turns.select("conv_id", "seq", "digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.mapInArrow(chain, "conv_id long, depth int, a long, b long, pa long, pb long, words long, last boolean")


def _cells(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch, numbered over all rows."""
    a, b = a.astype(np.uint64), b.astype(np.uint64) | np.uint64(1)
    mask = np.uint64(cells - 1)
    return np.stack([((a + np.uint64(j) * b) >> np.uint64(7) & mask) + np.uint64(j * cells) for j in range(ROWS)]).astype(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    four = counts.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    x = np.frombuffer(packed, dtype=np.uint8)
    return np.stack([x >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel()


def sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """The count-min sketch of all prefix digests, counts of 2 and over as 2, packed into two bits a cell.

    Every task counts its own rows and passes on the parts that aren't empty;
    parts are merged in order of their number, one at a time. The result has
    ROWS x ``cells`` / 4 bytes, whatever the rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ROWS * cells, dtype=np.uint8)
        for batch in batches:
            at, n = np.unique(_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells), return_counts=True)
            held[at] = np.minimum(2, held[at] + np.minimum(n, 2))
        size = min(PART, cells)
        full = np.flatnonzero(held.reshape(-1, size).any(axis=1))
        for i in full:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_pack(held[i * size : (i + 1) * size])], pa.binary())], ["part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([_pack(held)], pa.binary())], ["part", "counts"])
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != number:
                    if number is not None:
                        yield done()
                    number, held = i, _unpack(counts)
                else:
                    held = np.minimum(2, held + _unpack(counts))
        if number is not None:
            yield done()

    form = "part int, counts binary"
    parts = prefixes.select("a", "b").mapInArrow(count, form).repartition("part").sortWithinPartitions("part").mapInArrow(merge, form)
    size = min(PART, cells) // 4
    out = np.zeros(ROWS * cells // 4, dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.counts, dtype=np.uint8)
    return out


def _screened(prefixes: DataFrame, cells: int) -> DataFrame:
    """``prefixes`` with ``single``, which is only set where the sketch proves that one conversation has the prefix or a shorter one of it, and ``top``: the first such prefix of its conversation.

    A prefix of a proven one can be in a full cell all the same. So that it
    stays with its tail, rows are streamed in the order of their conversation.
    """
    sent = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, cells))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        last, proven = None, False  # the conversation of the row before, and whether one of its prefixes is proven
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            at = _cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), cells)
            one = ((counts[at >> 2] >> (2 * (at & 3)).astype(np.uint8)) & 3).min(axis=0) == 1
            fresh = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            carried = proven and not fresh[0]
            one[0] |= carried
            found, first = np.cumsum(one), np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
            single = found - found[first] + one[first] > 0
            before = np.concatenate([[carried], single[:-1] & ~fresh[1:]])
            last, proven = conv[-1], bool(single[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(single & ~before)], [*batch.schema.names, "single", "top"])

    ordered = prefixes.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(screen, "conv_id long, depth int, a long, b long, pa long, pb long, words long, last boolean, single boolean, top boolean")


def _ends(shared: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of the nodes at which conversations end: the ids in order are joined into pieces by range, then each node's pieces are hashed one after another."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != node or len(ids) == PIECE:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (a, b), []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["a", "b", "lowest", "ids"]), preserve_index=False)
                out = []
        if ids:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=["a", "b", "lowest", "ids"]), preserve_index=False)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["a", "b", "ends_sha256"]), preserve_index=False)
                out = []
        if node:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(*node, state.hexdigest())], columns=["a", "b", "ends_sha256"]), preserve_index=False)

    ends = shared.where("last").select("a", "b", "conv_id")
    pieces = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(join, "a long, b long, lowest long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "lowest").mapInArrow(digest, "a long, b long, ends_sha256 string")


def _with_parents(children: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``children`` with their parent's ``parent_conv_id`` by ``pa, pb``. Nodes with over a thousandth of all children, of which there are under a thousand, are broadcast; the others' children are spread evenly enough to be shuffled."""
    heavy = nodes.where(F.col("n_children") * HEAVY > total).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("parent_conv_id"))
    light = nodes.where(F.col("n_children") * HEAVY <= total).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("parent_conv_id"))
    by_heavy = children.join(F.broadcast(heavy), ["pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    known, rest = by_heavy.where("parent_conv_id IS NOT NULL OR depth = 0"), by_heavy.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id")
    return known.unionByName(rest.join(light, ["pa", "pb"]))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie's nodes, one row each: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, seq, digest, words``, one row a turn; a null
    digest stands for a conversation without turns. A node is a distinct
    sequence of the first d digests and is named by its depth and smallest
    member. ``saved_tokens`` sums (members - 1) x words of the last turn over
    the subtree; ``ends_sha256`` hashes the ids of the members that end there.

    All prefixes of all conversations go into a count-min sketch. A prefix
    that it counts once has one member, and so have all longer ones, whatever
    their own counts: these tails become nodes where they are. Only the other
    prefixes are grouped exactly. A subtree's sums are carried by each node's smallest
    member: along that conversation they are summed from the end, then over
    all members of a node. A sketch that is too small for the rows lets more
    prefixes through, it never changes the result.
    """
    spark = turns.sparkSession
    prefixes = materialise(_prefixes(turns), "trie-prefixes")
    n = prefixes.count()
    cells = min(CELLS, max(1 << 10, 1 << (2 * n - 1 if n else 1).bit_length()))
    rows = materialise(_screened(prefixes, cells), "trie-screened")
    discard(prefixes)
    shared = rows.where("NOT single")
    tails = rows.where("single")

    grouped = shared.groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("words").alias("words"))
    grouped = materialise(grouped, "trie-grouped")
    tops = rows.where("top AND depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("tops"))
    inner = grouped.where("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("inner"))
    nodes = grouped.join(tops.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left").join(inner.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left")
    nodes = materialise(nodes.fillna(0, ["tops", "inner"]).withColumn("n_children", F.col("tops") + F.col("inner")), "trie-nodes")
    discard(grouped)

    own = nodes.select(F.col("rep").alias("conv_id"), "depth", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("tops") + (F.col("n_children") == 0).cast("long")).alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    along = shared.select("conv_id", "depth", "a", "b", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")).unionAll(own)
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = along.select("a", "b", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved")).where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    hashed = lambda ids: F.sha2(ids.cast("binary"), 256)
    exact = nodes.join(sums, ["a", "b"]).join(_ends(shared), ["a", "b"], "left").select("pa", "pb", "depth", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    end: Column = F.when(F.col("last"), hashed(F.col("conv_id").cast("string"))).otherwise(F.lit(NO_ENDS))
    one = F.lit(1).cast("long")
    lone = [F.col("conv_id"), one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), end.alias("ends_sha256")]
    total = nodes.agg(F.sum("n_children")).first()[0] or 0
    linked = _with_parents(exact.unionByName(tails.where("top").select("pa", "pb", "depth", *lone)), nodes, total)
    deeper = tails.where("NOT top").select("depth", F.col("conv_id").alias("parent_conv_id"), *lone)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = linked.select(columns).unionByName(deeper.select(columns))
    return out.withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """``prefix_trie`` of the conversations as they are.

    Turns are ordered by turn, nulls first, then by role and text; a null
    role or text counts as empty, repeated rows as turns of their own; rows
    with a null conversation id are left out. No rows: no nodes.
    """
    return prefix_trie(turn_rows(conversations, **columns))


def rebuilt_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """``prefix_trie`` of the conversations rebuilt by ``with_shared_heads``; otherwise like ``conversation_trie``."""
    turns = materialise(turn_rows(conversations, **columns), "trie-turns")
    return prefix_trie(with_shared_heads(turns))
