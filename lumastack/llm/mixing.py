"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bucket_count, carried, materialise, restored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 1024
#: Sources that the driver may hold; more raise an error.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Share the sum of ``sizes`` by weight; a share stops at ``most`` times its size, and the excess is shared again among the rest."""
    left, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def source_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> list[dict]:
    """One record per source in code-point order, null last: ``source, source_size, target, words, slots, first`` (its first slot value)."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n) for r in rows]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    plan, first = [], 0
    for i, r in enumerate(rows):
        words = min(round(targets[i]), int(most * sizes[i]))
        slots = -(-words // block)
        plan.append({"sid": i, "source": r.source, "source_size": sizes[i], "target": targets[i], "words": words, "slots": slots, "first": first})
        first += slots
    return plan


PLAN_SCHEMA = "sid int, source string, source_size long, target double, words long, slots long, first long"


def schedule(plan: DataFrame, total: int) -> DataFrame:
    """The order of blocks: ``slot, sid, rank``.

    Slot j of 2^k takes the van der Corput point of j (its k bits reversed).
    Reversing permutes 0..2^k - 1, so laying the sources' slot counts end to end
    and looking up where the point falls gives each source exactly its count,
    spread evenly over the schedule; points past the last source are idle. The
    rank of a slot in its source counts the source's earlier slots: a count by
    (stretch of slots, source), its running sum, and a row number within the
    stretch, so that a source with most of the slots is in no single task.
    """
    spark = plan.sparkSession
    bits = max(1, (max(total, 1) - 1).bit_length())
    stretch = 1 << (bits // 2)
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    cell = 1 << max(0, bits - 12)
    cells = plan.where("slots > 0").select(
        "sid", "first", (F.col("first") + F.col("slots")).alias("end"), F.explode(F.expr(f"sequence(first div {cell}, (first + slots - 1) div {cell})")).alias("cell")
    )
    drawn = spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {cell}"))
    drawn = drawn.join(F.broadcast(cells), "cell").where("point >= first AND point < end").select("slot", "sid", F.expr(f"slot div {stretch}").alias("part"))
    before = drawn.groupBy("sid", "part").agg(F.count("*").alias("n"))
    before = before.select("sid", "part", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("before"))
    within = drawn.withColumn("k", F.row_number().over(Window.partitionBy("part", "sid").orderBy("slot")) - 1)
    return within.join(before, ["sid", "part"]).select("slot", "sid", (F.col("before") + F.col("k")).alias("rank"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, pieces, plan) of the mixture.

    Documents of a source are shuffled by hash and laid end to end; the stream
    repeats up to ``most`` times and is cut into blocks of ``block`` words. The
    schedule's slot with rank r of a source takes block r; the last block ends
    at the source's target. ``pieces`` has one row per (document, pass over the
    source, slot): ``uid, epoch, from_word, words, slot``. ``sized`` has every
    document: ``uid, doc_id, sid, size``.

    Null texts and texts without words have size 0 and are never taken; null
    sources are one source, the last; repeated rows count each on their own; an
    empty table gives empty results.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("content"))
    base = materialise(base, "mix-sizes")
    records = source_plan(base, weights, most, block)
    plan = spark.createDataFrame([tuple(r.values()) for r in records], PLAN_SCHEMA)
    small = F.broadcast(plan.select("sid", F.col("source").alias("source_"), "source_size", F.col("words").alias("take")))
    buckets = bucket_count(base.count())
    keyed = base.join(small, F.col("source").eqNullSafe(F.col("source_"))).withColumn("order", F.xxhash64("doc_id", "content"))
    keyed = keyed.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    w = Window.partitionBy("sid").orderBy("bucket")
    sums = sums.select("sid", "bucket", (F.sum("n").over(w) - F.col("n")).alias("base"), (F.sum("rows").over(w) - F.col("rows")).alias("row_base"))
    inner = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "content", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumns({"upto": F.sum("size").over(inner), "nth": F.count("*").over(inner)}).join(sums, ["sid", "bucket"])
    placed = placed.select(
        F.concat_ws("-", "sid", F.col("row_base") + F.col("nth")).alias("uid"),
        "doc_id", "sid", "size", "source_size", "take", "order", "content", (F.col("base") + F.col("upto") - F.col("size")).alias("start"),
    )
    placed = materialise(placed, "mix-placed")
    passes = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).where("lo < take").withColumn("hi", F.least(F.col("lo") + F.col("size"), "take"))
    blocks = passes.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    slots = schedule(plan, sum(r["slots"] for r in records))
    pieces = blocks.join(slots, ["sid", "rank"]).select(
        "uid", "doc_id", "epoch", "slot",
        (F.greatest("lo", F.col("rank") * block) - F.col("lo")).alias("from_word"),
        (F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)).alias("words"),
    )
    return placed, pieces, plan


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``: the words that the mixture takes of it, repeats counted."""
    placed, pieces, plan = mix(docs, **options)
    taken = pieces.groupBy("uid").agg(F.sum("words").alias("taken"))
    out = placed.select("uid", "doc_id", "sid", "size", "source_size").join(F.broadcast(plan.select("sid", "target")), "sid").join(taken, "uid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents (``doc_id``, ``text``, ``source`` and any others): one row per document and pass that takes words of it.

    A wholly taken document keeps its text; where a source's target ends within
    a document, the text is its taken words joined by one space. Each of several
    rows alike in doc_id and text takes its own share. Columns of any name pass
    through.
    """
    placed, pieces, _ = mix(docs, **options)
    spans = pieces.groupBy("uid", "epoch").agg(F.max(F.col("from_word") + F.col("words")).alias("upto"))
    takes = placed.select("uid", "doc_id", "order", "size").join(spans, "uid").groupBy("doc_id", "order", "uid", "size").agg(F.sort_array(F.collect_list("upto"), False).alias("takes"))
    key = [F.col("doc_id"), F.xxhash64("doc_id", F.xxhash64("text")).alias("order"), "text", carried(docs).alias("row")]
    rows = docs.select(*key)
    alike = placed.groupBy("doc_id", "order").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("order").alias("twin"))
    if alike.limit(1).count():
        # only rows that repeat are numbered, so no other text is shuffled for it
        same = lambda t: t["doc_id"].eqNullSafe(F.col("id")) & (t["order"] == F.col("twin"))
        takes = takes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "order").orderBy("uid")))
        numbered = rows.join(alike, same(rows), "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "order").orderBy("text")))
        rows = rows.join(alike, same(rows), "left_anti").withColumn("copy", F.lit(1)).unionByName(numbered)
    else:
        takes, rows = takes.withColumn("copy", F.lit(1)), rows.withColumn("copy", F.lit(1))
    takes = takes.select(F.col("doc_id").alias("id"), F.col("order").alias("twin"), F.col("copy").alias("nth"), "size", "takes")
    taken = rows.join(takes, rows["doc_id"].eqNullSafe(F.col("id")) & (F.col("order") == F.col("twin")) & (F.col("copy") == F.col("nth"))).withColumn("upto", F.explode("takes"))
    words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("upto").cast("int"))
    return restored(taken, docs, text=F.when(F.col("upto") >= F.col("size"), F.col("text")).otherwise(F.concat_ws(" ", words)))
