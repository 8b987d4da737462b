"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions alone.

1. Targets: each source gets words by weight, at most ``most_epochs`` times its size, the excess reshared.
2. Every source is a shuffled stream of its documents, cut into blocks of ``block_words`` words (the last one shorter).
   Its quota is the number of blocks that makes its target, the last one taken in part.
3. Slot n of the schedule is the point n * golden ratio (mod 1, in 31-bit integers), mapped through the cumulative
   quotas to a source.  A slot's rank among its source's slots is the number of the block it takes, in epochs; slots
   beyond the quota fall away, and the few blocks that the points leave over follow in slots at the end.
4. Slots join blocks on (source, block), blocks join the documents' pieces: what a document gives, and the first slot
   that takes words of it.  ``mix_schedule`` lists the slots themselves, the order in which a reader takes the blocks.

Ranks and offsets come from sums by chunks first and windows within a chunk, so no window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, id_out, with_ids

#: The golden ratio as a 31-bit fraction, and its period.
GOLDEN, PERIOD = 1327217885, 2**31
#: Slots or documents in one chunk of a rank or offset, about.
CHUNK = 2048
#: Words of a block, whatever the size of the corpus.
BLOCK_WORDS = 64
#: Cells that cut [0, 1) to look a point up by an equi-join.
CELLS = 4096


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """source, source_size, target from rows (source, source_size); one row for each source, null last.

    The targets min(most * size, level * weight) use up all words: with sources in order of most * size / weight, the
    level is what remains after the full sources, over the weights of the others."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_full", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("_rank", F.row_number().over(order)).withColumn("_w", w)
    cap = F.col("source_size").cast("double") * most_epochs
    out = out.withColumn("_cap", cap).withColumn("_full", F.col("_cap") / F.col("_w"))
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(by_fill), F.lit(0.0))
    heavy = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_fill), F.lit(0.0))
    # level if this and all later sources stay below their cap; the first for which that holds is the level
    out = out.withColumn("_level", left / heavy)
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(everything)["_level"]
    level = F.coalesce(level, F.lit(float("inf")))
    return out.select("source", "source_size", F.least("_cap", level * F.col("_w")).alias("target"), F.col("_rank").alias("rank"))


def _sizes(scratch: Scratch, docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, size, source, place (in the shuffled order of the source), _h: a stored table."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = with_ids(docs, n_words(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("_h"), digest.alias("_md5"))
    # rows of one id, a null one too, lie apart unless their texts are equal
    place = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)), "_md5").cast("binary"))
    return scratch.keep(rows.select("doc_id", "size", "source", place.alias("place"), "_h"), "sizes")


def _plan(scratch: Scratch, rows: DataFrame, weights: tuple[int, ...], most_epochs: int, block_words: int) -> DataFrame:
    """A row for each source: target, quota in words and blocks, its part of the schedule."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    totals = scratch.keep(totals, "totals")
    targets = source_targets(totals.select("source", "source_size"), weights, most_epochs)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.floor(F.col("target") + 1e-6).cast("long")
    epochs = F.when(F.col("source_size") > 0, (F.col("quota") / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    table = (
        targets.join(totals.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("blocks", blocks)
        .withColumn("quota", quota)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
        .withColumn("need", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    )
    upto = Window.orderBy("rank")
    table = table.withColumn("_to", F.sum("need").over(upto)).withColumn("slots", F.sum("need").over(Window.partitionBy(F.lit(1))))
    return scratch.keep(table.withColumn("_from", F.col("_to") - F.col("need")), "targets")


def _turns(scratch: Scratch, table: DataFrame) -> DataFrame:
    """slot, rank (of the source), turn (the number of the block it takes, in epochs), need: one row for each turn of a quota."""
    total = table.agg(F.coalesce(F.max("slots"), F.lit(0)).alias("n")).first()["n"]
    point = F.pmod(F.pmod(F.col("slot"), F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(PERIOD))
    reach = table.where("need > 0").select(
        "rank", "need", (F.col("_from") / F.col("slots")).alias("lo"), (F.col("_to") / F.col("slots")).alias("hi")
    )
    cells = reach.withColumn("cell", F.explode(F.sequence((F.col("lo") * CELLS).cast("int"), F.least((F.col("hi") * CELLS).cast("int"), F.lit(CELLS - 1)))))
    slots = table.sparkSession.range(total).select(F.col("id").alias("slot"), (point.cast("double") / PERIOD).alias("u")).withColumns({"cell": (F.col("u") * CELLS).cast("int")})
    slots = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "rank", (F.col("slot") / CHUNK).cast("long").alias("chunk"), "need")
    slots = scratch.keep(slots, "slots")
    before = slots.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("need").alias("need"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("_n"))
    within = Window.partitionBy("rank", "chunk").orderBy("slot")
    ranked = slots.withColumn("_in", F.row_number().over(within) - 1).join(before.select("rank", "chunk", "_before"), ["rank", "chunk"])
    ranked = ranked.select("slot", "rank", (F.col("_before") + F.col("_in")).alias("turn"), "need").where("turn < need")
    # blocks that the points leave over: turns from the number of slots a source got up to its quota, one source after another
    got = slots.groupBy("rank").agg(F.count(F.lit(1)).alias("_got"))
    short = table.join(got, "rank", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("need > _got")
    short = short.withColumn("_at", F.sum(F.col("need") - F.col("_got")).over(Window.orderBy("rank")) - F.col("need"))
    extra = short.select("rank", F.explode(F.sequence("_got", F.col("need") - 1)).alias("turn"), "need", "_at")
    extra = extra.select((F.lit(total) + F.col("_at") + F.col("turn")).alias("slot"), "rank", "turn", "need")
    return ranked.unionByName(extra)


def mix_schedule(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """slot, source, epoch, block, words: what each slot of the mix takes, in the order of slots.  Among the first n slots every
    source has nearly its share, for every n.  Parameters and edge cases as for ``mix``."""
    scratch = Scratch(docs.sparkSession)
    table = _plan(scratch, _sizes(scratch, docs, seed), weights, most_epochs, block_words)
    turns = _turns(scratch, table).drop("need").join(table.select("rank", "source", "blocks", "need", "rest", "source_size"), "rank")
    block = F.pmod("turn", F.col("blocks"))
    last = (F.col("turn") == F.col("need") - 1) & (F.col("rest") > 0)
    words = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    words = F.when(last, F.pmod(F.col("rest") - 1, F.lit(block_words)) + 1).otherwise(words)
    return turns.select("slot", "source", (F.col("turn") / F.col("blocks")).cast("long").alias("epoch"), block.alias("block"), words.cast("long").alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for every row of ``docs``.

    A null text has size 0; a null source is a source of its own, the last; documents of size 0 take nothing; repeated
    rows and equal texts are documents of their own.  Each source takes its target rounded down, no document more than
    ``most_epochs`` times its size.  first_slot is the first slot of the schedule that takes words of the document, null
    if none does.  The order in a source follows a hash of doc_id, text and seed, so reruns agree.  Blocks have
    ``block_words`` words; the schedule has a slot for each, so it grows with the words of the mix.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _sizes(scratch, docs, seed)
    table = _plan(scratch, rows, weights, most_epochs, block_words)
    turns = _turns(scratch, table).drop("need").join(table.select("rank", "blocks", "need", "rest"), "rank")
    # the last turn of a source takes the first words of its block alone
    last = (F.col("turn") == F.col("need") - 1) & (F.col("rest") > 0)
    uses = turns.groupBy("rank", F.pmod("turn", F.col("blocks")).alias("block")).agg(
        F.sum(F.when(last, 0).otherwise(1)).alias("whole"),
        F.max(F.when(last, F.pmod(F.col("rest") - 1, F.lit(block_words)) + 1).otherwise(0)).alias("part"),
        F.min(F.when(~last, F.col("slot"))).alias("whole_slot"),
        F.min(F.when(last, F.col("slot"))).alias("part_slot"),
    )

    # -- blocks: offsets of the documents in their source's stream
    known = table.select(F.col("source").alias("_s"), "rows", "rank")
    placed = rows.join(known, rows["source"].eqNullSafe(known["_s"]))
    part = F.pmod(F.conv(F.substring("place", 1, 6), 16, 10).cast("long"), F.greatest((F.col("rows") / CHUNK).cast("long"), F.lit(1)))
    placed = placed.select("doc_id", "size", "place", "_h", "rank", part.alias("chunk"))
    sums = placed.groupBy("rank", "chunk").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("_sum")).drop("_sum")
    in_chunk = Window.partitionBy("rank", "chunk").orderBy("place", "doc_id", "_h", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("size").over(in_chunk)).withColumn("_nth", F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("place", "doc_id", "_h", "size")))
    placed = placed.join(sums, ["rank", "chunk"]).select(
        "doc_id", "size", "rank", F.concat_ws("-", "chunk", "_nth").alias("row"), (F.col("_base") + F.col("_end") - F.col("size")).alias("begin")
    )
    placed = scratch.keep(placed, "placed")
    pieces = placed.where("size > 0").select(
        "rank", "row", "begin", "size",
        F.explode(F.sequence((F.col("begin") / block_words).cast("long"), ((F.col("begin") + F.col("size") - 1) / block_words).cast("long"))).alias("block"),
    )
    edge = F.col("block") * block_words
    lo, hi = F.greatest("begin", edge) - edge, F.least(F.col("begin") + F.col("size"), edge + block_words) - edge
    words = F.col("whole") * (hi - lo) + F.greatest(F.least(hi, F.col("part")) - lo, F.lit(0))
    first = F.least("whole_slot", F.when(F.col("part") > lo, F.col("part_slot")))
    taken = pieces.join(uses, ["rank", "block"]).groupBy("rank", "row").agg(F.sum(words).alias("taken"), F.min(first).alias("first_slot"))
    out = placed.join(taken, ["rank", "row"], "left").join(table.select("rank", "source_size", "target"), "rank")
    return out.select(id_out(), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
