"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Weights are whole shares of a cycle of slots; a slot takes one block of documents. Block i of a source of weight w is released at
slot floor(i / w) and due before slot ceil((i + 1) / w), i from 0. In each slot the released block with the earliest deadline
goes first. As the weights add up to one, no deadline is missed, so after any number of slots every source is less than one
block away from its weight. After a cycle all sources stand at a whole number of blocks, so the schedule of one cycle, made
by a fold over its slots, holds for all.

Documents of a source are numbered in a hash order, by hash ranges, so a source of any size is numbered in parallel. The
mixture ends once every document has come; sources that are short of documents by then have begun again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.llm.common import stored

#: Slots of a cycle, documents of a block; leading hex digits of the hash that make the ranges a source is numbered in.
CYCLE, BLOCK, DIGITS = 1000, 16, 3
#: Weights are proportional to the number of documents to this power.
POWER = 0.7


def shares(sizes: DataFrame, cycle: int = CYCLE, power: float = POWER) -> DataFrame:
    """Rows (source, n, share): of (source, n) the shares of the cycle by n to a power, one at least, `cycle` in all.

    Shares are rounded down and the rest goes to the largest remainders. More sources than slots are an error.
    """
    total = sizes.agg(F.sum(F.pow("n", F.lit(power))).alias("total"), F.count(F.lit(1)).alias("k"))
    # One row beside every source: what is above one slot each is dealt by weight.
    ideal = F.pow("n", F.lit(power)) / F.col("total") * (F.lit(cycle) - F.col("k"))
    ideal = F.when(F.col("k") > cycle, F.raise_error(F.lit("more sources than slots of a cycle"))).otherwise(ideal)
    rated = sizes.join(F.broadcast(total)).withColumn("ideal", ideal).withColumn("whole", F.floor("ideal"))
    rest = F.lit(cycle) - F.col("k") - F.sum("whole").over(Window.partitionBy("total"))
    order = Window.partitionBy("total").orderBy(F.desc(F.col("ideal") - F.col("whole")), "source")
    return rated.select("source", "n", (1 + F.col("whole") + F.when(F.row_number().over(order) <= rest, 1).otherwise(0)).cast("int").alias("share"))


def _slots(weights: Column, cycle: int) -> Column:
    """Per slot of a cycle the place of the source that has it, of an array of shares: earliest deadline first.

    The state is the blocks that each source has had; a source's next block i is released once i * cycle < share * (slot + 1),
    and due before slot ceil((i + 1) * cycle / share). There are more released blocks than one only while all can still meet
    their deadlines, and there is always one.
    """
    n = F.size(weights)
    start = F.struct(F.array_repeat(F.lit(0), n).alias("had"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        due = F.transform(
            weights,
            lambda w, j: F.when(
                F.get(state.had, j).cast("long") * cycle < w.cast("long") * (slot + 1),
                F.struct(F.ceil((F.get(state.had, j) + 1) * F.lit(float(cycle)) / w).alias("due"), j.alias("j")),
            ),
        )
        first = F.array_min(F.filter(due, lambda x: x.isNotNull())).j
        return F.struct(F.transform(state.had, lambda h, j: F.when(j == first, h + 1).otherwise(h)).alias("had"), F.concat(state.order, F.array(first)).alias("order"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(cycle - 1)), start, step, lambda s: s.order)


def schedule(weights: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Rows (source, n, share, slots): of (source, n, share) with the slots of a cycle that each source has, ascending."""
    # One row of a cycle's length: a source has one slot at least, so there are no more sources than slots.
    listed = weights.select(F.struct("source", "n", "share").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    cycle_of = listed.select("s", _slots(F.transform("s", lambda x: x.share), cycle).alias("order"))
    each = cycle_of.select(F.posexplode("s").alias("j", "x"), "order")
    place = F.transform("order", lambda o, i: F.when(o == F.col("j"), i))
    return each.select("x.source", "x.n", "x.share", F.filter(place, lambda p: p.isNotNull()).alias("slots"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with `_source` (null is a source of its own, named by an empty text), `_n` and `_i`: how many rows the source
    has, and the row's number among them, from 0, in an order by md5 of doc_id, then doc_id."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("_row"), source.alias("_source"), F.left(h, F.lit(DIGITS)).alias("_range"), h.alias("_hash"))
    counts = docs.select(source.alias("_source"), F.left(h, F.lit(DIGITS)).alias("_range")).groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("_k"))
    own = Window.partitionBy("_source")  # a row per range of a source
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(own).alias("_n"))
    order = Window.partitionBy("_source", "_range").orderBy("_hash", F.col("_row.doc_id").asc_nulls_first(), F.xxhash64("_row"))
    in_range = rows.withColumn("_at", F.row_number().over(order))
    return in_range.join(offsets, ["_source", "_range"]).select("_row", "_source", "_n", (F.col("_before") + F.col("_at") - 1).alias("_i"))


def placed(docs: DataFrame, weights: DataFrame | None = None, cycle: int = CYCLE, block: int = BLOCK) -> DataFrame:
    """Rows (_row, source, share, epoch, position, slot, release, deadline): every document, as often as the mixture takes it.

    `weights` are rows (source, share) of whole numbers that add up to `cycle`; without it, `shares` gives them. A document's
    position is its place in the mixture, slot * block and on; the last block of a source may end with documents of its next
    epoch. Sources without weight are an error of the caller and left out; sources without documents take no slots' rows.
    """
    rows = numbered(docs)
    sizes = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    known = shares(sizes, cycle) if weights is None else sizes.join(weights.select("source", "share"), "source")
    plan = stored(schedule(known, cycle), "mix-schedule")  # a row per source, `cycle` slots in all
    blocks = F.ceil(F.col("n") / block)
    last = F.floor((blocks - 1) / F.col("share")) * cycle + F.get("slots", F.pmod(blocks - 1, F.col("share")).cast("int"))
    horizon = plan.agg((F.max(last) + 1).alias("horizon"))  # slots until every document has come
    had = F.floor(F.col("horizon") / cycle) * F.col("share") + F.size(F.filter("slots", lambda s: s < F.pmod(F.col("horizon"), F.lit(cycle))))
    taken = plan.join(F.broadcast(horizon)).select(F.col("source").alias("_source"), "share", "slots", (had * block).alias("_taken"))
    # `cycle` numbers in all: bounded by the parameter, whatever the documents.
    both = rows.join(F.broadcast(taken), "_source").filter(F.col("_i") < F.col("_taken"))
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1 - F.col("_i")) / F.col("_n")))
    each = both.withColumn("epoch", F.explode(epochs)).withColumn("_at", F.col("_i") + F.col("epoch") * F.col("_n"))
    each = each.withColumn("_b", F.floor(F.col("_at") / block))
    slot = F.floor(F.col("_b") / F.col("share")) * cycle + F.get("slots", F.pmod("_b", F.col("share").cast("long")).cast("int"))
    return each.withColumn("slot", slot).select(
        "_row",
        F.col("_source").alias("source"),
        "share",
        "epoch",
        (F.col("slot") * block + F.pmod("_at", F.lit(block))).alias("position"),
        "slot",
        F.floor(F.col("_b") * F.lit(cycle) / F.col("share")).alias("release"),
        F.ceil((F.col("_b") + 1) * F.lit(cycle) / F.col("share")).alias("deadline"),
    )


def mixture(docs: DataFrame, weights: DataFrame | None = None, cycle: int = CYCLE, block: int = BLOCK) -> DataFrame:
    """Per taken document: doc_id, source, share, epoch, position, slot, release, deadline.

    Null ids and repeated rows are documents of their own; a null source is one source, named by an empty text. An empty
    table gives no rows. Other columns are not read.
    """
    rows = placed(docs.select("doc_id", "source"), weights, cycle, block)
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "source", "share", "epoch", "position", "slot", "release", "deadline")


def mixed(docs: DataFrame, weights: DataFrame | None = None, cycle: int = CYCLE, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, as often as the mixture takes them and in its order: sorted ranges of positions."""
    rows = placed(docs, weights, cycle, block).orderBy("position")
    return rows.select([F.col("_row").getField(c).alias(c) for c in docs.columns])

