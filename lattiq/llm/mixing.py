"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

A source's documents form blocks.  Time runs in frames; a source with quota q
in a frame of L slots gets q of them, its j-th block being released at
floor(j L / q) and due at ceil((j + 1) L / q), and each slot goes to the
released block with the earliest deadline.  Quotas of a frame sum to L, so
every deadline is met and inside a frame a source never is a whole block away
from its quota.  Quotas are whole numbers, at least 1, and every frame rounds
alike, so over many frames a source can be many blocks away from its weight.
Frames with equal quotas have equal schedules.  A source's quota changes only
where its blocks run out, so with S sources there are at most 2 S + 1
different frames, and those are all that is scheduled: documents then find
their slot by arithmetic and one join.

``exact`` mixing has no frames and rounds no weights.  Let v be the time at
which each source has had v times its weight of blocks, or all it has; T(v),
the slots used by then, has a corner where a source runs out.  Block j of a
source of weight w is released at floor(T(j / w)) and due at
ceil(T((j + 1) / w)).  A source then never is a whole block away from its share
over all slots, and those left share what others leave by their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, fresh

BLOCK_DOCS = 16
FRAME_SLOTS = 1000
#: Rows of all different frames together, which are broadcast; larger patterns are written tables, if ``mix`` is asked for any number of sources.
MAX_PATTERN = 2_000_000


def _order(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def quotas(totals: DataFrame, weights: dict[str, float] | None, block: int, slots: int) -> DataFrame:
    """source, n, blocks, quota, w (the weight) of each source.

    ``weights`` are the targets; a source without one (all, by default)
    weighs the root of its documents, which tempers large sources.
    """
    weight = F.sqrt("n")
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        weight = F.coalesce(given[F.col("source")].cast("double"), weight)
    everything = Window.partitionBy(F.lit(0))
    share = F.round(slots * F.col("w") / F.sum("w").over(everything), 6)
    return totals.withColumn("w", weight).select("source", "n", F.ceil(F.col("n") / block).cast("long").alias("blocks"), F.greatest(F.lit(1), F.floor(share + 0.5)).cast("long").alias("quota"), "w")


def _slots(q: Column, length: Column) -> Column:
    """Which source (by place in the array) each slot of a frame with quotas q, of this sum, goes to."""
    start = F.struct(F.transform(q, lambda x: F.lit(0).cast("long")).alias("used"), F.array().cast("array<int>").alias("picks"))

    def step(state: Column, t: Column) -> Column:
        def due(u: Column, i: Column) -> Column:
            of = q[i]
            released = (u < of) & (F.floor(u * length / of) <= t)
            return F.when(released, F.ceil((u + 1) * length / of) * 100_000 + i)

        pick = (F.array_min(F.transform(state["used"], due)) % 100_000).cast("int")
        return F.struct(F.transform(state["used"], lambda u, i: F.when(i == pick, u + 1).otherwise(u)).alias("used"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), length - 1), start, step, lambda s: s["picks"])


def pattern(sources: DataFrame) -> DataFrame:
    """first_frame, source, k, slot: where the k-th block of a source in a frame goes.

    ``first_frame`` is the first of the frames that share a schedule.
    """
    one = sources.agg(F.sort_array(F.collect_list(F.struct("source", "blocks", "quota"))).alias("all"))
    ends = F.flatten(F.transform("all", lambda s: F.array(F.floor(s["blocks"] / s["quota"]), F.ceil(s["blocks"] / s["quota"]))))
    frames = one.select("all", F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), ends))).alias("first_frame"))
    left = F.transform("all", lambda s: F.greatest(F.lit(0).cast("long"), F.least(s["quota"], s["blocks"] - F.col("first_frame") * s["quota"])))
    frames = frames.withColumn("q", left).filter(F.exists("q", lambda x: x > 0))
    frames = frames.withColumn("length", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x))
    slots = frames.select("first_frame", "all", F.posexplode(_slots(F.col("q"), F.col("length"))).alias("slot", "i"))
    k = F.row_number().over(Window.partitionBy("first_frame", "i").orderBy("slot")) - 1
    return slots.select("first_frame", F.col("all")[F.col("i")]["source"].alias("source"), k.cast("long").alias("k"), "slot")


def earliest_deadline_first(jobs: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """The slot of each of ``jobs`` (g, source, k, r, d): each g has as many slots as jobs, ``longest`` at most.

    Unit jobs by priority have the same slots as if each in turn took the
    first free slot from r on.  So the half of the jobs that is due first
    takes the slots that it keeps busy by itself, the other half has those
    left idle, and each half is halved again.  A slot is idle where slots less
    jobs so far rise to a new height.  One window does that for all halves;
    only the first one orders all jobs of a g, short rows, in one task.
    """
    p = F.row_number().over(Window.partitionBy("g").orderBy("d", "source", "k")) - 1
    jobs = scratch.cut(jobs.select("g", "source", "k", "r", p.cast("long").alias("p")), "jobs")
    both = F.array(F.struct(F.col("r").alias("t"), F.lit(0).alias("is_slot")), F.struct(F.col("p").alias("t"), F.lit(1).alias("is_slot")))
    rows = jobs.select("g", "p", F.lit(0).cast("long").alias("node"), F.explode(both).alias("x")).select("g", "p", "node", "x.t", "x.is_slot")
    here = Window.partitionBy("g", "node").orderBy("t", "is_slot")
    is_slot = F.col("is_slot") == 1
    for right in reversed(range(max(0, longest - 1).bit_length())):
        late = F.shiftright("p", right).bitwiseAND(F.lit(1).cast("long"))
        step = F.when(is_slot, 1).when(late == 0, -1).otherwise(0)
        rows = rows.withColumn("late", late).withColumn("height", F.sum(step).over(here.rowsBetween(Window.unboundedPreceding, 0)))
        highest = F.coalesce(F.max("height").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        idle = (F.col("height") > F.greatest(highest, F.lit(0))).cast("long")
        rows = rows.withColumn("idle", idle).select("g", "p", (F.col("node") * 2 + F.when(is_slot, F.col("idle")).otherwise(F.col("late"))).alias("node"), "t", "is_slot")
    taken = rows.filter(is_slot).select("g", F.col("node").alias("p"), F.col("t").alias("slot"))
    return jobs.join(taken, ["g", "p"]).select("g", "source", "k", "slot")


def exact_jobs(sources: DataFrame) -> DataFrame:
    """g, source, k, r, d of all blocks from the weights themselves; a weight that is not above 0 counts as next to nothing."""
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(F.sum(F.greatest("w", F.lit(0.0))).over(Window.partitionBy(F.lit(0))) * 1e-12)
    sources = sources.select("source", "blocks", w.cast("double").alias("w")).withColumn("v", F.col("blocks") / F.col("w"))
    before = F.coalesce(F.sum("blocks").over(Window.orderBy("v", "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(Window.orderBy(F.desc("v"), F.desc("source")).rowsBetween(Window.unboundedPreceding, 0))
    none = F.lit(None)
    corners = sources.select(F.lit(0).alias("is_block"), none.cast("string").alias("source"), none.cast("long").alias("k"), "v", F.struct(before.alias("before"), left.alias("left")).alias("corner"))
    piece = 4096
    blocks = sources.select("source", "blocks", "w", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {piece})")).alias("c"))
    blocks = blocks.select("source", "w", F.explode(F.expr(f"sequence(c * {piece}, least(blocks, (c + 1) * {piece}) - 1)")).alias("k"))
    blocks = blocks.select(F.lit(1).alias("is_block"), "source", "k", ((F.col("k") + 1) / F.col("w")).alias("v"), none.cast(corners.schema["corner"].dataType).alias("corner"))
    # The last corner from the end of time on is the next one at or after v.
    corner = F.last("corner", ignorenulls=True).over(Window.orderBy(F.desc("v"), "is_block").rowsBetween(Window.unboundedPreceding, 0))
    ends = corners.union(blocks).withColumn("at", corner).filter("is_block = 1")
    # Sums of doubles miss whole numbers by less than that.
    end = ends.select("source", "k", F.round(F.col("at.before") + F.col("v") * F.col("at.left"), 6).alias("end"))
    start = F.coalesce(F.lag("end").over(Window.partitionBy("source").orderBy("k")), F.lit(0.0))
    return end.select(F.lit(0).alias("g"), "source", "k", F.floor(start).alias("r"), F.ceil("end").alias("d"))


def large_pattern(sources: DataFrame, n_slots: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``pattern`` as a table of any size, and frame, first_frame of all frames.

    Each slot of a frame scheduled is a block there is, so the pattern has no
    more rows than there are blocks.
    """
    frames = sources.select("source", "blocks", "quota", F.explode(F.expr("sequence(0L, (blocks - 1) div quota)")).alias("frame"))
    firsts = sources.select(F.explode(F.expr("array(0L, blocks div quota, (blocks + quota - 1) div quota)")).alias("first_frame")).distinct()
    active = frames.join(firsts, F.col("frame") == F.col("first_frame")).withColumn("q", F.expr("least(quota, blocks - first_frame * quota)"))
    active = active.withColumn("length", F.sum("q").over(Window.partitionBy("first_frame"))).select(F.col("first_frame").alias("g"), "source", "q", "length", F.explode(F.expr("sequence(0L, q - 1)")).alias("k"))
    jobs = active.select("g", "source", "k", F.expr("k * length div q").alias("r"), F.expr("((k + 1) * length + q - 1) div q").alias("d"))
    plan = scratch.cut(earliest_deadline_first(jobs, n_slots, scratch).withColumnRenamed("g", "first_frame"), "pattern")
    all_frames = frames.select("frame").distinct().join(firsts, F.col("frame") == F.col("first_frame"), "left")
    last = F.last("first_frame", ignorenulls=True).over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return plan.withColumn("slot", F.col("slot").cast("int")), scratch.cut(all_frames.select("frame", last.alias("first_frame")), "frames")


def _by_weight(placed: DataFrame, sources: DataFrame, scratch: Scratch, slots: int, any_number: bool) -> DataFrame:
    n_blocks = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    plan = scratch.cut(earliest_deadline_first(exact_jobs(sources), n_blocks, scratch), "pattern")
    plan = plan.select("source", F.col("k").alias("block"), F.floor(F.col("slot") / slots).alias("frame"), (F.col("slot") % slots).cast("int").alias("slot"))
    return placed.join(plan, ["source", "block"])


def _by_frames(placed: DataFrame, sources: DataFrame, scratch: Scratch, slots: int, any_number: bool) -> DataFrame:
    n_sources, n_slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    if (2 * n_sources + 1) * n_slots > MAX_PATTERN or n_sources >= 100_000:
        if not any_number:
            raise ValueError(f"{n_sources} sources: group the rare ones first, or ask for any number")
        plan, frames = large_pattern(sources, n_slots, scratch)
        placed = placed.join(sources.select("source", "quota"), "source")
        placed = placed.withColumn("frame", F.expr("block div quota")).withColumn("k", F.expr("block % quota"))
        return placed.join(frames, "frame").join(plan, ["first_frame", "source", "k"])
    plan = scratch.cut(pattern(sources), "pattern") if n_sources else pattern(sources)
    # Both of a size checked above.
    plan, per_source = F.broadcast(plan), F.broadcast(sources.select("source", "quota"))
    first_frames = F.broadcast(plan.agg(F.sort_array(F.collect_set("first_frame")).alias("firsts")))
    placed = placed.join(per_source, "source")
    placed = placed.withColumn("frame", F.floor(F.col("block") / F.col("quota"))).withColumn("k", F.col("block") % F.col("quota"))
    placed = placed.withColumn("one", F.lit(1)).join(first_frames.withColumn("one", F.lit(1)), "one")
    placed = placed.withColumn("first_frame", F.array_max(F.filter("firsts", lambda f: f <= F.col("frame"))))
    return placed.join(plan, ["first_frame", "source", "k"])


def mix(docs: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, block: int = BLOCK_DOCS, slots: int = FRAME_SLOTS, exact: bool = False, any_number: bool = False) -> DataFrame:
    """The place of every document in the mixture: doc_id, source, block, frame, slot, position.

    ``docs`` needs doc_id and source.  Nothing is dropped or repeated: when a
    source runs out the others share its slots by their weights.  A null
    source counts as the empty name.  Within a source documents are shuffled
    by md5 of doc_id, ties by doc_id; rows of one doc_id follow each other.
    ``position`` is dense from 0.  An empty table gives no rows.

    A source's ranks come from its 4096 buckets of md5, so no task holds a
    whole source, and positions from the frames, of ``slots`` blocks or so.
    ``exact`` keeps to the weights over all slots and takes any number of
    sources; frames are then ``slots`` slots each.  Without it, sources whose
    pattern is above MAX_PATTERN are refused, unless ``any_number`` has it
    made as a table, with the same results.
    """
    docs = check_columns(docs, "doc_id", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _order(F.col("doc_id")).alias("h"))
    docs = docs.withColumn("bucket", F.substring("h", 1, 3))
    counts = docs.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.cut(counts.select("source", "bucket", "n", before.alias("before")), "counts")
    sources = scratch.cut(quotas(counts.groupBy("source").agg(F.sum("n").alias("n")), weights, block, slots), "sources")
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1
    placed = docs.withColumn("rank", rank).join(counts.select("source", "bucket", "before"), ["source", "bucket"])
    placed = placed.withColumn("rank", F.col("rank") + F.col("before")).withColumn("block", F.floor(F.col("rank") / block))
    placed = (_by_weight if exact else _by_frames)(placed, sources, scratch, slots, any_number).select("doc_id", "source", "block", "frame", "slot", "rank")
    placed = scratch.cut(placed, "placed")

    frames = placed.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.coalesce(F.sum("n").over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frames = frames.select("frame", so_far.alias("so_far"))
    place = F.row_number().over(Window.partitionBy("frame").orderBy("slot", "rank")) - 1
    return placed.withColumn("place", place).join(frames, "frame").select("doc_id", "source", "block", "frame", "slot", (F.col("so_far") + F.col("place")).alias("position"))


def in_mixture_order(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs``, all rows and columns, in the order of the exact mixture over its partitions.

    Null sources count as the empty name and null doc_ids are like others;
    rows that share doc_id and source stand together.  Texts play no part,
    columns of any name are left alone, and an empty table gives none.
    """
    key, of, at = fresh(docs, "key", "of", "at")
    places = mix(docs, scratch, exact=True, **options).groupBy("doc_id", "source").agg(F.min("position").alias(at))
    places = scratch.cut(places.select(F.col("doc_id").alias(key), F.col("source").alias(of), at), "places")
    found = docs.join(places.hint("merge"), docs["doc_id"].eqNullSafe(places[key]) & (F.coalesce(docs["source"], F.lit("")) == places[of]))
    return found.repartitionByRange(at).sortWithinPartitions(at).select(*[docs[c] for c in docs.columns])


def with_position(rows: DataFrame, docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``rows``, one for each of ``docs``, with its position in the exact mixture of ``docs`` in place of source.

    Rows that share doc_id and source take the positions of that pair in the
    order of their other columns, so every position is taken once.  An empty
    table gives none.
    """
    key, of, nth, row_key, row_of, row_nth = fresh(rows, "key", "of", "nth", "row_key", "row_of", "row_nth")
    places = scratch.cut(mix(docs, scratch, exact=True, **options).select(F.col("doc_id").alias(key), F.col("source").alias(of), "position"), "positions")
    places = places.withColumn(nth, F.row_number().over(Window.partitionBy(key, of).orderBy("position")))
    others = [c for c in rows.columns if c != "source"]
    rows = rows.select(*others, F.col("doc_id").alias(row_key), F.coalesce("source", F.lit("")).alias(row_of))
    rows = rows.withColumn(row_nth, F.row_number().over(Window.partitionBy(row_key, row_of).orderBy(*others)))
    same = rows[row_key].eqNullSafe(places[key]) & (rows[row_of] == places[of]) & (rows[row_nth] == places[nth])
    return rows.join(places.hint("merge"), same).select(*others, "position")
