"""Line dedup by a suffix array over line ids, in DataFrame operations alone.

A suffix of a document is the sequence of its lines from one place on.  Lines
get ids by a distributed sort of their digests, and suffixes get ranks by
prefix doubling: in round k a suffix's rank, by its first 2^k lines, is
refined by the rank of the suffix 2^k lines on.  Each round sorts the distinct
pairs over all tasks and appends a pair's place in that order to the rank, so
a rank is an array of numbers, ranks compare as the suffixes do, and those
that agree in their first k + 1 numbers share their first 2^k lines.  A suffix
whose pair is its own alone is ranked and goes through no further round.  So
is one whose lines on end, or go on with a line found nowhere else: its rank
ends with a mark, and those of the same rank share just the lines up to there.
Suffixes that begin with a line found nowhere else are never looked at.

Sorted by rank, and by place where ranks are equal, suffixes make the suffix
array.  A neighbour's longest common prefix (LCP) needs looking up only where
the lines before the two differ: else it is that of the suffixes one line
before, less one.  An LCP interval, a stretch of the array whose neighbours
share so many lines or more, holds all copies of a run of lines; the copy in
the first place stays and the others go.  What a suffix shares with the nearer
of its neighbours is the longest run from there on that is repeated at all,
and where that reaches further than the one before it, a maximal repeated run
begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, fresh

#: A repeated run counts from so many lines ...
MIN_LINES = 2
#: ... or as one line from so many words.
MIN_WORDS = 50

#: Where a line is: its document's id (has is 0 for none, 1 else), text (by digest) and place in it.
DOC = ("has", "doc", "tag")
PLACE = (*DOC, "line")
#: In a rank: here the suffix ends, or goes on with a line that is found once.
_END = (1 << 63) - 1


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """has, doc, tag, line, name (digest), long (whether it counts by itself) of each line."""
    x = F.col("x")
    words = F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # No line of fewer characters has so many words.
    long = F.when(F.length(x) >= 2 * min_words - 1, words >= min_words).otherwise(False)
    docs = docs.filter("text IS NOT NULL").select(F.col("doc_id").isNotNull().cast("int").alias("has"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n")).alias("line", "x"))
    return docs.select(*PLACE, F.unhex(F.md5(x.cast("binary"))).alias("name"), long.alias("long"))


def _classes(rows: DataFrame, *key: str) -> DataFrame:
    """The distinct keys of rows, and whether each has one place alone; rows of one place are one."""
    found = rows.groupBy(*key).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in PLACE for f in (F.min, F.max)])
    alone = F.lit(True)
    for c in PLACE:
        alone = alone & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    return found.select(*key, alone.alias("alone"))


def _numbered(keys: DataFrame, *key: str) -> DataFrame:
    """keys with ``number``, which is in the order of the key over all tasks."""
    return keys.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("number", F.monotonically_increasing_id())


def suffix_ranks(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """has, doc, tag, line, long, rank, size of the suffixes that begin with a repeated line.

    ``size`` counts the lines before the mark that ends a rank, and is 0 for
    ranks without one.
    """
    lines = scratch.cut(_lines(check_columns(docs, "doc_id", "text"), min_words), "lines")
    ids = scratch.cut(_numbered(_classes(lines, "name").filter("NOT alone").select("name"), "name"), "ids")
    first = lines.join(ids.hint("merge"), "name").select(*PLACE, "long", F.array("number").alias("rank"), F.lit(0).alias("size"))
    # Rows that repeat doc_id and text are one document.
    nth = F.row_number().over(Window.partitionBy(*PLACE).orderBy("line"))
    now = scratch.cut(first.withColumn("nth", nth).filter("nth = 1").select(*PLACE, "long", "rank", "size", F.lit(False).alias("done")), "round-0")
    scratch.drop("lines")
    finished, held, h, turn = [], None, 1, 0
    by_doc = Window.partitionBy(*DOC)
    while not now.filter("NOT done").isEmpty():
        everything = now if held is None else now.union(held)
        after = F.first(F.struct("rank", "size")).over(by_doc.orderBy("line").rangeBetween(h, h))
        # Ranks of documents in which no suffix goes on are not looked up again.
        goes_on = F.max(~F.col("done")).over(by_doc)
        passed = scratch.cut(everything.withColumn("next", after).withColumn("goes_on", goes_on), f"passed-{turn}")
        finished.append(passed.filter("done AND NOT goes_on").select(*PLACE, "long", "rank", "size"))
        held = passed.filter("done AND goes_on").select(*now.columns)
        live = passed.filter("NOT done").select(*PLACE, "long", "rank", F.element_at("rank", -1).alias("own"), F.col("next.rank").alias("after"), F.col("next.size").alias("size"))
        pairs = _numbered(_classes(live.filter("after IS NOT NULL"), "own", "after"), "own", "after")
        pairs = scratch.cut(pairs, f"numbers-{turn}").select(F.col("own").alias("_own"), F.col("after").alias("_after"), "alone", "number")
        found = live.filter("after IS NOT NULL").join(pairs.hint("merge"), (F.col("own") == F.col("_own")) & (F.col("after") == F.col("_after")))
        ends = F.col("size") > 0
        more = F.concat("rank", F.array("number"), F.when(ends, F.array(F.lit(_END))).otherwise(F.array().cast("array<bigint>")))
        found = found.select(*PLACE, "long", more.alias("rank"), F.when(ends, F.col("size") + h).otherwise(0).alias("size"), (F.col("alone") | ends).alias("done"))
        found = found.union(live.filter("after IS NULL").select(*PLACE, "long", F.concat("rank", F.array(F.lit(_END))).alias("rank"), F.lit(h).alias("size"), F.lit(True).alias("done")))
        turn, h = turn + 1, 2 * h
        now = scratch.cut(found, f"round-{turn}")
        scratch.drop(f"numbers-{turn - 1}", f"round-{turn - 1}")
    ranks = now.drop("done")
    for x in finished if held is None else [*finished, held.drop("done")]:
        ranks = ranks.union(x)
    return ranks


def _shared(a: Column, b: Column, size: Column) -> tuple[Column, Column]:
    """How many lines two ranks show that both share, and whether there may be more; ``size`` is that of a."""
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    both = F.when(a.isNull() | b.isNull(), 0).when(same == 0, F.size(a)).otherwise(same - 1)
    ended = F.coalesce((both > 0) & (F.get(a, both - 1) == _END), F.lit(False))
    lines = F.when(ended, size).when(both > 0, F.pow(F.lit(2.0), both - 1).cast("int")).otherwise(0)
    return lines, (both > 1) & ~ended


def suffix_array(ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``ranks`` with part, at (a row's part of the array, and place in that), prev (the place before) and lcp with that."""
    order = ("rank", *PLACE)
    ranks = ranks.withColumn("before", F.first(F.get("rank", 0)).over(Window.partitionBy(*DOC).orderBy("line").rangeBetween(-1, -1)))
    table = scratch.cut(ranks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sorted")
    entry = F.struct(*order, "before")
    in_part = Window.partitionBy("part").orderBy(*order)
    ends = table.groupBy("part").agg(F.max(entry).alias("end")).select(F.col("part").alias("_part"), F.lag("end").over(Window.orderBy("part")).alias("end"))
    rows = table.withColumn("at", F.row_number().over(in_part)).withColumn("prev", F.lag(entry).over(in_part))
    rows = rows.join(ends.hint("merge"), F.col("part") == F.col("_part")).withColumn("prev", F.when(F.col("at") == 1, F.col("end")).otherwise(F.col("prev"))).drop("_part", "end")
    inherits = F.coalesce(F.col("before") == F.col("prev.before"), F.lit(False))
    # The first 2^k lines are shared; behind those there may be more, but not as many again.
    length, more = _shared(F.col("rank"), F.col("prev.rank"), F.col("size"))
    rows = rows.select(*PLACE, "long", F.get("rank", 0).alias("first"), "part", "at", F.struct(*[F.col(f"prev.{c}").alias(c) for c in PLACE]).alias("prev"), inherits.alias("inherits"), length.alias("lcp"), (more & ~inherits).alias("open"))
    rows = scratch.cut(rows, "neighbours")

    looked, turn = [], 0
    todo = rows.filter("open").select(*PLACE, "prev", "lcp")
    while not todo.isEmpty():
        at = lambda name: table.select(*[F.col(c).alias(f"{name}_{c}") for c in PLACE], F.col("rank").alias(name), F.col("size").alias(f"{name}_size"))
        a, b = at("a"), at("b")
        here = [F.col(c) == F.col(f"a_{c}") for c in DOC] + [F.col("line") + F.col("lcp") == F.col("a_line")]
        there = [F.col(f"prev.{c}") == F.col(f"b_{c}") for c in DOC] + [F.col("prev.line") + F.col("lcp") == F.col("b_line")]
        # A place that is not there goes on with a line that is found once: no more is shared.
        found = todo.join(a.hint("merge"), here).join(b.hint("merge"), there)
        length, more = _shared(F.col("a"), F.col("b"), F.col("a_size"))
        found = scratch.cut(found.select(*PLACE, "prev", (F.col("lcp") + length).alias("lcp"), more.alias("open")), f"lcp-{turn}")
        looked.append(found)
        todo, turn = found.filter("open").drop("open"), turn + 1
    if looked:
        best = looked[0].select(*PLACE, "lcp")
        for x in looked[1:]:
            best = best.union(x.select(*PLACE, "lcp"))
        best = best.groupBy(*PLACE).agg(F.max("lcp").alias("more")).select(*[F.col(c).alias(f"_{c}") for c in PLACE], "more")
        rows = rows.join(best.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in PLACE], "left").withColumn("lcp", F.coalesce("more", "lcp"))
    reach = F.last(F.when(~F.col("inherits"), F.col("line") + F.col("lcp")), ignorenulls=True).over(Window.partitionBy(*DOC).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return scratch.cut(rows.select(*PLACE, "long", "first", "part", "at", "prev", (reach - F.col("line")).alias("lcp")), "array")


def _intervals(array: DataFrame, at_least: int) -> DataFrame:
    """The rows of the array with ``interval``, a number that the rows of an LCP interval have in common."""
    cut = (F.col("lcp") < at_least).cast("long")
    before = array.groupBy("part").agg(F.sum(cut).alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    here = F.sum(cut).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return array.withColumn("interval", here).join(before.hint("merge"), F.col("part") == F.col("_part")).withColumn("interval", F.col("interval") + F.col("n")).drop("_part", "n")


def _later(rows: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """The rows that aren't the first place of their key."""
    firsts = rows.groupBy(key).agg(F.min(F.struct(*PLACE)).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_key"), "least")
    return rows.join(scratch.cut(firsts, name).hint("merge"), F.col(key) == F.col("_key")).filter(F.col("least") < F.struct(*PLACE))


def maximal_runs(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """The maximal repeated runs of lines, all copies of them: doc_id, tag, line, end (the line after the last).

    A run counts if it is found elsewhere as well, and can't be made longer on
    either side and still be; copies may overlap.  Null texts have no lines,
    rows that repeat doc_id and text are one document (``tag`` tells apart
    texts of one doc_id), and an empty table gives none.
    """
    array = suffix_array(suffix_ranks(docs, scratch), scratch)
    other = array.filter("lcp > 0").select(*[F.col(f"prev.{c}").alias(c) for c in PLACE], "lcp")
    longest = array.select(*PLACE, "lcp").union(other).groupBy(*PLACE).agg(F.max("lcp").alias("lcp"))
    end = F.col("line") + F.col("lcp")
    before = F.max(end).over(Window.partitionBy(*DOC).orderBy("line").rangeBetween(-1, -1))
    runs = longest.withColumn("before", before).filter(F.col("before").isNull() | (end > F.col("before"))).filter(F.col("lcp") >= min_lines)
    return runs.select(F.when(F.col("has") == 1, F.col("doc")).alias("doc_id"), "tag", "line", end.alias("end"))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The stretches of lines that go: doc_id, tag, runs (array of first line and end).

    A later copy of ``min_lines`` lines goes, so a later copy of any longer
    run does, whose parts those are.  Copies that overlap are one stretch;
    those that only meet stay apart.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    array = suffix_array(suffix_ranks(docs, scratch, min_words), scratch)
    copies = _later(_intervals(array, min_lines), "interval", scratch, "firsts").select(*PLACE, (F.col("line") + min_lines).alias("reach"))
    if min_lines > 1:
        copies = copies.union(_later(array.filter("long"), "first", scratch, "first-lines").select(*PLACE, (F.col("line") + 1).alias("reach")))
    reach = copies.groupBy(*PLACE).agg(F.max("reach").alias("reach"))
    by_doc = Window.partitionBy(*DOC).orderBy("line")
    so_far = F.max("reach").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = reach.withColumn("fresh", F.when(F.col("line") < so_far, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*DOC, "run").agg(F.min("line").alias("line"), F.max("reach").alias("end"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("line", "end"))).alias("runs")).select(F.when(F.col("has") == 1, F.col("doc")).alias("doc_id"), "tag", "runs")


def drop_repeated_lines(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Deletes later copies of repeated runs of lines from each text.

    ``docs`` needs doc_id and text; lines end at line feeds.  A line goes if
    it is part of a run of ``min_lines`` lines or more, or is one line of
    ``min_words`` words or more, with a copy at an earlier place; places are
    ordered by doc_id (null first), then by a digest of the text for one
    doc_id, then by line.  The first copy always stays, so rows that repeat
    doc_id and text stay alike.  Runs never reach across documents.  Null
    texts stay null with no lines; an empty text has one empty line.

    Returns a row for each row: doc_id, n_lines, n_deleted, n_runs (stretches
    of deleted lines), text.
    """
    docs = check_columns(docs, "doc_id", "text")
    key, tag = fresh(docs, "key", "tag")
    runs = scratch.cut(repeated_runs(docs, scratch, min_lines, min_words).select(F.col("doc_id").alias(key), F.col("tag").alias(tag), "runs"), "runs")
    found = docs.join(runs.hint("merge"), docs["doc_id"].eqNullSafe(runs[key]) & (F.xxhash64(docs["text"]) == runs[tag]), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (r["line"] <= i) & (i < r["end"])))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines)
    deleted = F.when(F.col("runs").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    n_runs = F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs"))
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), n_runs.cast("long").alias("n_runs"), text.alias("text"))
