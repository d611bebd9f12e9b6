"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Inside a source every document is expected so many times, in proportion to a measure
of it (a power of its size, or a column), at most ``most`` times; the factor is solved so that expected words add up to
the target. The whole part of that number are certain copies. What is left over, below 1, is the chance of one more:
documents are ranked by random odds over inclusion odds, and the first of them that hold the words still missing are
taken, a sample of fixed size in which chances differ. A few documents fill what a whole document would overshoot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm.shared import last_staged, staged, staged_folders, unwrapped, word_count

#: Bins for a doubling of the rank or of the measure: a source has some thousands of either, however large it is. Only the
#: bin in which the sample ends is looked at row by row.
BINS = 256
ADDED = ("size", "source_size", "target", "expected", "copies")
_WORK = ("_key", "_measure")


def sized(docs: DataFrame, *, size: Column | None = None, measure: Column | None = None, power: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds ``size``, ``_key`` (from id and text: reruns agree) and ``_measure``.

    ``measure`` says how often documents of a source are expected relative to each other; one that is null, not a number
    or not above 0 counts as 1. Without one it is size to the ``power``; 0 is equal chances.
    """
    out = docs.withColumns({
        "size": word_count(F.col("text")) if size is None else F.coalesce(size.cast("bigint"), F.lit(0)),
        "_key": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
    })
    if measure is None:
        return out.withColumn("_measure", F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(float(power))))
    m = measure.cast("double")
    return out.withColumn("_measure", F.when((m > 0) & ~F.isnan(m) & (m < float("inf")), m).otherwise(1.0))


def targets(sizes: DataFrame, *, source: str = "source", weights: Sequence[float] = (1, 2, 3), total: float | None = None, most: float = 3.0) -> DataFrame:
    """From one row per source (source, source_size), add ``target``.

    Sources in order of code points, null last, weigh ``weights``, repeating, and share ``total`` (all sizes together
    if None). No target is above ``most`` times its source's size: the excess goes to the others by weight, as long as
    one is above. If all are at their bound, the rest of ``total`` is left over. Sources are ranked in one task, one row
    each.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("_w", F.element_at(cycle, (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights) + 1))
    ranked = staged(ranked, "sources")
    full = float(ranked.agg(F.sum("source_size")).first()[0] or 0) if total is None else float(total)
    bound = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:  # words per weight; it only rises, and ends once no further source is at its bound
        at_bound = F.col("_w") * level >= bound
        held, free = ranked.agg(F.sum(F.when(at_bound, bound)), F.sum(F.when(~at_bound, F.col("_w")))).first()
        if not free or (now := (full - (held or 0.0)) / free) <= level:
            break
        level = now
    return ranked.withColumn("target", F.least(F.col("_w") * level, bound)).drop("_w")


def _bin(x: Column) -> Column:
    return F.floor(F.log2(x) * BINS).cast("int")


def _same(source: str) -> Column:
    return F.col(f"l.{source}").eqNullSafe(F.col(f"r.{source}"))


def factors(narrow: DataFrame, share: DataFrame, *, source: str, most: float) -> DataFrame:
    """``share`` with ``_factor``: expected copies are the lesser of ``most`` and the factor times a document's measure.

    A source's documents are summed in bins of the measure, largest first. The factor is that of the first bin from
    which on none is expected more than ``most`` times, all above it being at ``most``. Documents in a bin count with
    their own measures, so expected words miss the target by a part of one bin at most, and never exceed it.
    """
    bins = narrow.filter("size > 0").groupBy(source, _bin(F.col("_measure")).alias("_m"))
    bins = bins.agg(F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_measure")).alias("_product"), F.max("_measure").alias("_top"))
    above = Window.partitionBy(source).orderBy(F.col("_m").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(source).orderBy(F.col("_m").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bins = bins.select(source, "_m", "_top", F.coalesce(F.sum("_words").over(above), F.lit(0)).alias("_above"), F.sum("_product").over(below).alias("_below"))
    each = bins.alias("l").join(share.select(source, "target").alias("r"), _same(source)).select("l.*", "target")
    each = each.withColumn("_factor", (F.col("target") - F.lit(most) * F.col("_above")) / F.col("_below"))
    fits = each.filter(F.col("_factor") * F.col("_top") <= F.lit(most) * (1 + 1e-12))
    first = fits.groupBy(source).agg(F.max(F.struct("_m", "_factor"))["_factor"].alias("_factor"))
    out = share.alias("l").join(first.alias("r"), _same(source), "left").select("l.*", "_factor")
    # where no bin fits, every document is at its most
    return out.withColumn("_factor", F.greatest(F.coalesce("_factor", F.lit(float("inf"))), F.lit(0.0)))


def ranked(docs: DataFrame, share: DataFrame, *, source: str, most: float) -> DataFrame:
    """Adds the columns of ``share``, ``expected``, the certain copies ``_whole``, and ``_rank`` with its ``_bin``.

    The rank is random odds over inclusion odds; it is null for documents without words and where no chance is left.
    """
    found = docs.alias("l").join(share.alias("r"), _same(source), "left").select("l.*", "source_size", "target", "_factor")
    expected = F.when(F.col("size") > 0, F.least(F.lit(most), F.col("_factor") * F.col("_measure"))).otherwise(0.0)
    out = found.withColumn("expected", expected)
    out = out.withColumn("_whole", F.floor(F.col("expected") + 1e-9).cast("int"))
    p = F.col("expected") - F.col("_whole")
    u = (F.shiftrightunsigned("_key", 11).cast("double") + 0.5) / F.lit(float(2**53))
    out = out.withColumn("_rank", F.when((F.col("size") > 0) & (p > 1e-9), u / (1.0 - u) * ((1.0 - p) / p)))
    return out.withColumn("_bin", _bin(F.col("_rank"))).drop("_factor")


def plan(narrow: DataFrame, *, source: str = "source", most: float = 3.0, **options) -> DataFrame:
    """One row per source: its size, target and factor, and where its sample ends.

    ``narrow`` holds the source and what ``sized`` adds. A source's ranks are counted in bins first, so that the
    running sum over single rows is over one bin, however large the source is.
    """
    before = staged_folders()
    sizes = narrow.groupBy(source).agg(F.sum("size").alias("source_size"))
    share = staged(factors(narrow, targets(sizes, source=source, most=most, **options), source=source, most=most), "targets")
    every = staged(ranked(narrow, share, source=source, most=most).select(source, "size", "target", "_whole", "_rank", "_key", "_bin"), "ranks")
    words = lambda where: F.coalesce(F.sum(F.when(where, F.col("size"))), F.lit(0))
    rest = every.groupBy(source).agg(F.max("target").alias("target"), F.sum(F.col("_whole") * F.col("size")).alias("_sure"), words(F.col("_rank").isNotNull()).alias("_open"))
    rest = staged(rest.select(source, (F.col("target") - F.col("_sure")).alias("_rest"), "_open"), "rest")

    some = every.filter("_rank is not null").select(source, "size", "_rank", "_key", "_bin")
    bins = some.groupBy(source, "_bin").agg(F.sum("size").alias("_words"))
    so_far = F.sum("_words").over(Window.partitionBy(source).orderBy("_bin")) - F.col("_words")
    ends = bins.withColumn("_before", so_far).alias("l").join(rest.alias("r"), _same(source)).filter("_before <= _rest and _rest < _before + _words")
    ends = staged(ends.select(f"l.{source}", F.col("l._bin").alias("_end"), (F.col("_rest") - F.col("_before")).alias("_room")), "ends")

    # ranks that are equal belong to rows equal in id and text, which are taken together
    last = some.alias("l").join(ends.alias("r"), _same(source)).filter("l._bin = r._end").select("l.*", "_room")
    run = F.sum("size").over(Window.partitionBy(source).orderBy("_rank", "_key"))
    last = last.withColumn("_run", run).filter("_run <= _room").groupBy(source).agg(F.max(F.struct("_rank", "_key")).alias("_last"), F.max("_run").alias("_run"))
    ends = ends.alias("l").join(last.alias("r"), _same(source), "left").select(f"l.{source}", "_end", "_last", (F.col("_room") - F.coalesce("_run", F.lit(0))).alias("_gap"), F.lit(False).alias("_all"))
    # where the words missing are no fewer than those of all chances, all are taken, and there is no end
    whole = rest.filter("_rest >= _open").select(source, F.lit(None).cast("int").alias("_end"), F.lit(None).cast(ends.schema["_last"].dataType).alias("_last"), (F.col("_rest") - F.col("_open")).alias("_gap"), F.lit(True).alias("_all"))
    ends = staged(ends.unionByName(whole), "ends")

    # the words still missing are less than the next document's; those that may help have fewer than twice as many, and a
    # place left: documents not taken come before another copy of one that is
    later = every.filter("size > 0").alias("l").join(ends.alias("r"), _same(source)).filter("size < 2 * _gap").withColumn("_more", F.col("_rank").isNotNull() & _taken(F.col("l._bin")))
    later = later.filter(F.col("_whole") + F.col("_more").cast("int") < F.lit(int(most)))
    place = (F.col("_more") | F.col("_rank").isNull()).cast("int").alias("again")
    later = later.groupBy(f"l.{source}", place, F.coalesce("_rank", F.lit(0.0)).alias("_rank"), "_key", "_gap").agg(F.sum("size").alias("size"))
    offered = later.groupBy(source, F.floor(F.log2("size")).alias("_class")).agg(F.min(F.struct("again", "_rank", "_key", "size")).alias("o"), F.max("_gap").alias("_gap"))
    offered = offered.groupBy(source).agg(F.reverse(F.array_sort(F.collect_list(F.struct("o.size", "o._key")))).alias("o"), F.max("_gap").alias("_gap"))
    fill = offered.select(source, _filling(F.col("o"), F.col("_gap")).alias("_fill"))

    out = share.alias("l").join(ends.drop("_gap").alias("r"), _same(source), "left").select("l.*", "_end", "_last", "_all")
    return last_staged(out.alias("l").join(fill.alias("r"), _same(source), "left").select("l.*", "_fill"), "mix", before)


def _filling(offered: Column, gap: Column) -> Column:
    """Keys of the offered documents (one for each doubling of the size, the first by rank, largest first) that fill a gap:
    those that fit into what is left of it, and last the one that comes nearest, if it comes nearer than none."""
    none = F.filter(offered, lambda _: F.lit(False))
    start = F.struct(gap.cast("double").alias("gap"), none.alias("taken"))

    def step(held: Column, o: Column) -> Column:
        more = F.struct((held["gap"] - o["size"]).alias("gap"), F.concat(held["taken"], F.array(o)).alias("taken"))
        return F.when(o["size"] <= held["gap"], more).otherwise(held)

    def end(held: Column) -> Column:
        off = lambda o: F.abs(held["gap"] - o["size"])
        left = F.filter(offered, lambda o: ~F.array_contains(held["taken"], o) & (off(o) < held["gap"]))
        nearest = F.array_min(F.transform(left, lambda o: F.struct(off(o).alias("off"), o.alias("o"))))
        return F.when(nearest.isNull(), held["taken"]).otherwise(F.concat(held["taken"], F.array(nearest["o"])))

    return F.transform(F.aggregate(offered, start, step, end), lambda o: o["_key"])


def _taken(bin_: Column) -> Column:
    inside = F.when(bin_ == F.col("_end"), F.coalesce(F.struct("_rank", "_key") <= F.col("_last"), F.lit(False)))
    return F.coalesce(F.col("_all"), F.lit(False)) | F.coalesce(F.when(bin_ < F.col("_end"), True).otherwise(F.coalesce(inside, F.lit(False))), F.lit(False))


def copies(docs: DataFrame, mix: DataFrame, *, source: str = "source", most: float = 3.0) -> DataFrame:
    """Adds ``source_size``, ``target``, ``expected`` and ``copies`` to rows that ``sized`` has been through."""
    share = mix.select(source, "source_size", "target", "_factor")
    ends = mix.select(source, "_end", "_last", "_fill", "_all")
    found = ranked(docs, share, source=source, most=most).alias("l").join(ends.alias("r"), _same(source), "left")
    filled = (F.col("size") > 0) & F.coalesce(F.array_contains("_fill", F.col("l._key")), F.lit(False))
    chosen = F.col("l._rank").isNotNull() & _taken(F.col("l._bin"))
    count = (F.col("_whole") + chosen.cast("int") + filled.cast("int")).cast("int").alias("copies")
    return found.select("l.*", count).drop(*_WORK, "_whole", "_rank", "_bin")


def mix(docs: DataFrame, *, seed: int = 0, measure: Column | None = None, power: float = 0.0, most: float = 3.0, **options) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``expected`` and ``copies``, the times that the mix takes each.

    docs: doc_id, text, source and any other columns; columns named like those added are replaced. ``measure``, ``power``:
    see ``sized``; weights and total: see ``targets``. No document is taken more than ``most`` times, rounded down.
    Null texts and texts without words have size 0 and are never taken; null is a source, the last. A very long text is
    taken as a whole or not; rows equal in id and text are taken together. An empty table gives an empty result.
    ``explode_copies`` repeats the rows.
    """
    held = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", *([] if measure is None else [measure.alias("measure")]))
    ready = sized(held, measure=None if measure is None else F.col("measure"), power=power, seed=seed)
    before = staged_folders()
    narrow = staged(ready.select("source", "size", *_WORK), "sizes")
    found = last_staged(plan(narrow, most=most, **options), "mixed", before)
    out = copies(ready, found, most=most)
    return out.select(*unwrapped(out, *ADDED), *ADDED)


def explode_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(*ADDED)
