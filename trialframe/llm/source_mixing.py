"""Mixing sources to target weights by entropy balancing.

A document's rate is min(cap, exp(lambda * size / mean size of its source)): the rates nearest to 1 in
relative entropy that give every source its target of tokens and stay under the cap. The convex dual
has one multiplier per source; Newton steps, kept inside a bracket, solve all of them at once on the
table of (source, size) counts, which Spark aggregates. Rates are then rounded into whole copies.

Rounding: every document gets the whole part of its rate. The fractional parts, less a hash of the id, rank
documents for one more copy, and each source takes them in that order as far as its target allows. What is left
of the target is offered again to smaller documents, a few times. Prefixes are found on bins of the
rank first and inside one bin afterwards, so a source with a third of all rows is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
NEWTON = 40
BINS = 4096
OFFERS = 8
#: Up to so many sources, tables with a row for each are broadcast (a few MB).
SOURCES = 20_000


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target): `share` of all sizes split by weight, none above `cap` times its source.

    Sources by code point, null last, take the weights in turn. Giving the excess again to the others by
    weight ends in one level t with target = min(cap * size, weight * t), the largest that the ordered
    sources allow. One row per source, a list far smaller than the documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    listed = sources.select("*", weight.alias("w"), (cap * F.col("source_size") / weight).alias("full"))
    order = Window.orderBy("full", F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    level = listed.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("budget"),
        (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)) * cap).alias("held"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    ).withColumn("t", (F.col("budget") - F.coalesce("held", F.lit(0.0))) / F.col("rest"))
    top = level.withColumn("t", F.max(F.when(F.col("t") <= F.col("full"), F.col("t"))).over(whole))
    return top.select(
        "source",
        "source_size",
        F.least(cap * F.col("source_size"), F.coalesce(F.col("w") * F.col("t"), cap * F.col("source_size"))).alias("target"),
    )


def _rate(x, cap: float):
    return F.least(F.lit(cap), F.exp(F.least(x, F.lit(50.0))))


def multipliers(sizes: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = NEWTON, few: bool = True) -> DataFrame:
    """(source, lambda, mean): the dual solution for every source; null keys are a source of their own.

    Where the target is the cap itself the rates all are the cap, and lambda is null.
    """
    bins = staged(
        sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    )
    means = bins.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    open_targets = targets.filter((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)))
    state = _with(open_targets, means, few=few)
    state = staged(
        state.select("source", "target", "mean", *[F.lit(v).alias(c) for c, v in (("lam", 0.0), ("low", None), ("high", None))])
        .withColumns({c: F.col(c).cast("double") for c in ("lam", "low", "high")})
        .withColumn("off", F.lit(1.0))
    )
    for _ in range(steps):
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        rate = _rate(tilt, cap)
        mass = rate * F.col("size") * F.col("n")
        free = tilt < F.log(F.lit(cap))
        sums = _with(bins, state, few=few).groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("target", "mean", "lam", "low", "high")],
            F.sum(mass).alias("mass"),
            F.sum(F.when(free, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("mass") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        middle = F.when(low.isNull(), high - 1).when(high.isNull(), low + 1).otherwise((low + high) / 2)
        inside = F.coalesce((newton > F.coalesce(low, newton - 1)) & (newton < F.coalesce(high, newton + 1)) & (F.abs(newton - F.col("lam")) < 4), F.lit(False))
        state = staged(
            sums.select(
                "source", "target", "mean",
                F.when(F.abs(gap) <= 1e-9 * F.col("target"), F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"),
                low.alias("low"), high.alias("high"), (F.abs(gap) / F.col("target")).alias("off"),
            )
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= 1e-9:
            break
    return state.select("source", "lam", "mean")


def _with(left: DataFrame, right: DataFrame, how: str = "inner", few: bool = True) -> DataFrame:
    """Join on source, null equal to null; columns of both, source once.

    `right` has one row for each source. With `few`, which the caller has counted to be at most `SOURCES`, it is broadcast,
    so a source with a third of all rows is joined where its rows lie. With more sources the join deals rows by source and
    adaptive execution splits a hot one.
    """
    named = right.withColumnRenamed("source", "_right")
    return left.join(F.broadcast(named) if few else named, left["source"].eqNullSafe(named["_right"]), how).drop("_right")


def _offer(rows: DataFrame, gaps: DataFrame, few: bool = True) -> DataFrame:
    """`rows` (key, source, size, rank, extra) after one more prefix of those that fit is taken."""
    open_rows = _with(rows, gaps, "left", few).withColumn(
        "fits", F.coalesce((F.col("extra") == 0) & F.col("may") & (F.col("size") <= F.col("gap")) & (F.col("size") > 0), F.lit(False))
    ).withColumn("bin", F.least(F.lit(BINS - 1), F.floor((1 - F.col("rank")) / 2 * BINS)).cast("int"))
    bins = open_rows.filter("fits").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("gap").alias("gap"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (
        bins.withColumn("before", before)
        .filter((F.col("before") + F.col("bin_size") > F.col("gap")) & (F.col("before") <= F.col("gap")))
        .select("source", F.col("bin").alias("cut"), "before")
    )
    placed = _with(open_rows, cut, "left", few)
    # only the rows of one bin of a source are ordered together
    inside = placed.filter(F.col("fits") & (F.col("bin") == F.col("cut"))).withColumn(
        "upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(F.desc("rank"), "key").rowsBetween(Window.unboundedPreceding, 0))
    )
    taken = inside.filter("upto <= gap").select("key", F.lit(1).alias("now"))
    whole = F.col("fits") & F.coalesce(F.col("bin") < F.col("cut"), F.lit(True))
    merged = placed.join(taken, "key", "left")
    return merged.select(
        "key", "doc_id", "source", "size", "source_size", "target", "rate", "base", "rank", "may",
        F.when(whole | F.col("now").isNotNull(), 1).otherwise(F.col("extra")).alias("extra"),
    )


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows with `_size` and `_key`: a hash of id, source and size, and a number among rows equal in these.

    The number follows a hash of the text, so a text has its key whatever the order of the rows; equal texts may swap.
    """
    sized = docs.withColumn("_size", word_count(F.col(text))).withColumn("_hash", F.xxhash64(text))
    twins = Window.partitionBy(id_column, source, "_size").orderBy("_hash")
    return sized.withColumn("_key", F.xxhash64(id_column, source, "_size", F.row_number().over(twins))).drop("_hash")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, doc_id, size, source_size, target, rate, copies, taken) for every row; `key` as `keyed` gives it.

    Size: words of the text, 0 for null. Copies are whole and at most 2. Reruns agree: ranks come from a
    hash of the id, ties of repeated rows from a number among the rows with that id. Rows without an id share one hash
    sequence. Documents of size 0 get a copy of 1 and take nothing. Other columns are not read.
    """
    sized = docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = staged(keyed(sized).select("doc_id", "source", F.col("_size").alias("size"), F.col("_key").alias("key")))
    targets = staged(source_targets(rows))
    few = targets.count() <= SOURCES
    solved = multipliers(rows, targets, few=few)
    rated = _with(_with(rows, targets.select("source", "target", "source_size"), few=few), solved, "left", few).withColumn(
        "rate",
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("lam").isNull(), F.when(F.col("target") > 0, CAP).otherwise(0.0))
        .otherwise(_rate(F.col("lam") * F.col("size") / F.col("mean"), CAP)),
    )
    uniform = (F.pmod(F.xxhash64("key", F.lit("round")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    state = staged(
        rated.select(
            "key", "doc_id", "source", "size", "source_size", "target", "rate",
            F.floor("rate").cast("int").alias("base"),
            (F.col("rate") - F.floor("rate") - uniform).alias("rank"),
            (F.floor("rate") < CAP).alias("may"),
            F.lit(0).alias("extra"),
        )
    )
    for _ in range(OFFERS):
        gaps = state.groupBy("source").agg((F.first("target") - F.sum((F.col("base") + F.col("extra")) * F.col("size"))).alias("gap"))
        after = staged(_offer(state, gaps, few))
        moved = after.agg(F.sum("extra")).first()[0] == state.agg(F.sum("extra")).first()[0]
        state = after
        if moved:
            break
    copies = F.col("base") + F.col("extra")
    return state.select(
        "key", "doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )
