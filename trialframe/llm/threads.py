"""Reply order: from each message's parent to its root, depth and place, and conversations written in that order.

Parents are earlier turns, so the messages of a conversation form trees. Ancestors are found by pointer doubling, one
join for each power of two, and subtree sizes and places are added up along the same pointers; a conversation of any
length or depth is spread over tasks, and each round is written. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Turn numbers whose siblings are added up together.
TURNS = 1024
#: Messages of a block of a written conversation.
BLOCK = 512


def _doubled(nodes: DataFrame) -> list[DataFrame]:
    """Tables (m, up, far, depth, size) by round k: `up` is the ancestor 2^k above, or null; the last has no `up` left.

    `far` is the highest ancestor reached, `depth` its distance, `size` the messages less than 2^k below and at `m`.
    """
    start = nodes.select(
        "m", "up", F.coalesce("up", "m").alias("far"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("n").alias("size")
    )
    rounds = [staged(start)]
    while rounds[-1].filter("up IS NOT NULL").limit(1).count():
        state = rounds[-1]
        above = state.select(F.col("m").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("depth").alias("_depth"))
        moved = state.filter("up IS NOT NULL").join(above, "up")
        moved = moved.select("m", F.col("_up").alias("up"), F.col("_far").alias("far"), (F.col("depth") + F.col("_depth")).alias("depth"), "size")
        gains = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("m")).agg(F.sum("size").alias("gain"))
        # rows without a pointer stay out of the join on it: they would all have one key
        both = moved.unionByName(state.filter("up IS NULL")).join(gains, "m", "left")
        rounds.append(staged(both.select("m", "up", "far", "depth", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))))
    return rounds


def reply_order(messages: DataFrame) -> DataFrame:
    """(m, root, depth, place, n) for each distinct (conv_id, turn) `m` of (conv_id, turn, reply_to).

    `root`: the turn that starts the thread; `depth`: replies between; `place`: messages of the thread before it when
    each message is followed by its replies, by turn, each with all of its own replies. `n` messages have this turn
    and share the place. Of different `reply_to` of one turn the greatest counts.
    """
    m = F.struct("conv_id", "turn").alias("m")
    nodes = messages.groupBy(m).agg(F.max("reply_to").alias("reply_to"), F.count("*").alias("n"))
    up = F.struct(F.col("m.conv_id").alias("conv_id"), F.col("reply_to").alias("turn"))
    nodes = staged(nodes.select("m", F.when(F.col("reply_to").isNotNull(), up).alias("up"), "n"))
    rounds = _doubled(nodes)
    last = rounds[-1]
    # messages between a parent and its reply: the parent's own, and the subtrees of earlier replies to it
    sizes = nodes.filter("up IS NOT NULL").join(last.select("m", "size"), "m")
    sizes = sizes.withColumn("block", F.floor(F.col("m.turn") / TURNS))
    past = (Window.unboundedPreceding, -1)
    inside = F.sum("size").over(Window.partitionBy("up", "block").orderBy("m.turn").rowsBetween(*past))
    totals = sizes.groupBy("up", "block").agg(F.sum("size").alias("total"))
    earlier = totals.select("up", "block", F.sum("total").over(Window.partitionBy("up").orderBy("block").rowsBetween(*past)).alias("earlier"))
    parents = nodes.select(F.col("m").alias("up"), F.col("n").alias("first"))
    steps = sizes.withColumn("inside", inside).join(earlier, ["up", "block"]).join(parents, "up")
    none = F.lit(0).cast("long")
    steps = steps.select("m", (F.col("first") + F.coalesce("inside", none) + F.coalesce("earlier", none)).alias("place"))
    places = staged(steps.unionByName(nodes.filter("up IS NULL").select("m", none.alias("place"))))
    for state in rounds[:-1]:
        above = places.select(F.col("m").alias("up"), F.col("place").alias("above"))
        jumps = state.filter("up IS NOT NULL").select("m", "up").join(above, "up").select("m", "above")
        places = staged(places.join(jumps, "m", "left").select("m", (F.col("place") + F.coalesce("above", none)).alias("place")))
    return last.join(places, "m").join(nodes.select("m", "n"), "m").select("m", F.col("far.turn").alias("root"), "depth", "place", "n")


def conversations(linked: DataFrame, order: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, root, block, part, n_messages, messages): the threads of `linked` in reply order, in blocks of messages.

    Blocks follow one another by `block`; `part` is 0 but for a turn number that more than `block` messages have. Other columns of
    `linked` are kept in `messages`, an array ordered by place (then turn, role and the others).
    """
    others = [c for c in linked.columns if c not in ("conv_id", "turn", "role")]
    rows = linked.withColumn("m", F.struct("conv_id", "turn")).join(order, "m")
    part = F.pmod(F.xxhash64("role", "body"), F.ceil(F.col("n") / block))
    message = F.struct("place", "turn", "role", "depth", *others).alias("message")
    rows = rows.select("conv_id", "root", F.floor(F.col("place") / block).alias("block"), part.alias("part"), message)
    # a block split in parts has its other messages in part 0 too
    return rows.groupBy("conv_id", "root", "block", "part").agg(
        F.count("*").alias("n_messages"), F.sort_array(F.collect_list("message")).alias("messages")
    )
