"""Quotation linking: quoted passages are led back to the messages they come from.

A line that starts with `>` marks is quoted, its level is the number of marks. Consecutive lines of one level without
a blank line between them are a passage. Passages are normalised (marks, line ends and white space), hashed, and joined on the
hash to the passages of earlier messages of the same conversation; single lines are joined too, as weaker evidence. A message
is placed under the earlier message that holds most of the text it quotes at level 1, the latest of equals. Only
DataFrame functions are used; passages are shuffled as hashes, never as text. A passage that many turns hold is compared
once for each set of such passages and the latest earlier turn is found in blocks of turns, so neither a long conversation nor a
line that it repeats is paired with itself or ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Turns that are ordered together; a conversation of any length has one row for each block beyond that.
TURNS = 1024
#: A passage that more turns of a conversation write is compared by sets of passages; results do not depend on it.
COMMON = 16
#: Weight of a character of a passage; one of a line counts 1.
WHOLE = 4
#: Levels and reach of the quotes that `as_replies` writes.
LEVELS, REACH = 3, 4
LINE = "^((?:[ \\t]*>)*)[ \\t]?(.*)$"
ATTRIBUTION = "(?i)^(on .{1,200} )?.{0,200}\\bwrote:\\s*$"


def quoted_lines(text: Column) -> Column:
    """Array of (level, body) for the lines of a text: how many `>` marks lead it, and what follows."""
    lines = F.split(F.coalesce(text, F.lit("")), "\\r?\\n", -1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, LINE, 1), "[^>]", "")).alias("level"),
            F.regexp_extract(x, LINE, 2).alias("body"),
        ),
    )


def own_text(lines: Column) -> Column:
    """The text without quoted lines and the attribution before them; blank lines left at the ends are cut."""
    kept = F.filter(
        lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0))
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), "^\\n+|\\n+$", "")


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), "\\s+", " "))


def _with_runs(rows: DataFrame) -> DataFrame:
    """Add `run`, one row for each passage: its level and where its lines start and stop. One column a step, each computed once."""
    outside = F.array(F.lit(-1))
    kind = F.transform("lines", lambda x: F.when(x["body"].rlike("\\S"), x["level"]).otherwise(F.lit(-1)))
    rows = rows.withColumn("_kind", F.concat(outside, kind, outside))  # line i is at i + 1
    pairs = F.zip_with(F.slice("_kind", F.lit(1), F.size("_kind") - 1), F.slice("_kind", F.lit(2), F.size("_kind") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumn("_pairs", pairs)
    changes = F.transform("_pairs", lambda e, i: F.when(e["a"] != e["b"], F.struct(i.alias("at"), e["b"].alias("level"))))
    rows = rows.withColumn("_changes", F.filter(changes, lambda c: c.isNotNull()))
    left = F.greatest(F.size("_changes") - 1, F.lit(0))  # from each change to the next the level is one
    runs = F.zip_with(
        F.slice("_changes", F.lit(1), left),
        F.slice("_changes", F.lit(2), left),
        lambda c, d: F.struct(c["level"].alias("level"), c["at"].alias("first"), d["at"].alias("stop")),
    )
    return rows.withColumn("run", F.explode(F.filter(runs, lambda r: r["level"] >= 0)))


def passages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, whole, hash, size): each distinct passage (`whole`) and each distinct non-blank line of a message by level.

    Level 0 is its own text. `size` is the length of the normalised text.
    """
    lines = messages.select(*keys, F.explode("lines").alias("line"))
    rows = lines.select(*keys, F.col("line.level").alias("level"), F.lit(False).alias("whole"), _normal(F.col("line.body")).alias("body"))
    runs = _with_runs(messages.select(*keys, "lines"))
    text = F.array_join(F.transform(F.slice("lines", F.col("run.first") + 1, F.col("run.stop") - F.col("run.first")), lambda x: x["body"]), " ")
    rows = rows.unionByName(runs.select(*keys, F.col("run.level").alias("level"), F.lit(True).alias("whole"), _normal(text).alias("body")))
    rows = rows.filter("body != ''")
    return rows.select(*keys, "level", "whole", F.xxhash64("whole", "body").alias("hash"), F.length("body").alias("size")).distinct()


def _latest_before(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(key, turn, origin) for each asked (key, turn): the latest offered turn of that key before it, or null."""
    offers = offered.select("key", "turn", F.col("turn").alias("own"), F.lit(False).alias("asked"))
    asks = asked.select("key", "turn", F.lit(None).alias("own"), F.lit(True).alias("asked"))
    points = offers.union(asks).groupBy("key", "turn").agg(F.max("own").alias("own"), F.max("asked").alias("asked"))
    points = points.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1 << 40)))
    past = (Window.unboundedPreceding, -1)
    inside = F.max("own").over(Window.partitionBy("key", "block").orderBy("turn").rowsBetween(*past))
    tops = points.groupBy("key", "block").agg(F.max("own").alias("top"))
    earlier = F.max("top").over(Window.partitionBy("key").orderBy("block").rowsBetween(*past))
    before = tops.select("key", "block", earlier.alias("earlier"))
    return (
        points.withColumn("inside", inside)
        .filter("asked")
        .join(before, ["key", "block"])
        .select("key", "turn", F.coalesce("inside", "earlier").alias("origin"))
    )


def _most_quoted(found: DataFrame) -> DataFrame:
    """(m, quoted_turn): the earlier turn of the conversation with most of the text quoted at level 1, the latest of equals.

    Every earlier turn that shares a passage or line counts. For a rare passage its turns are paired with the
    quoting ones. Common passages are matched as sets: turns with the same set of them score the same, so only
    the latest earlier turn of each set can win, and pairs are those of different sets.
    """
    weight = F.col("size") * F.when(F.col("whole"), F.lit(WHOLE)).otherwise(F.lit(1))
    pieces = found.filter("level <= 1").select("conv", "turn", "level", "key", weight.cast("long").alias("weight"))
    kinds = pieces.groupBy("key").agg(F.sum((F.col("level") == 0).cast("long")).alias("own"), F.max("level").alias("asked"))
    kinds = kinds.filter("own > 0 AND asked > 0").select("key", (F.col("own") > COMMON).alias("common"))
    pieces = staged(pieces.join(kinds, "key").distinct())
    own, asks = pieces.filter("level = 0"), pieces.filter("level = 1")
    rare = (
        asks.filter("NOT common").select("key", "conv", "turn", "weight")
        .join(own.filter("NOT common").select("key", F.col("turn").alias("origin")), "key")
        .filter("origin < turn").groupBy("conv", "turn", "origin").agg(F.sum("weight").alias("weight"))
    )
    # sets of common passages, written and asked
    held = {}
    for name, side in (("own", own), ("ask", asks)):
        sets = side.filter("common").groupBy("conv", "turn").agg(F.sort_array(F.collect_set(F.struct("key", "weight"))).alias("set"))
        held[name] = staged(sets.select("conv", "turn", F.xxhash64("conv", F.transform("set", lambda x: x["key"])).alias(name), "set"))
    members = {k: t.select(k, F.explode("set").alias("p")).distinct().select(k, "p.key", "p.weight") for k, t in held.items()}
    match = members["ask"].join(members["own"].drop("weight"), "key").groupBy("ask", "own").agg(F.sum("weight").alias("common"))
    match = staged(match)
    tried = held["ask"].select("conv", "turn", "ask").join(match, "ask").select("conv", "turn", "own", "common")
    latest = _latest_before(tried.select(F.col("own").alias("key"), "turn"), held["own"].select(F.col("own").alias("key"), "turn"))
    latest = latest.select(F.col("key").alias("own"), "turn", "origin")
    by_set = tried.join(latest, ["own", "turn"]).filter("origin IS NOT NULL").select("conv", "turn", "origin", F.col("common").alias("weight"))
    ask = held["ask"].select("conv", "turn", "ask")
    has = held["own"].select("conv", F.col("turn").alias("origin"), "own")
    both = rare.join(ask, ["conv", "turn"], "left").join(has, ["conv", "origin"], "left").join(match, ["ask", "own"], "left")
    both = both.select("conv", "turn", "origin", (F.col("weight") + F.coalesce("common", F.lit(0))).alias("weight"))
    best = both.unionByName(by_set).groupBy("conv", "turn").agg(F.max(F.struct("weight", "origin")).alias("best"))
    return best.select(F.col("conv"), "turn", F.col("best.origin").alias("quoted_turn"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, depth_quoted, n_quoted, n_linked, n_passages, n_passages_linked, body) of each message, in no order.

    `reply_to`: the earlier turn of the conversation that wrote most of the message's level-1 text itself (a character of a whole
    passage weighs `WHOLE` times one of a line), the latest of equals; without one, the turn before; null for the first.
    `n_quoted` and `n_linked` count distinct quoted lines, and those found in an earlier message at its level 0,
    `n_passages` and `n_passages_linked` passages. `body` is the text without quotes. Null texts are empty;
    null conv_ids form one conversation; messages with one (conv_id, turn) share their links; an empty table stays empty.
    """
    rows = messages.select(
        F.struct("conv_id", "turn").alias("m"), "conv_id", "turn", "role", quoted_lines(F.col("text")).alias("lines")
    )  # a struct is never null, so messages with a missing key join like others
    conversation = [F.col("m.conv_id"), F.coalesce(F.col("m.conv_id").cast("string"), F.lit("none"))]
    # one hash of conversation and line: a long conversation has many keys
    found = passages(rows, ["m"]).select(
        "m", "level", "whole", "size", F.xxhash64(*conversation).alias("conv"), F.xxhash64(*conversation, "hash").alias("key"), F.col("m.turn").alias("turn")
    )
    found = staged(found)
    quotes = found.filter("level > 0")
    origins = _latest_before(quotes, found.filter("level = 0"))
    same = (F.col("q.key") == F.col("o.key")) & F.col("q.turn").eqNullSafe(F.col("o.turn"))
    latest = quotes.alias("q").join(origins.alias("o"), same, "left").select("m", "level", "whole", "origin")
    line, whole = F.when(~F.col("whole"), F.lit(1)), F.when(F.col("whole"), F.lit(1))
    links = latest.groupBy("m").agg(
        F.max("level").alias("depth_quoted"),
        F.count(line).alias("n_quoted"),
        F.count(F.when(F.col("origin").isNotNull(), line)).alias("n_linked"),
        F.count(whole).alias("n_passages"),
        F.count(F.when(F.col("origin").isNotNull(), whole)).alias("n_passages_linked"),
    )
    quoted = _most_quoted(found)
    turns = rows.select("m").distinct().select("m", F.xxhash64(*conversation).alias("key"), F.col("m.turn").alias("turn"))
    before = _latest_before(turns, turns)
    same = (F.col("t.key") == F.col("b.key")) & F.col("t.turn").eqNullSafe(F.col("b.turn"))
    told = turns.alias("t").join(before.alias("b"), same).select("m", F.col("t.key").alias("conv"), F.col("t.turn").alias("turn"), F.col("origin").alias("turn_before"))
    told = told.join(quoted, ["conv", "turn"], "left").drop("conv", "turn").join(links, "m", "left")
    return rows.join(told, "m").select(
        "conv_id", "turn", "role",
        F.coalesce("quoted_turn", "turn_before").alias("reply_to"),
        F.coalesce("depth_quoted", F.lit(0)).alias("depth_quoted"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("n_passages_linked", F.lit(0)).cast("long").alias("n_passages_linked"),
        own_text(F.col("lines")).alias("body"),
    )


def chosen_turn(conv_id: Column, turn: Column) -> Column:
    """The turn that `as_replies` makes a turn quote: by a hash one of the `REACH` before it; null for the first.

    Turns 1 and 2 quote the turn before.
    """
    reach = F.when(turn > 2, F.least(turn, F.lit(REACH))).otherwise(F.lit(1))
    return F.when(turn > 0, turn - 1 - F.pmod(F.xxhash64(F.coalesce(conv_id.cast("string"), F.lit("none")), turn), reach))


def as_replies(conversations: DataFrame) -> DataFrame:
    """Conversations as mail: a turn quotes a whole earlier turn, below it the turn that one quotes, and so on to level `LEVELS`.

    The texts of the table hold no quotes, so the query derives them from the turns themselves. Which turn is quoted
    says `chosen_turn`; a turn that is missing is not quoted, nor is what it would quote. Of several messages with one number the greatest text is
    quoted. Rows meet on conversation and number, so a long conversation is spread.
    """
    texts = conversations.groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("said"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("_at"))
    quote = F.lit("")
    for level in range(1, LEVELS + 1):
        earlier = texts.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("said").alias(f"_said{level}"))
        rows = rows.withColumn("_at", chosen_turn(F.col("conv_id"), F.col("_at")))
        rows = rows.join(earlier, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_at") == F.col("_turn")), "left")
        rows = rows.withColumn("_at", F.col("_turn")).drop("_conv", "_turn")
        marks = "> " * level
        lines = F.concat(F.lit(marks), F.regexp_replace(f"_said{level}", "\n", "\n" + marks), F.lit("\n"))
        quote = F.concat(F.coalesce(lines, F.lit("")), quote)
    quote = F.when(F.col("_said1").isNotNull(), F.concat(F.lit("Someone wrote:\n"), quote, F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("conv_id", "turn", "role", F.concat(quote, "text").alias("text"))
