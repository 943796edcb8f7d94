"""Reply-ordered conversations from quotations.

1. Lines are parsed into quote levels (leading ``>`` marks, blanks between them allowed); the lines
   of level 0 are the message's own text. A line such as "... wrote:" just before a quotation goes with it.
2. Each quoted passage, a line with case and white space normalised, is hashed and joined with messages' own
   lines: first the latest earlier message of the conversation that has it; passages of
   ``FAR_WORDS`` words or more that the conversation lacks are looked up in all conversations, where the
   first message (by conversation and turn) with it counts.
3. A block of neighbouring lines of one level links to the message that most of its words came from; a
   message answers the source of its longest level-1 block in the conversation, or else the message before it.
4. A message that answers by quotation opens a branch; those after it without quotations continue it. Conversations
   are put in the order (message answered by the branch, begin of the branch, turn), in which every
   message follows the one it answers.

A conversation or a passage may hold a third of all rows: the latest earlier message is a running maximum over blocks
of turns, and positions are numbered over blocks as well, so no window holds a whole conversation. Only own lines
that are quoted somewhere are shuffled, and each passage is one row when it is looked up over all conversations.

Cases: a null text is empty; rows without ``conv_id`` or ``turn`` are returned without links and position;
repeated rows and several rows of one turn share links and position, and all their lines count as that turn's;
an empty passage links to nothing; of equally good sources the earliest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from framekiln.operators.numbering import running_max, with_ordinal
from framekiln.session import written

FAR_WORDS = 5
_MARKS = r"^[ \t]*((?:>[ \t]*)+)"
# How mail programs introduce a quotation.
_INTRODUCED = r"(wrote|writes|said|schrieb|écrit|escribió) ?:[ \t]*$"


def parsed(messages: DataFrame) -> DataFrame:
    """Add ``lines``: (at, level, content) of each line, and ``own``: the text without quotations."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n")

    def line(x, i):
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(i.alias("at"), level.alias("level"), F.regexp_replace(x, _MARKS, "").alias("content"))

    with_lines = messages.withColumn("lines", F.transform(lines, line))

    def own(x):
        following = F.get(F.col("lines"), x["at"] + 1)["level"]
        introduces = (F.coalesce(following, F.lit(0)) > 0) & x["content"].rlike(_INTRODUCED)
        return (x["level"] == 0) & ~introduces

    kept = F.transform(F.filter("lines", own), lambda x: x["content"])
    return with_lines.withColumn("own", F.array_join(kept, "\n"))


def _passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, words, hash) of every line with a word."""
    each = rows.select("conv_id", "turn", F.explode("lines").alias("line")).select("conv_id", "turn", "line.*")
    plain = F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))
    each = each.withColumn("plain", plain).filter("plain != ''")
    return each.select("conv_id", "turn", "at", "level", F.size(F.split("plain", " ")).alias("words"), F.xxhash64("plain").alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, block, words, source_conv, source_turn): each quoted block and its source.

    Sources are null for blocks that no message explains.
    """
    rows = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    passages = _passages(rows)
    quoted = written(passages.filter("level > 0").distinct(), "quotations-quoted")
    sought = quoted.select("hash").distinct()
    own = passages.filter("level = 0").select("conv_id", "turn", "hash").join(sought, "hash", "left_semi").distinct()
    own = written(own, "quotations-own")

    # The latest earlier turn that has a passage: own lines stand just after quotations of the same turn.
    place = F.col("turn").cast("long") * 2
    events = own.select("conv_id", "hash", (place + 1).alias("place"), F.col("turn").cast("long").alias("value"))
    asked = quoted.select("conv_id", "hash", place.alias("place"), F.lit(None).cast("long").alias("value")).distinct()
    last = running_max(events.union(asked), "value", "place", ["conv_id", "hash"], "source_turn").filter("value IS NULL AND source_turn IS NOT NULL")
    near = last.select("conv_id", "hash", (F.col("place") / 2).cast("long").alias("turn"), "source_turn")
    first = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("far"))

    found = quoted.withColumn("turn", F.col("turn").cast("long")).join(near, ["conv_id", "hash", "turn"], "left").join(first, "hash", "left")
    here = F.col("source_turn").isNotNull()
    other = ~here & (F.col("words") >= FAR_WORDS) & ((F.col("far.conv_id") != F.col("conv_id")))
    found = found.select(
        "conv_id",
        "turn",
        "level",
        "at",
        "words",
        F.when(here, F.col("conv_id")).when(other, F.col("far.conv_id")).alias("source_conv"),
        F.when(here, F.col("source_turn")).when(other, F.col("far.turn").cast("long")).alias("source_turn"),
    )
    # Neighbouring lines of one level keep the difference between their place and their rank.
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn", "level").orderBy("at"))
    found = found.withColumn("block", F.col("at") - rank)
    votes = found.groupBy("conv_id", "turn", "level", "block", "source_conv", "source_turn").agg(F.sum("words").alias("w"), F.min("at").alias("at"))
    ranked = F.struct(F.col("source_turn").isNotNull().alias("is"), F.col("w").alias("w"), (-F.col("source_turn")).alias("t"), F.col("source_conv").alias("c"))
    best = votes.groupBy("conv_id", "turn", "level", "block").agg(F.max(ranked).alias("best"), F.sum("w").alias("words"), F.min("at").alias("at"))
    return best.select("conv_id", "turn", "level", F.col("at").alias("block"), "words", F.col("best.c").alias("source_conv"), (-F.col("best.t")).alias("source_turn"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, position, reply_turn, branch, n_quotes, n_linked and the text without quotations."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text"))
    found = written(links(rows), "quotations-links")
    counts = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source_turn").alias("n_linked"))
    direct = found.filter("level = 1 AND source_conv = conv_id").groupBy("conv_id", "turn").agg(
        F.max(F.struct("words", (-F.col("source_turn")).alias("t"))).alias("best")
    )
    quotes = counts.join(direct.select("conv_id", "turn", (-F.col("best.t")).alias("quoted")), ["conv_id", "turn"], "left")

    turns = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    placed = written(with_ordinal(turns, ["turn"], ["conv_id"], "place"), "quotations-turns")
    before = placed.select("conv_id", (F.col("place") + 1).alias("place"), F.col("turn").alias("previous"))
    known = placed.join(before, ["conv_id", "place"], "left").join(quotes, ["conv_id", "turn"], "left")
    opens = F.when(F.col("quoted").isNotNull() | (F.col("place") == 0), F.col("turn"))
    known = written(known.withColumn("opens", opens), "quotations-replies")
    branched = running_max(known, "opens", "turn", ["conv_id"], "branch")
    bases = known.filter("opens IS NOT NULL").select("conv_id", F.col("turn").alias("branch"), F.coalesce(F.col("quoted"), F.lit(-(1 << 62))).alias("base"))
    ordered = with_ordinal(branched.join(bases, ["conv_id", "branch"]), ["base", "branch", "turn"], ["conv_id"], "position")
    ordered = written(
        ordered.select("conv_id", "turn", "position", F.coalesce("quoted", "previous").alias("reply_turn"), "branch", "n_quotes", "n_linked"),
        "quotations-order",
    )
    ordered = ordered.withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    texts = rows.select("conv_id", "turn", "role", F.col("own").alias("text"))
    joined = texts.join(ordered, (texts["conv_id"] == ordered["__conv"]) & (texts["turn"] == ordered["__turn"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("position").cast("long").alias("position"),
        "reply_turn",
        "branch",
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        "text",
    )
