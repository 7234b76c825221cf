"""Chat formatting: quoted passages are linked to the messages they quote, and conversations built without quotes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, table, written
from .components import component_roots

# Lines that announce a quotation, as mail and forum programs write them.
INTRODUCTION = r"(?:on .{1,200} wrote:|am .{1,200} schrieb.{0,100}:|le .{1,200} a écrit\s?:|el .{1,200} escribió:|-{2,} ?original message ?-{2,})"
MARKS = r"^(?:\s{0,3}>)+ ?"
#: Normalised characters that a passage needs to stand for a message of another conversation; within a conversation any will do.
LEAST = 12
#: What ends a sentence, and a mark before each line of a text (a character for private use, which texts lose).
SENTENCES, MARK = r"(?<=[.!?。！？])\s+|\n\s*\n", "\ue000"
#: Turns of one conversation are parted into stretches of so many, so that a long one is spread out.
STRETCH = 64


def normalised(text: Column) -> Column:
    """What quotations keep of a passage, however it is wrapped: letters and digits in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of (level, body, raw): the number of quote marks before each line, the line without them, and as it stands."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"), x.alias("raw")))


def with_runs(rows: DataFrame, items: str, name: str, key: Callable[[Column], Column]) -> DataFrame:
    """rows with a column that parts an array into runs of neighbours with equal keys."""
    at, starts = F.col(items), F.col("__starts")
    opens = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (key(F.get(at, i)) != key(F.get(at, i - 1))))
    rows = rows.withColumn("__starts", opens)
    return rows.withColumn(name, F.transform(starts, lambda s, k: F.slice(at, s + 1, F.coalesce(F.get(starts, k + 1), F.size(at)) - s))).drop("__starts")


def _says(line: Column) -> Column:
    """Whether a line is more than the announcement of a quotation."""
    return ~line["body"].rlike(rf"(?i)^\s*{INTRODUCTION}\s*$")


def _joined(lines: Column, field: str) -> Column:
    return F.array_join(F.transform(lines, lambda x: x[field]), "\n")


def _units(rows: DataFrame, body: Column) -> DataFrame:
    """rows with digest, n and whole: a row for the passage, and for each of its sentences and lines, by the hash of its normal form."""
    sentences, lines = F.split(body, SENTENCES), F.split(body, "\n")
    parts = F.transform(F.concat(sentences, lines), lambda x: F.struct(F.lit(False).alias("whole"), normalised(x).alias("norm")))
    units = F.array_distinct(F.concat(F.array(F.struct(F.lit(True).alias("whole"), normalised(body).alias("norm"))), parts))
    units = rows.withColumn("unit", F.explode(F.filter(units, lambda x: x["norm"] != ""))).withColumn("digest", F.md5(F.col("unit.norm")))
    return units.select(*rows.columns, "digest", F.length("unit.norm").alias("n"), F.col("unit.whole").alias("whole"))


def message_blocks(messages: DataFrame) -> DataFrame:
    """messages with key, a hash of the text, and blocks: the lines in runs that are quoted and runs that are not."""
    rows = messages.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("lines", parsed_lines(F.col("text")))
    return with_runs(rows, "lines", "blocks", lambda x: x["level"] > 0)


def _without_introduction(body: Column) -> Column:
    """The body without announcing lines at its end."""
    return F.regexp_replace(body, rf"(?i)(?:^|\n)[^\S\n]*{INTRODUCTION}\s*\z", "")


def own_passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n, whole): all that a message says itself, block by block and in all."""
    blocks = rows.select("conv_id", "turn", F.explode("blocks").alias("block")).filter(F.col("block")[0]["level"] == 0)
    alone = blocks.select("conv_id", "turn", _without_introduction(_joined(F.col("block"), "body")).alias("body"))
    own = F.filter("lines", lambda x: (x["level"] == 0) & _says(x))
    in_all = rows.filter(F.size("blocks") > 1).select("conv_id", "turn", _joined(own, "body").alias("body"))
    return _units(alone.unionByName(in_all), F.col("body")).drop("body").distinct()


def quoted_runs(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, key, block, place, level, run): the lines of each run of one quote level, in order of place."""
    blocks = rows.select("conv_id", "turn", "key", F.posexplode("blocks").alias("block", "quoted")).filter(F.col("quoted")[0]["level"] > 0)
    runs = with_runs(blocks, "quoted", "runs", lambda x: x["level"]).select("conv_id", "turn", "key", "block", F.posexplode("runs").alias("place", "run"))
    return runs.select("conv_id", "turn", "key", "block", "place", F.col("run")[0]["level"].alias("level"), "run")


def quoted_passages(runs: DataFrame) -> DataFrame:
    """(conv_id, turn, key, block, level, digest, n, whole): each run of lines of one quote level, whole and in parts."""
    bodies = runs.select("conv_id", "turn", "key", "block", "level", _joined(F.filter("run", _says), "body").alias("body"))
    return _units(bodies, F.col("body")).drop("body").distinct()


def kept_lines(runs: DataFrame, linked: DataFrame) -> DataFrame:
    """(conv_id, turn, key, parts) for messages with links: parts, an array of (block, place, lost, says, kept), has of each run the lines that stay.

    linked: (conv_id, turn, key, block, level, digest). A line goes if its whole run links, or the line itself, or all
    sentences that it holds a part of, however they are wrapped. Lines without words and announcing lines go with
    any line of their run, runs of nothing else with any of their block. Lines are marked in the run's text, linked sentences are taken out, and a line is gone if
    nothing is left behind its mark.
    """
    keys = ["conv_id", "turn", "key"]
    digests = linked.groupBy(*keys, "block", "level").agg(F.collect_set("digest").alias("digests"))
    rows = runs.join(linked.select(*keys).distinct(), keys, "left_semi").join(digests, [*keys, "block", "level"], "left").dropDuplicates([*keys, "block", "place"])
    known = lambda text: F.array_contains("digests", F.md5(normalised(text)))
    bare = lambda x: F.translate(x["body"], MARK, "")
    empty = lambda x: normalised(x["body"]) == ""
    said = F.filter("run", _says)
    marked = F.array_join(F.transform(said, lambda x: F.when(empty(x), bare(x)).otherwise(F.concat(F.lit(MARK), bare(x)))), "\n")
    left = F.transform(F.split(marked, SENTENCES), lambda p: F.when(known(p), F.regexp_replace(p, f"[^{MARK}]", "")).otherwise(p))
    rows = rows.withColumn("left", F.slice(F.split(F.array_join(left, " "), MARK), 2, F.greatest(F.lit(1), F.size("run"))))
    rows = rows.withColumn("all", known(_joined(said, "body"))).withColumn("full", F.filter(said, lambda x: ~empty(x)))
    gone = F.transform("full", lambda x, k: F.col("all") | known(x["body"]) | (normalised(F.coalesce(F.get("left", k), F.lit("x"))) == ""))
    rows = rows.withColumn("gone", F.when(F.col("digests").isNotNull(), gone))
    rows = rows.withColumn("lost", F.coalesce(F.exists("gone", lambda g: g), F.lit(False)))
    stays = F.transform(F.filter(F.arrays_zip(F.col("full").alias("line"), F.col("gone").alias("out")), lambda z: ~z["out"]), lambda z: z["line"]["raw"])
    kept = F.when(F.col("lost"), stays).otherwise(F.transform("run", lambda x: x["raw"]))
    part = F.struct("block", "place", "lost", (F.size("full") > 0).alias("says"), F.when(F.size(kept) > 0, F.array_join(kept, "\n")).alias("kept"))
    return rows.select(*keys, part.alias("part")).groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts"))


def _nearest(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted with near: the last earlier turn of the conversation that says the same. Stretches of turns are searched
    apart, then joined at their ends, so that one passage in many turns is no single task's work."""
    kind = own.schema["turn"].dataType
    both = own.select("conv_id", "digest", "turn", F.col("turn").alias("origin")).distinct().unionByName(quoted.select("conv_id", "digest", "turn", F.lit(None).cast(kind).alias("origin")).distinct())
    both = both.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    ends = both.groupBy("conv_id", "digest", "stretch").agg(F.max("origin").alias("end"))
    before = Window.partitionBy("conv_id", "digest").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.max("end").over(before)).drop("end")
    # At one turn the quotation comes before what the message says itself, so a message never quotes itself.
    here = Window.partitionBy("conv_id", "digest", "stretch").orderBy("turn", F.col("origin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("here", F.max("origin").over(here)).filter("origin is null").join(ends, ["conv_id", "digest", "stretch"])
    found = found.select("conv_id", "digest", "turn", F.coalesce(F.when(F.col("here") < F.col("turn"), F.col("here")), "before").alias("near"))
    return quoted.join(found, ["conv_id", "digest", "turn"])


def quote_links(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, key, block, level, digest, to_conv, to_turn, n) for each quoted passage that is known: what it quotes.

    A passage, sentence or line stands for the last earlier message of its conversation that says it; if there is
    none, for the first message of an earlier conversation (one of smaller conv_id, which is taken as the order in
    which conversations began), if no other conversation says it and it has LEAST characters: what several say shows no
    origin. Sentences and lines of fewer characters count in no case unless they are the whole passage. What
    nobody quotes is dropped first, so common sentences make no pairs.
    """
    quoted = quoted.filter((F.col("n") >= LEAST) | F.col("whole")).groupBy("conv_id", "turn", "key", "block", "level", "digest").agg(F.max("n").alias("n"))
    own = written(own.join(quoted.select("digest").distinct(), "digest", "left_semi").select("conv_id", "turn", "digest"), "own")
    near = _nearest(own, quoted)
    first = own.groupBy("digest").agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.max("conv_id").alias("last_conv"), F.count("*").alias("says"))
    found = attach(near, first.select("digest", "first", "last_conv", "says"), ["digest"], "says", own.count())
    elsewhere = (F.col("first.conv_id") == F.col("last_conv")) & (F.col("first.conv_id") < F.col("conv_id")) & (F.col("n") >= LEAST)
    to_conv = F.when(F.col("near").isNotNull(), F.col("conv_id")).when(elsewhere, F.col("first.conv_id"))
    to_turn = F.when(F.col("near").isNotNull(), F.col("near")).when(elsewhere, F.col("first.turn"))
    return found.select("conv_id", "turn", "key", "block", "level", "digest", to_conv.alias("to_conv"), to_turn.alias("to_turn"), "n").filter("to_conv is not null")


def previous_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, previous) for each distinct turn; stretches of turns are ordered apart, then joined at their ends."""
    turns = messages.select("conv_id", "turn").distinct().withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    ends = turns.groupBy("conv_id", "stretch").agg(F.max("turn").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(Window.partitionBy("conv_id").orderBy("stretch"))).drop("end")
    within = F.lag("turn").over(Window.partitionBy("conv_id", "stretch").orderBy("turn"))
    return turns.join(ends, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce(within, "before").alias("previous"))


def _unquoted(text: Column, blocks: Column, parts: Column) -> Column:
    """The text with what is kept of quoted blocks, and without the lines that announce blocks which lost something."""
    of = lambda i: F.filter(parts, lambda p: p["block"] == i)
    lost = lambda i: F.exists(of(i), lambda p: p["lost"])
    quoted = lambda i: F.array_join(F.transform(F.filter(of(i), lambda p: p["kept"].isNotNull() & (p["says"] | ~lost(i))), lambda p: p["kept"]), "\n")
    shown = F.transform(blocks, lambda b, i: F.when(b[0]["level"] > 0, F.nullif(quoted(i), F.lit(""))).when(lost(i + 1), _without_introduction(_joined(b, "raw"))).otherwise(_joined(b, "raw")))
    bare = F.regexp_replace(F.array_join(shown, "\n"), r"\n{3,}", "\n\n")
    return F.when(parts.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.regexp_replace(bare, r"^\s+|\s+$", ""))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """messages without the quoted lines that are linked, each with what it replies to, in columns whose order is the reply order.

    Columns: thread_id, conv_id, turn, role, text (without linked lines; quoted lines of which nothing is known stay),
    reply_conv and reply_turn (the message of which its first quote level has most, the later one of equals, else the
    turn before it), linked_by ('quote', 'turn' or null for a first turn), quoted_lines, linked_levels, ancestors
    (array of (level, conv_id, turn) for deeper levels), then all other columns of messages. Conversations that quote
    one another have one thread_id, the least conv_id of them. Within a thread the order of conv_id and turn
    puts every message after what it replies to, and rows stay rows: no thread is gathered into one.

    Null text counts as empty; a row with a null turn or conv_id links with nothing and stays as it is; repeated rows
    stay, with equal links; an empty table gives no rows. Other columns that have one of these names, in any case, are left out.
    """
    made = ["thread_id", "conv_id", "turn", "role", "text", "reply_conv", "reply_turn", "linked_by", "quoted_lines", "linked_levels", "ancestors", "key", "lines", "blocks"]
    extra = [c for c in messages.columns if c.lower() not in made]
    columns = [*["conv_id", "turn", "role", "text"], *extra]
    rows = message_blocks(messages.select(columns))
    known = rows.filter("conv_id is not null and turn is not null")
    runs = quoted_runs(known.filter("exists(blocks, b -> b[0].level > 0)"))
    quoted = written(quoted_passages(runs), "quoted")
    links = written(quote_links(own_passages(known), quoted), "links")
    across = links.filter("to_conv <> conv_id").select(F.col("conv_id").alias("x"), F.col("to_conv").alias("y")).distinct()
    threads = component_roots(across).toDF("c", "thread_id")
    votes = links.groupBy("conv_id", "turn", "key", "level", "to_conv", "to_turn").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn", "key", "level").agg(F.max(F.struct("n", "to_conv", "to_turn")).alias("best"))
    deeper = F.when(F.col("level") > 1, F.struct("level", F.col("best.to_conv").alias("conv_id"), F.col("best.to_turn").alias("turn")))
    by_message = best.groupBy("conv_id", "turn", "key").agg(
        F.max(F.when(F.col("level") == 1, F.col("best"))).alias("quoted"),
        F.count("*").alias("linked_levels"),
        F.sort_array(F.collect_list(deeper)).alias("ancestors"),
    )
    by_message = by_message.join(kept_lines(runs, links), ["conv_id", "turn", "key"], "left")
    found = ["previous", "quoted", "linked_levels", "ancestors", "parts"]
    before = previous_turns(known.select("conv_id", "turn"))
    linked = known.join(before, ["conv_id", "turn"]).join(by_message, ["conv_id", "turn", "key"], "left").join(threads, F.col("conv_id") == F.col("c"), "left")
    kinds = dict(linked.dtypes)
    rest = rows.filter("conv_id is null or turn is null").withColumns({c: F.lit(None).cast(kinds[c]) for c in [*found, "thread_id"]})
    joined = linked.select(*rows.columns, *found, "thread_id").unionByName(rest)
    return joined.select(
        F.coalesce("thread_id", "conv_id").alias("thread_id"),
        "conv_id",
        "turn",
        "role",
        _unquoted(F.col("text"), F.col("blocks"), F.col("parts")).alias("text"),
        F.when(F.col("quoted").isNotNull(), F.col("quoted.to_conv")).when(F.col("previous").isNotNull(), F.col("conv_id")).alias("reply_conv"),
        F.coalesce("quoted.to_turn", "previous").alias("reply_turn"),
        F.when(F.col("quoted").isNotNull(), "quote").when(F.col("previous").isNotNull(), "turn").alias("linked_by"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("quoted_lines"),
        F.coalesce("linked_levels", F.lit(0)).alias("linked_levels"),
        F.coalesce("ancestors", F.array().cast(kinds["ancestors"])).alias("ancestors"),
        *extra,
    )


def op3_chats(spark, sf_dir: str) -> DataFrame:
    return linked_conversations(table(spark, sf_dir, "conversations"))
