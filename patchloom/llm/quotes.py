"""Chat formatting by quotation linking, with DataFrame functions only.

A line with leading ``>`` marks quotes; their number is its level. Consecutive quoted lines of a level are one passage. Texts
are normalised (lower case, words only; each ideograph is a word) and hashed in units that do not depend on line breaks:
windows of five words, and whole lines, sentences and passages of fewer words. The original of a unit is the latest earlier
message of the conversation that has it unquoted. A quoted line is linked if units with an original hold all its words; its
original is that of most units that touch it, the latest of several. A message replies to the latest original of its level-1
lines, else of all its quoted lines. The result has one row per message: its text without quotes, its text with those quoted
lines that have no original (``kept_text``: outside sources, shell lines), what it replies to, and its place in reply order.
A line like 'X wrote:' goes with the quote after it, else it stays. Conversations sorted by (conv_id, thread, turn) are in
reply order: a thread starts with a message that replies to none, and replies follow what they quote. No conversation is
gathered in one task.

Null texts hold nothing; rows without conv_id or turn are kept and link with nothing. Repeated rows (equal in conv_id,
turn and text) are linked alike. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize

QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)"
#: The line that mail programs put before a quote (fixed values).
INTRODUCES = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
#: Words of a window; texts of fewer are met as whole lines, sentences and passages.
WIDTH = 5
SENTENCE_ENDS = r"\n|[.!?…]+(?=\s|$)|[。！？]"
MESSAGE = ("conv_id", "turn", "h")


def normalised(text: Column) -> Column:
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 "), " +", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), r"\r?\n")


def _keyed(rows: DataFrame, unit: Column, *columns: str | Column) -> DataFrame:
    """``columns`` with the key and check of each unit."""
    rows = rows.withColumn("unit", unit)
    return rows.select(*columns, F.xxhash64("unit").alias("key"), F.crc32(F.col("unit").cast("binary")).alias("check"))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, h (hash of the message), line, passage, level and words of each quoted line."""
    lines = messages.where(F.col("text").rlike("(?m)" + QUOTED)).select("conv_id", "turn", "text").distinct().select("conv_id", "turn", F.xxhash64("text").alias("h"), F.posexplode(_lines(F.col("text"))).alias("line", "body"))
    level = F.when(F.col("body").rlike(QUOTED), F.length(F.regexp_replace(F.regexp_extract("body", MARKS, 1), "[^>]", ""))).otherwise(0)
    in_order = Window.partitionBy(*MESSAGE).orderBy("line")
    lines = lines.withColumn("level", level).withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(in_order)).cast("int")).withColumn("passage", F.sum("new").over(in_order)).where("level > 0")
    return lines.withColumn("norm", normalised(F.regexp_replace("body", MARKS, ""))).select(*MESSAGE, "line", "passage", "level", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ")).alias("words"))


def quoted_units(lines: DataFrame) -> DataFrame:
    """conv_id, turn, h, key, check and cover (line and place of each word) of the units of the quoted lines."""
    short = _keyed(lines.where(F.size("words").between(1, WIDTH - 1)), F.concat_ws(" ", "words"), *MESSAGE, F.expr("transform(words, (x, i) -> struct(line, i AS at))").alias("cover"))
    words = lines.select(*MESSAGE, "passage", "line", F.posexplode("words").alias("at", "word"))
    in_passage = Window.partitionBy(*MESSAGE, "passage").orderBy("line", "at")
    ahead = [F.lead(F.struct("line", "at", "word"), i).over(in_passage).alias(f"w{i}") for i in range(WIDTH)]
    windows = words.select(*MESSAGE, F.lag("at").over(in_passage).isNull().alias("first"), *ahead).where(f"w{WIDTH - 1} IS NOT NULL OR first")
    names = [f"w{i}" for i in range(WIDTH)]
    cover = F.filter(F.array(*[F.struct(F.col(f"{w}.line").alias("line"), F.col(f"{w}.at").alias("at")) for w in names]), lambda x: x["line"].isNotNull())
    return short.unionByName(_keyed(windows, F.concat_ws(" ", *[F.col(f"{w}.word") for w in names]), *MESSAGE, cover.alias("cover")))


def originals(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, key, check and turn of the messages that have a wanted unit unquoted."""
    texts = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    # Quoted lines leave a mark, so that no window reaches over them.
    own = F.array_join(F.transform(_lines(F.col("text")), lambda x: F.when(x.rlike(QUOTED), F.lit("\0")).otherwise(x)), "\n")
    parts = texts.select("conv_id", "turn", F.explode(F.split(own, "\0")).alias("part"))
    few = rf"^[^ ]+(?: [^ ]+){{0,{WIDTH - 2}}}$"
    pieces = parts.select("conv_id", "turn", F.explode(F.concat(F.split("part", SENTENCE_ENDS), F.split("part", "\n"))).alias("piece")).select("conv_id", "turn", normalised(F.col("piece")).alias("unit")).where(F.col("unit").rlike(few))
    every = rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{WIDTH - 1}}}))"
    windows = parts.select("conv_id", "turn", F.explode(F.regexp_extract_all(normalised(F.col("part")), F.lit(every), F.lit(1))).alias("unit"))
    keyed = _keyed(pieces.unionByName(windows), F.col("unit"), "conv_id", "turn")
    return keyed.join(wanted.select("conv_id", "key", "check").distinct(), ["conv_id", "key", "check"], "left_semi").distinct()


def latest_originals(messages: DataFrame, units: DataFrame) -> DataFrame:
    """conv_id, turn, key, check and original of the units that an earlier message has."""
    wanted = units.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "key", "check").distinct()
    known = originals(messages, wanted).withColumn("has", F.col("turn"))
    both = known.unionByName(wanted.withColumn("has", F.lit(None).cast(known.schema["turn"].dataType)))
    before = Window.partitionBy("conv_id", "key", "check").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("original", F.max("has").over(before)).where("has IS NULL AND original IS NOT NULL").drop("has")


def linked_lines(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """The quoted lines with their original, or null, and whether the line goes (wordless ones: with their passage)."""
    units = materialize(quoted_units(lines), "units")
    cover = units.join(latest_originals(messages, units), ["conv_id", "turn", "key", "check"]).select(*MESSAGE, "original", F.explode("cover").alias("c")).select(*MESSAGE, "original", "c.line", "c.at")
    votes = cover.groupBy(*MESSAGE, "line", "original").agg(F.count("*").alias("votes")).groupBy(*MESSAGE, "line").agg(F.max(F.struct("votes", "original"))["original"].alias("original"))
    held = cover.groupBy(*MESSAGE, "line", "at").agg(F.lit(1).alias("one")).groupBy(*MESSAGE, "line").agg(F.count("*").alias("held"))
    found = lines.join(votes.join(held, [*MESSAGE, "line"]), [*MESSAGE, "line"], "left")
    found = found.withColumn("original", F.when(F.col("held") == F.size("words"), F.col("original"))).withColumn("n", F.size("words"))
    whole = F.min(F.when(F.col("n") > 0, F.col("original").isNotNull())).over(Window.partitionBy(*MESSAGE, "passage"))
    return found.select(*MESSAGE, "line", "level", "n", "original", F.when(F.col("n") > 0, F.col("original").isNotNull()).otherwise(F.coalesce(whole, F.lit(True))).alias("goes"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of each replying message, by following parents in doubling steps."""
    now = materialize(parents.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        on = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        if now.join(on, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left_semi").isEmpty():
            return now
        joined = now.join(on, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        now = materialize(joined.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def without(text: Column, goes: Column) -> Column:
    """The text without the lines whose numbers are in ``goes``, and without the lines that introduce them."""
    lines = _lines(text)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(goes, s["i"]) & ~(s["x"].rlike(INTRODUCES) & F.array_contains(goes, s["i"] + 1)))
    return F.trim(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))


def linked(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text without quotes, n_quoted and n_linked lines, levels, reply_to, thread, depth, kept_text."""
    messages = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    holds = F.coalesce(F.col("text").rlike("(?m)" + QUOTED), F.lit(False))
    quotes = materialize(quoted_lines(messages), "quotes")
    if quotes.isEmpty():
        found = None
    else:
        whole = materialize(linked_lines(messages, quotes), "linked")
        worded = F.col("n") > 0
        per_message = whole.groupBy(*MESSAGE).agg(
            F.count_if(worded).alias("n_quoted"), F.count("original").alias("n_linked"), F.max(F.when(worded, F.col("level"))).alias("levels"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("original"))), F.max("original")).alias("reply_to"),
            F.collect_list("line").alias("quoted"), F.collect_list(F.when(F.col("goes"), F.col("line"))).alias("goes")
        )
        per_message = materialize(per_message, "replies")
        roots = threads(per_message.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to")))
        found = per_message.join(roots, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("h").alias("g"), "n_quoted", "n_linked", "levels", "reply_to", "thread", "depth", "quoted", "goes")
    zero = F.lit(0).cast("long")
    plain = messages if found is None else messages.where(~holds)
    trimmed = F.trim(F.coalesce("text", F.lit("")))
    out = plain.select("conv_id", "turn", "role", trimmed.alias("text"), zero.alias("n_quoted"), zero.alias("n_linked"), zero.cast("int").alias("levels"), F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("thread"), zero.alias("depth"), trimmed.alias("kept_text"))
    if found is None:
        return out
    replies = messages.where(holds).join(found, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.xxhash64("text") == F.col("g")), "left")
    return out.unionByName(replies.select("conv_id", "turn", "role", without(F.col("text"), F.col("quoted")).alias("text"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("levels", zero.cast("int")).alias("levels"), F.col("reply_to").cast("long").alias("reply_to"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"), without(F.col("text"), F.col("goes")).alias("kept_text")))
