"""Linking of quoted passages to the messages they come from.

Lines that begin with ``>`` are quotes, one level for each mark.  Successive
lines of one level are a passage.  Passages are normalised (case, punctuation
and white space) and hashed; so are all unquoted bodies, passages, paragraphs
and lines, of which the earliest holder per hash is kept.  A passage that no
message holds as a whole is looked for by its paragraphs and lines.  A quoting
message answers the message that its first linked outer passage comes from, other
messages answer the one before in their conversation.  Messages are put in
reply order by their depth below the first message.

Chains of plain replies are one node each, so depths are found by doubling over
the quoting messages alone.  All orders are running counts over ranges, so one
conversation may hold any share of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import running_total
from ..sources.workspace import keep

# A quote mark with an optional blank, as often as a line is quoted.
_MARKS = r"^((?:[ \t]*>)*)"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def unmarked(line: Column) -> Column:
    """A line without its quote marks and the blank after them."""
    return F.when(quote_level(line) > 0, F.regexp_replace(line, _MARKS + "[ \t]?", "")).otherwise(line)


def normalised(text: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_passages(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``passages``, array<struct<level, body>>: runs of lines of one quote level, without their marks.

    Each step is a column of its own, so that it is computed once per message.
    """
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n")
    marked = F.transform(lines, lambda x: F.struct(quote_level(x).alias("level"), unmarked(x).alias("body")))
    line = F.col("_lines")
    numbered = F.sequence(F.lit(0), F.size(line) - 1)
    starts = F.filter(numbered, lambda k: (k == 0) | (F.get(line, k)["level"] != F.get(line, k - 1)["level"]))
    passages = F.transform(
        F.col("_starts"),
        lambda s, k: F.struct(
            F.get(line, s)["level"].alias("level"),
            F.array_join(
                F.slice(line, s + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size(line)) - s)["body"], "\n"
            ).alias("body"),
        ),
    )
    split = rows.withColumn("_lines", marked).withColumn("_starts", starts)
    return split.withColumn("passages", passages).drop("_lines", "_starts")


def _parts(body: Column) -> Column:
    """Paragraphs and lines."""
    return F.concat(F.split(body, r"\n[ \t]*\n"), F.split(body, "\n"))


def _units(texts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(texts, lambda x: normalised(x)), lambda x: x != ""))


def link_quotes(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every message without quotes, in reply order, with the message that it answers.

    Columns: the four given ones (the text without quoted lines), ``place``
    (number within its conversation from 0), ``n_quotes`` and ``n_linked``
    passages, ``parent_conversation`` and ``parent_place``, ``by_quote``,
    ``thread`` (conversation of the first message), ``depth`` and ``reply_order``
    within the thread from 0.

    A quote is looked for in earlier messages of its conversation first, then in
    those of conversations with smaller ids.  Where the whole passage has no
    holder, its longest paragraph or line with one decides, in the same order of
    places; of equal ones the earliest holder.  Ties in ``turn`` are ordered by
    role and text.  A message with a null conversation is a thread of its own
    conversation "null"; a null text counts as empty.
    """
    names = {conversation: "conv", turn: "turn", role: "role", text: "text"}
    rows = messages.select(*(F.col(f"`{k}`").alias(v) for k, v in names.items()))
    kind = rows.schema["conv"].dataType
    rows = rows.withColumn("own", F.col("conv")).withColumn("conv", F.coalesce(F.col("conv").cast("long"), F.lit(-(1 << 62))))
    rows = rows.withColumns({"digest": F.xxhash64("text"), "one": F.lit(1).cast("long")})
    placed = running_total(rows, ["conv"], ["turn", "role", "digest"], "one", "place").withColumn("place", F.col("place") - 1)
    parsed = keep(with_passages(placed.drop("one", "digest")))

    body = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    plain = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"])
    units = _units(F.concat(F.array(body), plain, _parts(body)))
    quotes = F.filter(
        F.transform("passages", lambda p, k: F.struct(
            p["level"].alias("level"), k.alias("number"), p["body"].alias("raw"), normalised(p["body"]).alias("body")
        )),
        lambda p: (p["level"] > 0) & (p["body"] != ""),
    )
    quoted = keep(
        parsed.select("conv", "place", F.explode(quotes).alias("q"))
        .select("conv", "place", "q.level", "q.number", "q.raw", F.sha2("q.body", 256).alias("hash"))
    )
    n_quotes = quoted.count()
    if n_quotes:
        linked = _linked(keep(_with_source(quoted, parsed, units)), parsed, units)
    else:
        linked = quoted.withColumn("source", F.struct("conv", "place"))
    links = keep(
        linked.groupBy("conv", "place").agg(
            F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"),
            F.min_by("source", F.when(F.col("source").isNotNull(), F.struct("level", "number"))).alias("source"),
        )
    )
    with_links = parsed.join(links, ["conv", "place"], "left").withColumn(
        "starts", F.coalesce(F.when(F.col("source").isNotNull(), 1), F.lit(0)).cast("long")
    )
    # A quoting message starts a new chain; the messages after it follow it.
    chained = keep(running_total(with_links, ["conv"], ["place"], "starts", "chain"))
    depths = _depths(chained)
    deep = chained.join(depths, ["conv", "chain"]).withColumn("depth", F.col("base") + F.col("place") - F.col("first"))
    ordered = running_total(
        deep.withColumn("one", F.lit(1).cast("long")), ["thread"], ["depth", "conv", "place"], "one", "reply_order"
    )
    by_quote = F.col("source").isNotNull()
    before = F.struct(F.col("conv"), (F.col("place") - 1).alias("place"))
    parent = F.when(by_quote, F.col("source")).when(F.col("place") > 0, before)
    shown = lambda c: F.when(c != -(1 << 62), c).cast(kind)
    return ordered.select(
        F.col("own").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role),
        F.trim(F.regexp_replace(body, r"\n{3,}", "\n\n")).alias(text),
        "place", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        shown(parent["conv"]).alias("parent_conversation"), parent["place"].alias("parent_place"), by_quote.alias("by_quote"),
        shown(F.col("thread")).alias("thread"), "depth", (F.col("reply_order") - 1).alias("reply_order"),
    )


def _with_source(quoted: DataFrame, parsed: DataFrame, units: Column) -> DataFrame:
    """Adds ``source``: the earliest holder of the hash in the own conversation, or else in one with a smaller id."""
    held = parsed.select("conv", "place", F.explode(F.transform(units, lambda x: F.sha2(x, 256))).alias("hash"))
    held = held.join(quoted.select("hash").distinct(), "hash", "left_semi")
    near = keep(held.groupBy("hash", "conv").agg(F.min("place").alias("near")))
    far = near.groupBy("hash").agg(F.min(F.struct("conv", F.col("near").alias("place"))).alias("far"))
    found = quoted.join(near, ["hash", "conv"], "left").join(far, "hash", "left")
    source = F.when(F.col("near") < F.col("place"), F.struct(F.col("conv"), F.col("near").alias("place"))).when(
        F.col("far.conv") < F.col("conv"), F.col("far")
    )
    return found.withColumn("source", source).drop("near", "far")


def _linked(whole: DataFrame, parsed: DataFrame, units: Column) -> DataFrame:
    """Passages whose whole has no source get that of their paragraphs and lines."""
    others = F.filter(_units(_parts(F.col("raw"))), lambda x: x != normalised(F.col("raw")))
    parts = keep(
        whole.filter("source is null").select("conv", "place", "number", F.explode(others).alias("part"))
        .select("conv", "place", "number", F.length("part").alias("size"), F.sha2("part", 256).alias("hash"))
    )
    if parts.isEmpty():
        return whole
    order = F.struct(F.col("source.conv") != F.col("conv"), -F.col("size"), F.col("source"))
    of_parts = (
        _with_source(parts, parsed, units).filter("source is not null")
        .groupBy("conv", "place", "number").agg(F.min_by("source", order).alias("part_source"))
    )
    return whole.join(of_parts, ["conv", "place", "number"], "left").withColumn("source", F.coalesce("source", "part_source"))


def _depths(chained: DataFrame) -> DataFrame:
    """(conv, chain, first, thread, base): a chain's first place, its thread, and the depth of its first message."""
    chains = keep(
        chained.groupBy("conv", "chain").agg(
            F.min("place").alias("first"), F.max(F.when(F.col("starts") == 1, F.col("source"))).alias("source")
        )
    )
    quoting = chains.filter("source is not null").select("conv", "chain", "source.conv", "source.place").toDF(
        "conv", "chain", "to_conv", "to_place"
    )
    where = chained.select("conv", "place", "chain").toDF("to_conv", "to_place", "to_chain")
    firsts = chains.select("conv", "chain", "first").toDF("to_conv", "to_chain", "to_first")
    # Each quoting chain points to an earlier chain, so many levels up.
    up = keep(
        quoting.join(where, ["to_conv", "to_place"]).join(firsts, ["to_conv", "to_chain"])
        .select("conv", "chain", "to_conv", "to_chain", (F.col("to_place") - F.col("to_first") + 1).alias("levels"))
    )
    while not up.filter("to_chain > 0").isEmpty():
        further = up.toDF("to_conv", "to_chain", "up_conv", "up_chain", "up_levels")
        up = keep(
            up.join(further, ["to_conv", "to_chain"], "left").select(
                "conv", "chain", F.coalesce("up_conv", "to_conv").alias("to_conv"),
                F.when(F.col("up_conv").isNotNull(), F.col("up_chain")).otherwise(F.col("to_chain")).alias("to_chain"),
                (F.col("levels") + F.coalesce("up_levels", F.lit(0))).alias("levels"),
            )
        )
    found = up.select("conv", "chain", F.col("to_conv").alias("thread"), F.col("levels").alias("base"))
    return chains.select("conv", "chain", "first").join(found, ["conv", "chain"], "left").select(
        "conv", "chain", "first", F.coalesce("thread", "conv").alias("thread"), F.coalesce("base", "first").alias("base")
    )
