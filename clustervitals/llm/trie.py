"""Prefix trie of conversations, by collapsing whole sequences first.

1. A turn is a digest of role and text with its number of words; from here on no text moves.  A conversation's
   key is the sum of digests of (place, turn), in four words of 32 bits, with its length: equal conversations have
   equal keys, and the running sum up to a place is the key of that prefix.
2. Identical conversations become one weighted sequence with its smallest member and the digest of its members.
3. Every sequence gives its prefixes with its weight; equal prefixes add up to nodes.  A sequence that is an inner
   node is a proper prefix of another one; the rest, found by anti-join, are the leaves.
4. A node belongs to the sequence of its smallest member.  That sequence's own nodes are its deepest ones, so what
   a subtree sums up is, per sequence, the sum over its own nodes from a depth on: one row per sequence and depth,
   however long the conversations are.

Running sums go block by block of ``BLOCK`` places, so neither a conversation of very many turns nor one that very
many share is held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import lookup_join, running_total
from ..sources.workspace import keep

# Places of a running sum that one window holds.
BLOCK = 4096
# Numbers of conversations that make one string before the digest of members is taken.
ENDS_BLOCK = 1024
_PARTS = range(4)
_OWN = [f"own{k}" for k in _PARTS]
_KEY = [f"key{k}" for k in _PARTS]
_PARENT = [f"parent{k}" for k in _PARTS]
_WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, place, digest, words) of every turn, placed from 1 by ``turn``, null first.

    Null role or text is empty; turns of equal number follow each other by the digest of role and text.  Rows
    without a conversation are left out.
    """
    said, by = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, role))
    rows = conversations.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256).alias("digest"),
        F.regexp_count(said, F.lit(_WORD)).cast("long").alias("words"),
    )
    placed = running_total(rows.withColumn("one", F.lit(1)), ["conv"], ["turn", "digest"], "one", "place")
    return placed.select("conv", "place", "digest", "words")


def with_shared_start(turns: DataFrame, block: int, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their turns rebuilt: the first ``shared`` ones come from the first of their block.

    Conversation c takes the first ``shared`` turns (an expression of ``conv``, up to ``most``) of conversation
    c - c % ``block``, all if that has fewer, and then its own turns from there on.
    """
    first = F.col("conv") - F.col("conv") % block
    convs = keep(turns.select("conv").distinct().withColumns({"n_shared": shared, "first": first}))
    heads = keep(
        turns.filter((F.col("conv") == first) & (F.col("place") <= most)).withColumnRenamed("conv", "first")
    )
    start = convs.join(heads, "first").filter("place <= n_shared").select("conv", "place", "digest", "words")
    # Own turns keep their place unless the first conversation of the block is shorter than that.
    sizes = heads.groupBy("first").agg(F.max("place").alias("n_first"))
    missing = F.col("n_shared") - F.least("n_shared", F.coalesce("n_first", F.lit(0)))
    short = convs.join(sizes, "first", "left").select("conv", missing.alias("missing")).filter("missing > 0")
    own = lookup_join(turns.filter(F.col("place") > shared), short, ["conv"], "left")
    own = own.select("conv", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("place"), "digest", "words")
    return convs.select("conv"), start.unionByName(own)


def _running(rows: DataFrame, key: str, place: Column, values: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Sums of ``values`` per ``key`` up to each place (from 0, no gaps), in blocks of places."""
    rows = rows.withColumns({"_place": place, "_block": F.floor(place / BLOCK)})
    inside = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({o: F.sum(v).over(inside) for v, o in zip(values, out)})
    # Only blocks with another one before them have an offset.
    ends = rows.filter(F.col("_place") % BLOCK == BLOCK - 1).select(
        key, (F.col("_block") + 1).alias("_block"), *[F.col(o).alias(f"_{o}") for o in out]
    )
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    offsets = ends.withColumns({f"_{o}": F.sum(f"_{o}").over(earlier) for o in out})
    summed = rows.join(offsets, [key, "_block"], "left")
    added = {o: F.col(o) + F.coalesce(F.col(f"_{o}"), F.lit(0)) for o in out}
    return summed.withColumns(added).drop("_place", "_block", *[f"_{o}" for o in out])


def _ends(wholes: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256): the digest of each sequence's members, ascending and comma-joined.

    Members are joined to strings per block of numbers; the strings of a sequence run through the hash one by one.
    """
    members = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = wholes.groupBy("depth", *_KEY, F.floor(F.col("conv") / ENDS_BLOCK).alias("part")).agg(members.alias("members"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            done = []
            for key, part in zip(keys, batch.column(5).to_pylist()):
                if key == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                digest.update(part.encode())
            yield _rows(done)
        if last is not None:
            yield _rows([(*last, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())], ["depth", *_KEY, "ends_sha256"]
        )

    dealt = parts.repartition("depth", *_KEY).sortWithinPartitions("depth", *_KEY, "part")
    schema = ", ".join(f"{c} long" for c in ["depth", *_KEY])
    return dealt.select("depth", *_KEY, "members").mapInArrow(work, f"{schema}, ends_sha256 string")


def weighted_sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed turns, the key of every conversation, and the distinct conversations with smallest member and number."""
    digest = F.sha2(F.concat_ws(":", "place", "digest"), 256)
    parts = {o: F.conv(F.substring("whole", 1 + 8 * k, 8), 16, 10).cast("long") for k, o in enumerate(_OWN)}
    keyed = keep(turns.withColumn("whole", digest).select("conv", "place", "words", *[c.alias(o) for o, c in parts.items()]))
    sums = keyed.groupBy("conv").agg(F.count("*").alias("depth"), *[F.sum(o).alias(k) for o, k in zip(_OWN, _KEY)])
    wholes = keep(convs.join(sums, "conv", "left").fillna(0, ["depth", *_KEY]))
    sequences = wholes.groupBy("depth", *_KEY).agg(F.min("conv").alias("sequence"), F.count("*").alias("weight"))
    return keyed, wholes, keep(sequences)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``convs``: conv, all of them; ``turns``: conv, place (from 1, no gaps), digest, words.  Columns: conv_id (the
    smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  A conversation without turns is a member of the root only; without any conversation there is no
    row.  Repeated conversations count each.
    """
    keyed, wholes, sequences = weighted_sequences(convs, turns)
    chosen = sequences.select(F.col("sequence").alias("conv"), "weight", F.col("depth").alias("length"))
    running = _running(lookup_join(keyed, chosen, ["conv"]), "conv", F.col("place") - 1, _OWN, _KEY)
    prefixes = running.select(
        F.col("conv").alias("sequence"), F.col("place").cast("long").alias("depth"), "words", "weight", "length", *_KEY,
        *[(F.col(k) - F.col(o)).alias(p) for k, o, p in zip(_KEY, _OWN, _PARENT)],
    )
    zero = F.lit(0).cast("long")
    root = sequences.select(
        "sequence", zero.alias("depth"), zero.alias("words"), "weight", F.col("depth").alias("length"),
        *[zero.alias(k) for k in _KEY], *[F.lit(None).cast("long").alias(p) for p in _PARENT],
    )
    prefixes = keep(prefixes.unionByName(root))
    node = ["depth", *_KEY]
    nodes = keep(
        prefixes.groupBy(*node).agg(
            F.min("sequence").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
            F.max("length").alias("longest"), *[F.max(p).alias(p) for p in _PARENT],
        )
    )
    leaves = sequences.join(nodes.filter("longest > depth").select(*node), node, "left_anti")
    # What a node adds to every subtree that it is in, at its place in the sequence that it belongs to.
    own = nodes.select(
        F.col("conv_id").alias("sequence"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), zero.alias("leaf")
    ).unionByName(leaves.select("sequence", "depth", zero.alias("saved"), F.lit(1).cast("long").alias("leaf")))
    own = own.groupBy("sequence", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    added = prefixes.select("sequence", "length", *node).join(own, ["sequence", "depth"], "left").fillna(0, ["saved", "leaf"])
    from_here = _running(added, "sequence", F.col("length") - F.col("depth"), ["saved", "leaf"], ["saved_below", "leaves_below"])
    sums = from_here.groupBy(*node).agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves"))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(_PARENT, _KEY)])
    found = keep(
        nodes.join(sums, node).join(children.agg(F.count("*").alias("n_children")), node, "left").join(_ends(wholes), node, "left")
    )
    parents = found.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for p, k in zip(_PARENT, _KEY)], F.col("conv_id").alias("parent_conv_id")
    )
    return lookup_join(found, parents, ["depth", *_PARENT], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
