"""URL filtering by given rules and by association rules mined from labelled URLs.

A given rule is a host with a path prefix.  URLs without one get the verdict of
mined rules.  Tokens that occur in exactly the same labelled URLs say the same,
so they are one item, and a URL has the item if it has one of them; without that
many keys that always come together would make every combination of them
frequent.  FP-growth finds combinations of items that go with a label; rules
below the support or confidence, and rules that a shorter one makes superfluous,
are dropped.  A rule is indexed under its rarest item; a URL's items look up
candidates there, and a candidate holds if all its items are in the URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import lookup_join
from ..sources.workspace import keep

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
# Labelled URLs that a rule rests on at least, however few there are in all.
MIN_ROWS = 3
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host labels, path words, extension, query keys, scheme.

    Numbers in a path are one token; empty parts give none.
    """
    tail = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    words = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[^.]*$", ""), "^[0-9]+$", "#"))
    keys = F.transform(F.split(tail, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(
        F.concat(
            marked("host:", F.split(host, r"\.")),
            marked("path:", words),
            marked("ext:", F.array(F.regexp_extract(path, r"\.([^./]*)$", 1))),
            marked("key:", keys),
            marked("scheme:", F.array(F.coalesce(F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)), F.lit("")))),
        )
    )


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest given rule (verdict, host, path prefix) that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(prefix))
        best = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def token_items(labelled: DataFrame, tokens: str, min_rows: int) -> DataFrame:
    """(token, item, members) of the tokens in ``min_rows`` rows or more; tokens of equal rows share an item.

    An item is called by its first token.  Rows are told apart by two sums of hashes and their number.
    """
    rows = labelled.select(F.explode(F.array_distinct(tokens)).alias("token"), "row")
    sums = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    counted = rows.groupBy("token").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= min_rows)
    same = counted.groupBy("n", "sum1", "sum2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return same.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "members")


def _itemised(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, items) of distinct token sets; ``items`` are few, as each holds a share of the labelled rows."""
    named = sets.withColumn("token", F.explode("tokens")).join(F.broadcast(items.select("token", "item")), "token")
    found = named.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.join(found, "tokens", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def mine_rules(
    labelled: DataFrame,
    tokens: str,
    label: str,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS,
) -> DataFrame | None:
    """(key, antecedent, verdict, confidence, support) of the rules worth keeping, None without labelled rows.

    ``key`` is the antecedent's rarest token among the labelled rows.  A rule rests on a share of ``min_support`` of
    the labelled rows and on ``min_rows`` of them.
    """
    rows = keep(
        labelled.filter(F.col(label).isNotNull() & F.col(tokens).isNotNull())
        .select(F.concat(F.col(tokens), F.array(F.concat(F.lit("="), F.col(label)))).alias("items"))
    )
    n = rows.count()
    if n == 0:
        return None
    # A little less than the share, so that rounding does not ask for a row more.
    support = min(1.0, max(min_support, (min_rows - 0.5) / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    is_label = lambda x: F.startswith(x, F.lit("="))
    rules = keep(
        model.associationRules.filter(is_label(F.col("consequent")[0]) & ~F.exists("antecedent", is_label)).select(
            F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 1000).alias("verdict"),
            "confidence", "support",
        )
    )
    # A rule is superfluous if a part of it says the same at least as surely; first single tokens and all but one.
    a = F.col("antecedent")
    parts = F.concat(F.transform(a, lambda x: F.array(x)), F.transform(a, lambda x: F.array_remove(a, x)))
    part = F.explode(F.filter(F.array_distinct(parts), lambda p: (F.size(p) > 0) & (F.size(p) < F.size(a)))).alias("part")
    shorter = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    superfluous = (
        rules.select("antecedent", "verdict", "confidence", part).join(shorter, ["part", "verdict"])
        .filter("part_confidence >= confidence").select("antecedent", "verdict").distinct()
    )
    frequent = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("token")).distinct().join(frequent, "token")
        .groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    )
    # What is left holds every rule that no part makes superfluous; against those all parts are tested.
    left = keep(
        rules.join(superfluous, ["antecedent", "verdict"], "left_anti").join(rarest, "antecedent")
        .select("key", "antecedent", "verdict", "confidence", "support")
    )
    shorter = left.select("key", F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    superfluous = (
        left.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("key")).join(shorter, ["key", "verdict"])
        .filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
        .filter("part_confidence >= confidence").select("antecedent", "verdict").distinct()
    )
    return left.join(superfluous, ["antecedent", "verdict"], "left_anti").select(
        "key", "antecedent", "verdict", "confidence", "support"
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    labels: DataFrame | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(``key``, host, path, rule, verdict, mined_rule, confidence) of every row of ``pages``.

    Rules are mined from ``labels`` (url, verdict), or else from the pages that
    a given rule decides.  Among mined rules that hold the surest counts, then
    the one with more support, then the first; without one the URL is allowed.
    ``mined_rule`` shows its items, each as its tokens with bars between.
    A null URL or one without ``://`` has empty host and path.  Repeated rows
    are judged each.
    """
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{key}`").alias("id"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))
    )
    if labels is None:
        labelled = rows.filter("given is not null").select("tokens", F.col("given.verdict").alias("verdict"))
    else:
        labelled = labels.select(tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "verdict")
    labelled = keep(labelled.filter("verdict is not null and tokens is not null").withColumn("row", F.monotonically_increasing_id()))
    items = keep(token_items(labelled, "tokens", min_rows))
    known = lookup_join(labelled, _itemised(labelled.select("tokens").distinct(), items), ["tokens"])
    mined = mine_rules(known, "items", "verdict", min_support, min_confidence, min_rows)
    nothing = F.lit(None).cast("struct<confidence:double,support:double,shown:string,verdict:string>")
    if mined is None:
        judged = rows.withColumn("best", nothing)
    else:
        members = items.select(F.col("item").alias("part"), F.array_join("members", "|").alias("said")).distinct()
        parts = mined.select("antecedent", F.explode("antecedent").alias("part")).distinct().join(F.broadcast(members), "part")
        shown = parts.groupBy("antecedent").agg(F.array_join(F.array_sort(F.collect_list("said")), " ").alias("shown"))
        mined = mined.join(shown, "antecedent")
        # URLs with the same tokens get the same mined verdict, so token sets are looked up once each.
        sets = _itemised(rows.filter("given is null").select("tokens").distinct(), items)
        held = (
            sets.withColumn("key", F.explode("items")).join(mined, "key")
            .filter(F.size(F.array_except("antecedent", "items")) == 0)
            .groupBy("tokens")
            .agg(
                F.max_by(
                    F.struct("confidence", "support", "shown", "verdict"),
                    F.struct("confidence", "support", -F.size("antecedent"), F.array_join("antecedent", " "), "verdict"),
                ).alias("best")
            )
        )
        judged = rows.join(held, "tokens", "left")
    return judged.select(
        F.col("id").alias(key), "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "best.verdict", F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("best.shown")).alias("mined_rule"),
        F.when(F.col("given").isNull(), F.col("best.confidence")).alias("confidence"),
    )
