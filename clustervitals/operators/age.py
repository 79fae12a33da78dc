"""Which databases and relations are near transaction wraparound.

Age tables are the coordinator's rows (segid = -1) stacked on all segments'.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .remediation import remediation_statements
from .spread import top_n

LEVEL = 300_000_000
# Fixed value: the age reported for relations that never freeze.
NEVER_FREEZES = 2147483647
MAINTENANCE_DATABASES = ("postgres", "template1", "gpperfmon")


def database_age(dbs: DataFrame, n: int | None = None, ordered: bool = True) -> DataFrame:
    """Age per database on the coordinator, oldest first; the n oldest if given."""
    ages = dbs.filter(F.col("segid") == -1).select("datname", "age_int")
    if n is None and not ordered:
        return ages
    oldest = ages.orderBy(F.desc("age_int"), "datname")
    return oldest if n is None else oldest.limit(n)


def segment_age(dbs: DataFrame, n: int = 50) -> DataFrame:
    """The n oldest (segment, database) pairs."""
    return (
        dbs.filter(F.col("segid") >= 0)
        .select("segid", "datname", "age_int")
        .orderBy(F.desc("age_int"), "segid", "datname")
        .limit(n)
    )


def _over_age(ages: DataFrame, level: int, skip_never: bool) -> DataFrame:
    over = ages.filter(F.col("age_int") > level)
    return over.filter(F.col("age_int") != NEVER_FREEZES) if skip_never else over


def high_age_relations(
    rel_age: DataFrame,
    rels: DataFrame,
    leaves: bool = False,
    level: int = LEVEL,
    n: int = 8000,
    skip_never: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Relations over ``level`` on any segment, oldest first.

    Roots and unpartitioned tables by default, leaf partitions with
    ``leaves``.  Ages are reduced to one per relation before the catalog join.
    ``skip_never`` leaves out relations that never freeze; old servers counted
    them.  ``by`` names columns of both inputs that tell databases or snapshots
    apart, whose lists are limited each.
    """
    leaf = names.is_leaf_name(F.col("relname"))
    wanted = (~F.col("relhassubclass") & leaf) if leaves else (F.col("relhassubclass") | ~leaf)
    tables = rels.filter((F.col("relkind") == "r") & (F.col("relstorage") != "x") & wanted)
    oldest = (
        _over_age(rel_age, level, skip_never)
        .groupBy(*by, "reloid")
        .agg(F.max("age_int").alias("age_int"))
        .join(tables.select(*by, "reloid", "schemaname", "relname"), [*by, "reloid"])
        .select(*by, "reloid", "schemaname", "relname", "age_int")
    )
    return top_n(oldest, [F.desc("age_int"), F.col("reloid")], n, by)


def high_age_auxiliary(
    aux_age: DataFrame, links: DataFrame, rels: DataFrame | None = None, level: int = LEVEL, n: int = 3000
) -> DataFrame:
    """Owners of over-age auxiliary relations: segment file (o), visibility map (m), block directory (b).

    The three link columns become rows, so one join covers all kinds.
    """
    owners = links.select(
        F.col("relid").alias("reloid"),
        F.stack(
            F.lit(3),
            F.lit("o"), F.col("segrelid"),
            F.lit("m"), F.col("visimaprelid"),
            F.lit("b"), F.col("blkdirrelid"),
        ).alias("relkind", "auxoid"),
    )
    oldest = (
        _over_age(aux_age, level, skip_never=True)
        .groupBy("auxoid", "relkind")
        .agg(F.max("age_int").alias("age_int"))
        .join(owners, ["auxoid", "relkind"])
        .groupBy("reloid")
        .agg(F.max("age_int").alias("age_int"))
    )
    if rels is not None:
        oldest = oldest.join(rels.select("reloid", "schemaname", "relname"), "reloid")
    return oldest.orderBy(F.desc("age_int"), "reloid").limit(n)


def freeze_worklist(
    rel_age: DataFrame, aux_age: DataFrame, links: DataFrame, rels: DataFrame, level: int = LEVEL
) -> DataFrame:
    """Relations to freeze, with their statement, as three lists.

    Roots and unpartitioned tables, leaf partitions, and owners of auxiliary
    relations, each oldest first and limited on its own.  A table may be on
    more than one list.
    """
    lists = {
        "tables": high_age_relations(rel_age, rels, level=level),
        "partitions": high_age_relations(rel_age, rels, leaves=True, level=level),
        "auxiliary": high_age_auxiliary(aux_age, links, rels, level=level),
    }
    labelled = [df.withColumn("list", F.lit(name)) for name, df in lists.items()]
    return remediation_statements(reduce(DataFrame.unionByName, labelled), "freeze")


def high_age_databases(dbs: DataFrame, names: Sequence[str] = MAINTENANCE_DATABASES, level: int = LEVEL) -> DataFrame:
    """Listed databases over ``level`` on the coordinator or any segment."""
    return dbs.filter((F.col("age_int") > level) & F.col("datname").isin(*names)).select("datname").distinct()
