"""Which schemas and relations a report covers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name prefixes of schemas hidden by default.
SYSTEM_PREFIXES = ("pg", "gp")

# Schemas never analyzed.
ANALYZE_DENY_LIST = (
    "gp_toolkit",
    "ngpaatmpdata",
    "pg_toast",
    "pg_bitmapindex",
    "pg_catalog",
    "public",
    "information_schema",
    "gpexpand",
    "pg_aoseg",
    "oracompat",
    "monitor_old",
    "tmp_gpexport_copy",
    "stage",
    "tmp_job",
    "tmp",
    "monitor",
    "workfile",
    "session_state",
)

FIRST_USER_OID = 16384


def not_system(schema: Column, prefixes: Sequence[str] = SYSTEM_PREFIXES) -> Column:
    return reduce(lambda c, p: c & ~schema.startswith(p), prefixes, F.lit(True))


def read_schema_list(lines: Iterable[str]) -> list[str]:
    """Schema names of a list file: blank lines and lines starting with '#' are skipped."""
    stripped = (line.strip() for line in lines)
    return [name for name in stripped if name and not name.startswith("#")]


def _in_list(df: DataFrame, names: Sequence[str], column: str, keep: bool) -> DataFrame:
    if any(name is None for name in names):
        raise ValueError("a list of names must not hold None")
    listed = F.col(column).isin(sorted(set(names)))
    return df.filter(listed if keep else ~listed)


def schema_scope(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    all_schemas: bool = False,
    prefixes: Sequence[str] = SYSTEM_PREFIXES,
    column: str = "schemaname",
) -> DataFrame:
    """Keep rows of the chosen schemas; exactly one of the three modes applies.

    ``all_schemas`` and ``exclude`` leave out system prefixes and
    ``information_schema``; ``include`` takes the names as given.
    """
    if (include is not None) + (exclude is not None) + bool(all_schemas) != 1:
        raise ValueError("give exactly one of include, exclude, all_schemas")
    if include is not None:
        return _in_list(df, include, column, keep=True)
    users = df.filter(not_system(F.col(column), prefixes) & (F.col(column) != "information_schema"))
    return users if all_schemas else _in_list(users, exclude, column, keep=False)


def analyze_scope(df: DataFrame, extra_exclude: Sequence[str] = (), column: str = "schemaname") -> DataFrame:
    """All user schemas except those whose statistics are never collected."""
    users = df.filter(not_system(F.col(column)))
    return _in_list(users, [*ANALYZE_DENY_LIST, *extra_exclude], column, keep=False)


def user_relations(rels: DataFrame, first_oid: int = FIRST_USER_OID) -> DataFrame:
    """Relations users created: no system objects, temporary schemas or external tables."""
    schema = F.col("schemaname")
    own_schema = (F.col("schemaoid") > first_oid) | (schema == "public")
    external = (F.col("relstorage") == "x") | (F.col("relkind") == "f")
    return rels.filter((F.col("reloid") > first_oid) & own_schema & ~schema.startswith("pg_temp_") & ~external)
