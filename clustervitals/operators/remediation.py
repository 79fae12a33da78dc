"""Statements an administrator may run on flagged objects.  Text only; nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

# One statement per kind; %s is the quoted object or the process id.
TEMPLATES = {
    "reorganize": "ALTER TABLE %s SET WITH (reorganize=true); ANALYZE %s;",
    "vacuum": "VACUUM %s;",
    "vacuum_analyze": "VACUUM ANALYZE %s;",
    "freeze": "VACUUM FREEZE %s;",
    "analyze": "ANALYZE %s;",
    "analyze_root": "ANALYZE ROOTPARTITION %s;",
    "drop_schema": "DROP SCHEMA IF EXISTS %s CASCADE;",
    "vacuum_database": "vacuumdb %s;",
    "terminate": "SELECT pg_terminate_backend(%s);",
}


def _target(columns: list[str], template: str) -> Column:
    if template == "terminate":
        return F.col("pid").cast("string")
    if template == "drop_schema":
        return names.quote_ident(F.col("nspname"))
    if template == "vacuum_database":
        return names.quote_ident(F.col("datname"))
    relname = "relname" if "relname" in columns else "tablename"
    if "schemaname" in columns:
        return names.quoted_name(F.col("schemaname"), F.col(relname))
    # A joined name: the schema ends at the first dot.
    schema = F.substring_index(F.col(relname), ".", 1)
    return names.quoted_name(schema, F.substr(F.col(relname), F.length(schema) + 2))


def remediation_statements(df: DataFrame, template: str) -> DataFrame:
    """Add ``statement`` for each flagged object of ``df``."""
    target = _target(df.columns, template)
    text = TEMPLATES[template]
    pieces = text.split("%s")
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [target, F.lit(piece)]
    return df.withColumn("statement", F.concat(*parts))
