"""Who may do what, decoded from access lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import acl, names


def table_privileges(rels: DataFrame) -> DataFrame:
    """One row per relation and grantee; without an access list the owner holds everything.

    ``rels``: schemaname, tablename, relkind, rolname (owner), relacl and,
    where known, spcname.
    """
    tablespace = F.coalesce("spcname", F.lit("pg_default")) if "spcname" in rels.columns else F.lit("pg_default")
    listed = rels.filter(F.col("relkind").isin("r", "v", "x") & ~names.is_leaf_name(F.col("tablename")))
    # explode_outer also emits a row for an empty list, which grants nothing to anyone.
    items = listed.filter(F.col("relacl").isNull() | (F.size("relacl") > 0)).withColumn(
        "item", F.explode_outer("relacl")
    )
    no_list = F.col("item").isNull()
    grantee = acl.acl_role(F.col("item"))
    return items.select(
        "schemaname",
        "tablename",
        F.when(F.col("relkind") == "r", "Table").otherwise("View").alias("tabletype"),
        tablespace.alias("reltablespace"),
        F.when(no_list, F.col("rolname")).otherwise(grantee).alias("rolname"),
        F.when(no_list | (grantee == F.col("rolname")), "TRUE").otherwise("FALSE").alias("isowner"),
        F.when(no_list, acl.all_table_privileges()).otherwise(acl.acl_table(F.col("item"))).alias("privelege"),
    )


def schema_privileges(namespaces: DataFrame) -> DataFrame:
    """One row per user schema and grantee; the owner alone, with '', when there is no list."""
    listed = namespaces.filter(~F.col("nspname").startswith("pg"))
    items = listed.filter(F.col("nspacl").isNull() | (F.size("nspacl") > 0)).withColumn(
        "item", F.explode_outer("nspacl")
    )
    item = F.col("item")
    return items.select(
        F.col("nspname").alias("schemaname"),
        F.when(item.isNull(), F.col("rolname")).otherwise(acl.acl_role(item)).alias("usename"),
        acl.acl_schema(item).alias("schema_privillege"),
    )


def exact_privilege_roles(namespaces: DataFrame, flags: str) -> DataFrame:
    """Roles holding exactly ``flags`` on each schema."""
    return namespaces.select("nspname", acl.roles_with_exact_privilege(F.col("nspacl"), flags).alias("roles"))
