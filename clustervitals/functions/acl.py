"""Access-list items are strings ``grantee=flags/grantor``; an empty grantee is public."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Privilege flags in report order.
TABLE_PRIVILEGES = {"r": "Select;", "a": "Insert;", "w": "Update;", "d": "Delete;", "D": "Truncate;"}
SCHEMA_PRIVILEGES = {"U": "Usage;", "C": "Create;"}


def _part(text: Column, sep: str, n: int) -> Column:
    return F.split_part(text, F.lit(sep), F.lit(n))


def acl_role(item: Column) -> Column:
    """Grantee of an item; ``public`` when blank, '' when the item is null."""
    grantee = _part(F.trim(item), "=", 1)
    return F.when(item.isNull(), "").when(F.trim(grantee) == "", "public").otherwise(grantee)


def _spell(item: Column, names: dict[str, str]) -> Column:
    flags = _part(_part(F.trim(item), "=", 2), "/", 1)
    words = [F.when(flags.contains(flag), word).otherwise("") for flag, word in names.items()]
    return F.when(item.isNull(), "").otherwise(F.concat(*words))


def acl_table(item: Column) -> Column:
    return _spell(item, TABLE_PRIVILEGES)


def acl_schema(item: Column) -> Column:
    return _spell(item, SCHEMA_PRIVILEGES)


def all_table_privileges() -> Column:
    return F.lit("".join(TABLE_PRIVILEGES.values()))


def roles_with_exact_privilege(acl: Column, flags: str) -> Column:
    """Roles whose flags are exactly ``flags``, ';'-joined.

    A null or empty list gives ''; a list without such a role gives null.
    """
    holders = F.filter(acl, lambda item: item.contains(f"={flags}/"))
    names = F.transform(
        holders,
        lambda item: F.when(item.startswith("="), F.lit("public")).otherwise(F.substring_index(item, "=", 1)),
    )
    return (
        F.when(acl.isNull() | (F.size(acl) == 0), F.lit(""))
        .when(F.size(names) > 0, F.array_join(names, ";"))
    )
