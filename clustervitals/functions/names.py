"""Column expressions over object names, storage codes, sizes and statement text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTITION_MARK = "_1_prt_"

# Storage codes and their report labels.
STORAGE_LABELS = {"a": "AO row", "c": "AO column", "h": "Heap", "x": "External"}


def partition_root(name: Column, mark: str = PARTITION_MARK) -> Column:
    """Text before the first literal partition mark, or the whole name."""
    return F.substring_index(name, mark, 1)


def is_leaf_name(name: Column, mark: str = PARTITION_MARK) -> Column:
    return F.instr(name, mark) > 0


def qualified_name(schema: Column, name: Column) -> Column:
    return F.concat(schema, F.lit("."), name)


def quote_ident(name: Column) -> Column:
    """Double-quoted SQL identifier with embedded quotes doubled."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def quoted_name(schema: Column, name: Column) -> Column:
    return F.concat(quote_ident(schema), F.lit("."), quote_ident(name))


def storage_label(code: Column) -> Column:
    first, *rest = STORAGE_LABELS.items()
    labels = reduce(lambda c, kv: c.when(code == kv[0], kv[1]), rest, F.when(code == first[0], first[1]))
    return labels.otherwise("Others")


def access_method_label(relkind: Column, access_method: Column) -> Column:
    """Storage label where storage is named by access method and foreign tables by kind."""
    return F.when(relkind == "f", F.lit("foreign table")).otherwise(access_method)


def pretty_size(size: Column) -> Column:
    """Human-readable bytes: a unit is kept while its rounded value is below 10240.

    Each step shifts out ten more bits but keeps one for rounding half up, so
    the text never depends on floating point.
    """
    kilo, mega, giga, tera = (F.shiftright(size, bits) for bits in (9, 19, 29, 39))

    def text(halves: Column, unit: str) -> Column:
        return F.concat(F.shiftright(halves + 1, 1).cast("string"), F.lit(unit))

    below = 2 * 10240 - 1
    return (
        F.when(size < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(kilo < below, text(kilo, " kB"))
        .when(mega < below, text(mega, " MB"))
        .when(giga < below, text(giga, " GB"))
        .when(tera.isNotNull(), text(tera, " TB"))
    )


def query_snippet(query: Column, n: int = 100) -> Column:
    return F.substring(query, 1, n)
