"""How much space dead rows take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .scope import schema_scope

# Page layout assumed by the heap estimate.
TUPLE_HEADER = 27
MAX_ALIGN = 4
ITEM_POINTER = 4
PAGE_OVERHEAD = 20
EMPTY_TABLE_BLOAT = 1000

# Report limits.
HEAP_MIN_WASTED = 100 * 1024 * 1024
HEAP_MIN_BLOAT = 2.0
AO_MIN_BLOAT = 1.9


def ao_bloat(
    visimap: DataFrame, schemas: Sequence[str] | None = None, min_bloat: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Hidden share and bloat of append-only relations, summed over segments.

    Bloat is 100 / (100.1 - percent hidden): about 1 when clean, 1000 when
    every row is hidden.  Only the listed ``schemas`` and relations above
    ``min_bloat``, if given.
    """
    if schemas is not None:
        visimap = schema_scope(visimap, include=schemas)
    totals = visimap.groupBy(*by, "reloid", "schemaname", "tablename").agg(
        F.sum("hidden").alias("hidden"), F.sum("total").alias("total")
    )
    share = (F.col("hidden").cast("decimal(20,0)") * 100) / F.col("total").cast("decimal(20,0)")
    percent = F.when(F.col("total") > 0, F.round(share, 2)).otherwise(F.lit(0)).cast("decimal(5,2)")
    result = totals.withColumn("percent_hidden", percent).select(
        *by,
        "reloid",
        "schemaname",
        "tablename",
        F.col("percent_hidden").cast("double").alias("percent_hidden"),
        (F.lit(100.0) / (F.lit("100.1").cast("decimal(6,2)") - F.col("percent_hidden")).cast("double")).alias("bloat"),
    )
    return result if min_bloat is None else result.filter(F.col("bloat") > min_bloat)


def _padded(width: Column) -> Column:
    """Width plus padding: a full unit when already aligned, else the distance to alignment twice removed."""
    rest = width % MAX_ALIGN
    return width + MAX_ALIGN - F.when(rest == 0, MAX_ALIGN).otherwise(rest)


def heap_bloat(
    col_stats: DataFrame,
    rels: DataFrame,
    block_size: int = 32768,
    min_wasted: int = HEAP_MIN_WASTED,
    min_bloat: float = HEAP_MIN_BLOAT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Heap tables with more pages than their column statistics explain.

    ``col_stats``: schemaname, tablename, null_frac, avg_width.
    ``rels``: schemaname, relname, reltuples, relpages.
    Widths are summed in millionths of a byte as integers, so the estimate does
    not depend on row order.
    """
    null_ppm = F.round(F.col("null_frac").cast("double") * 1e6).cast("long")
    micro = F.lit(1000000).cast("decimal(7,0)")
    widths = (
        col_stats.filter(F.col("schemaname") != "information_schema")
        .groupBy(*by, "schemaname", "tablename")
        .agg(
            F.sum((1000000 - null_ppm) * F.col("avg_width")).cast("decimal(20,0)").alias("datawidth"),
            F.max(null_ppm).cast("decimal(7,0)").alias("max_null_frac"),
            F.count_if(F.col("null_frac") != 0).alias("nullable"),
        )
        .withColumn("datawidth", F.col("datawidth") / micro)
        .withColumn("max_null_frac", F.col("max_null_frac") / micro)
        .withColumn("null_header", F.lit(TUPLE_HEADER + 1) + F.expr("nullable div 8"))
    )
    header = TUPLE_HEADER + MAX_ALIGN - (TUPLE_HEADER % MAX_ALIGN or MAX_ALIGN)
    row_size = (
        _padded(F.col("datawidth") + header)
        + F.col("max_null_frac") * _padded(F.col("null_header"))
        + ITEM_POINTER
    ).cast("double")
    live = F.ceil(F.col("reltuples").cast("double") * row_size / F.lit(float(block_size - PAGE_OVERHEAD)))
    pages = rels.withColumnRenamed("relname", "tablename").join(widths, [*by, "schemaname", "tablename"])
    ratio = F.try_divide(F.col("relpages").cast("decimal(20,0)"), F.col("live_pages").cast("decimal(20,0)"))
    return (
        pages.withColumn("live_pages", live)
        .filter(F.col("relpages") - F.col("live_pages") > 2)
        .select(
            *by,
            "schemaname",
            "tablename",
            "relpages",
            "live_pages",
            F.when(F.col("live_pages") == 0, F.lit(EMPTY_TABLE_BLOAT))
            .otherwise(F.round(ratio, 1))
            .cast("decimal(18,1)")
            .alias("bloat"),
            F.greatest(F.lit(0), block_size * (F.col("relpages") - F.col("live_pages"))).cast("long").alias("wasted_bytes"),
        )
        .filter((F.col("wasted_bytes") > min_wasted) & (F.col("bloat") > F.lit(str(min_bloat)).cast("decimal(9,4)")))
    )


def bloat_report(
    heap: DataFrame, ao: DataFrame, min_ao_bloat: float = AO_MIN_BLOAT, ordered: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Bloated heap and append-only tables in one list, worst first within each kind."""
    tablename = names.qualified_name(F.col("schemaname"), F.col("tablename"))

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            *by, tablename.alias("tablename"), F.lit(kind).alias("relstorage"), F.col("bloat").cast("decimal(18,2)").alias("bloat")
        )

    both = rows(heap, "h").unionByName(rows(ao.filter(F.col("bloat") > min_ao_bloat), "ao"))
    return both.orderBy(*by, "relstorage", F.desc("bloat"), "tablename") if ordered else both


def catalog_bloat(actual: DataFrame, compact: DataFrame, ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Size of each system catalog against a freshly rewritten copy.

    ``actual``: catalog, segid (-1 = coordinator), size_bytes, row_count.
    ``compact``: catalog, compact_bytes.  The ratio is that of the coordinator
    and null when the copy is empty.
    """
    on_coordinator = F.col("segid") == -1
    sizes = actual.groupBy(*by, "catalog").agg(
        F.coalesce(F.sum(F.when(on_coordinator, F.col("row_count"))), F.lit(0)).alias("row_count"),
        F.sum("size_bytes").alias("size_total"),
        F.sum(F.when(on_coordinator, F.col("size_bytes"))).alias("size_coordinator"),
        F.sum(F.when(F.col("segid") == 0, F.col("size_bytes"))).alias("size_seg0"),
    )
    ratio = F.try_divide(F.col("size_coordinator").cast("double"), F.col("compact_bytes").cast("double"))
    result = sizes.join(compact.select(*by, "catalog", "compact_bytes"), [*by, "catalog"], "left").withColumn(
        "bloat", F.round(ratio, 4)
    )
    return result.orderBy(*by, "catalog") if ordered else result
