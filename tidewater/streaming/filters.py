"""Bloom filters that tell which parts of a relation may hold an ID.

A filter is a set of pages of 32,768 bits, as many as the part's rows need and always a power
of two. It is built by one aggregation over the IDs and probed by a join on pages, so
neither its size nor the number of parts or IDs is limited by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a page, bits of the filter for each row at least, and probes of an ID: it is found in a part without it once in 170,000.
PAGE_BITS, BITS, PROBES = 32_768, 32, 8


def _probes(rows: DataFrame, id_col: str, pages: Column) -> DataFrame:
    """Adds pages, probe, page and bit, a row for each probe."""
    hashes = F.array(*(F.xxhash64(F.lit(i), F.col(id_col)) for i in range(PROBES)))
    out = rows.withColumn("pages", pages).select("*", F.posexplode(hashes).alias("probe", "_h"))
    return out.withColumns({"page": F.pmod("_h", F.col("pages")), "bit": F.pmod(F.shiftright("_h", 40), F.lit(PAGE_BITS))}).drop("_h")


def id_filters(rows: DataFrame, part: str, id_col: str = "ID") -> DataFrame:
    """(part, pages, page, bits) from rows with a part and an ID; a null ID is never found."""
    known = rows.select(part, id_col).where(F.col(id_col).isNotNull())
    need = F.greatest(F.lit(1.0), F.count("*") * BITS / PAGE_BITS)
    sizes = known.groupBy(part).agg(F.pow(F.lit(2.0), F.ceil(F.log2(need))).cast("long").alias("_pages"))
    probes = _probes(known.join(sizes, part), id_col, F.col("_pages"))
    return probes.groupBy(part, "pages", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def parts_with(filters: DataFrame, ids: DataFrame, part: str, id_col: str = "ID") -> DataFrame:
    """The parts whose filter answers for at least one of the IDs."""
    sizes = [r[0] for r in filters.select("pages").distinct().collect()]  # powers of two: 63 at most
    if not sizes:
        return filters.select(part).distinct()
    asked = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    probes = _probes(asked, id_col, F.explode(F.array(*(F.lit(s) for s in sizes))))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = probes.join(filters, ["pages", "page"]).where(F.expr("element_at(array(1, 2, 4, 8, 16, 32, 64, 128), cast(bit % 8 as int) + 1)").bitwiseAND(byte) != 0)
    return held.groupBy(part, id_col).agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select(part).distinct()
