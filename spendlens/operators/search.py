"""Customer search, paging and statistics of the filtered set."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import dbl, js_round
from spendlens.operators.ranking import with_global_row_number
from spendlens.operators.selection import order_statistics

ALL = "All"


def customer_search(profile: DataFrame, search: str = "", segment: str = ALL,
                    country: str = ALL) -> DataFrame:
    """Case-folded literal substring match of ``search`` on name, email or id
    (no wildcards; empty = everyone), then optional exact segment and country
    filters ('All' or empty = no filter)."""
    out = profile
    if search:
        needle = F.lit(search.lower())
        out = out.filter(F.lower("name").contains(needle) | F.lower("email").contains(needle)
                         | F.lower("customer_id").contains(needle))
    if segment and segment != ALL:
        out = out.filter(F.col("segment") == segment)
    if country and country != ALL:
        out = out.filter(F.col("country") == country)
    return out


def _page_args(page, limit):
    """Leading whole numbers, as ``parseInt`` reads them; 0 or none: 1 and 10."""
    def as_int(x, default):
        lead = re.match(r"\s*[+-]?\d+", "" if x is None else str(x))
        return (int(lead[0]) if lead else 0) or default
    return max(as_int(page, 1), 1), max(as_int(limit, 10), 1)


#: A page that ends within so many rows is a top-k; a later one is reached through a key.
TOP_ROWS = 10_000
#: Rows of a block of the page index, about.
BLOCK_ROWS = 100_000


def customer_page(found: DataFrame, page=1, limit=10, order: str = "customer_id",
                  num_partitions: int | None = None) -> DataFrame:
    """Rows ``(page-1)*limit`` .. ``page*limit - 1`` of the filtered set in
    ``order`` (a unique key, not null).

    A near page is a top-k.  For a far one, counts by key find a key shortly
    before its first row, and the page is a top-k from there: the found set is
    counted a few times but never sorted or numbered (it should be a stored
    table then; with ``page_index`` the counts are stored as well).
    ``num_partitions`` has no effect any more: a page needs no ranges."""
    page, limit = _page_args(page, limit)
    start = (page - 1) * limit
    if start + limit > TOP_ROWS:
        low, before = _key_before(found, order, start)
        if low is None:
            return found.limit(0)
        found, start = found.filter(F.col(order) >= F.lit(low)), start - before
    return found.orderBy(order).offset(start).limit(limit)


def _key_before(found: DataFrame, order: str, start: int) -> tuple[object, int]:
    """A lower bound of the keys from the row ``start`` on, less than TOP_ROWS rows before it, and the rows below the bound
    (None: there is no such row).

    Strings are counted by prefixes, two more characters in each pass, inside
    the prefix that holds the row; numbers by ``order_statistics``."""
    if not isinstance(found.schema[order].dataType, T.StringType):
        return order_statistics(found, order, lambda n: [start])[1].get(start), start
    prefix, before, key = "", 0, F.col(order)
    while True:
        size = len(prefix) + 2
        counts = (found.filter(key.startswith(prefix)).groupBy(F.substring(key, 1, size).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        for r in sorted(counts, key=lambda r: r["p"].encode()):  # the order of Spark's strings
            if start < before + r["n"]:
                break
            before += r["n"]
        else:
            return None, 0
        if r["n"] <= TOP_ROWS or len(r["p"]) < size:
            return r["p"], before
        prefix = r["p"]


def paged_profile(profile: DataFrame, order: str = "customer_id", num_partitions: int | None = None) -> DataFrame:
    """``profile`` in ``order`` with ``page_block``, the number of its block of BLOCK_ROWS rows, to be stored."""
    ranked = with_global_row_number(profile, [F.col(order).asc()], "__rn", None, num_partitions)
    return ranked.withColumn("page_block", F.floor((F.col("__rn") - 1) / BLOCK_ROWS).cast("long")).drop("__rn")


def page_index(paged: DataFrame, order: str = "customer_id") -> DataFrame:
    """One row per block, segment and country of the stored ``paged_profile``: rows, first_key, last_key."""
    return paged.groupBy("page_block", "segment", "country").agg(
        F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_key"), F.max(order).alias("last_key"))


def customer_page_indexed(paged: DataFrame, index: DataFrame, segment: str = ALL, country: str = ALL, page=1, limit=10,
                          order: str = "customer_id") -> DataFrame:
    """The page of ``customer_search(paged, "", segment, country)`` through the stored index.

    The blocks' counts for the filter (one row per block comes to the driver)
    say between which keys the page lies; only that key range of ``paged`` is
    read, whatever the depth of the page."""
    page, limit = _page_args(page, limit)
    start = (page - 1) * limit
    blocks = (customer_search(index, "", segment, country).groupBy("page_block")
              .agg(F.sum("rows").alias("rows"), F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())
    before, low, high, skip = 0, None, None, 0
    for b in sorted(blocks, key=lambda b: b["page_block"]):
        if before + b["rows"] > start and before < start + limit:
            if low is None:
                low, skip = b["low"], start - before
            high = b["high"]
        before += b["rows"]
    if low is None:
        return paged.drop("page_block").filter(F.lit(False))
    inside = paged.filter(F.col(order).between(F.lit(low), F.lit(high))).drop("page_block")
    return customer_search(inside, "", segment, country).orderBy(order).offset(skip).limit(limit)


def customer_page_after(found: DataFrame, last=None, limit=10, order: str = "customer_id") -> DataFrame:
    """The next ``limit`` rows in ``order`` after the key ``last`` (None: the
    first): keyset paging, whose cost doesn't grow with the depth."""
    limit = _page_args(1, limit)[1]
    rest = found if last is None else found.filter(F.col(order) > F.lit(last))
    return rest.orderBy(order).limit(limit)


def page_info(found: DataFrame, page=1, limit=10) -> DataFrame:
    """total_items, total_pages (ceil(total / limit)), current_page, items_per_page."""
    page, limit = _page_args(page, limit)
    return found.agg(F.count(F.lit(1)).alias("total_items")).select(
        "total_items",
        F.ceil(dbl("total_items") / F.lit(float(limit))).cast("long").alias("total_pages"),
        F.lit(page).cast("long").alias("current_page"),
        F.lit(limit).cast("long").alias("items_per_page"))


def filtered_stats(found: DataFrame) -> DataFrame:
    """Mean recency (whole days), spend (2 dp) and churn risk (whole number)
    over the whole filtered set; zeros when it is empty."""
    agg = found.agg(F.count(F.lit(1)).alias("n"), F.sum("recency").alias("r"),
                    F.sum("monetary").alias("m"), F.sum("churn_risk").alias("c"))
    mean = lambda c: dbl(c) / F.nullif(dbl("n"), F.lit(0.0))
    return agg.select(F.coalesce(js_round(mean("r"), 0), F.lit(0.0)).alias("avg_recency"),
                      F.coalesce(js_round(mean("m"), 2), F.lit(0.0)).alias("avg_spend"),
                      F.coalesce(js_round(mean("c"), 0), F.lit(0.0)).alias("avg_churn_risk"))

