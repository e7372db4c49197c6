"""Distinct links over many rows, in order of first occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_occurrences(found: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key and link: ``(key, url, place)``, place being the first order struct.

    Nothing is gathered per key, so a key with most of the links is no burden.
    """
    return found.groupBy(key, "url").agg(F.min(F.struct(*order)).alias("place"))


def gathered(firsts: DataFrame, key: str) -> DataFrame:
    """Links ``(key, urls)`` as one array in order; for keys whose links are few by construction."""
    listed = F.array_sort(F.collect_list(F.struct("place", "url")))
    return firsts.groupBy(key).agg(F.transform(listed, lambda item: item["url"]).alias("urls"))


def numbered(urls: Column, *prefix: Column) -> Column:
    """Structs of the given order columns, position and link, to explode with ``inline``."""
    return F.transform(urls, lambda url, i: F.struct(*prefix, i.alias("pos"), url.alias("url")))
