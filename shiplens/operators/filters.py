"""Row filters (null-safe: a NULL predicate drops the row, as in pandas)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.config import CORPORATE_SEGMENT, SHIPPED_STATUSES, USCA_MARKET


def shipped_status(df: DataFrame, statuses=SHIPPED_STATUSES) -> DataFrame:
    """Keep lines whose order status is one of the shipped statuses."""
    return df.where(F.col("order_status").isin(*statuses))


def failed_orders(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_cancelled") == 1)


def market(df: DataFrame, name: str = USCA_MARKET) -> DataFrame:
    return df.where(F.col("market") == name)


def segment(df: DataFrame, name: str = CORPORATE_SEGMENT) -> DataFrame:
    return df.where(F.col("customer_segment") == name)


def non_null_keys(df: DataFrame, keys) -> DataFrame:
    """Drop rows with a NULL group key (pandas ``groupby`` drops them)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)
