"""Rate-card and zone-card lookups.

A card given as a dict (the default) becomes a literal map expression: no
join, no exchange, evaluated inside whole-stage codegen. A card given as a
DataFrame (e.g. loaded from a file) is left-joined; Spark broadcasts it when
its bytes are below ``spark.sql.autoBroadcastJoinThreshold`` and plans an
ordinary shuffle join beyond. A card that lists a key twice fails the query:
it would multiply lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.config import BASE_RATE, DEFAULT_COST, ZONE_FACTOR


def literal_lookup(card: dict, key: Column) -> Column:
    """``card[key]`` as a column; NULL for a missing or NULL key."""
    pairs = [x for k, v in card.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def _card(spark: SparkSession, card: dict, key: str, value: str) -> DataFrame:
    """A dict as a table made of literals. Its size is known when a query is planned,
    unlike that of rows sent from Python: a join with it never deals the lines by
    the card's few keys."""
    if not card:
        return spark.createDataFrame([], f"{key} string, {value} double")
    rows = [F.struct(F.lit(k).cast("string").alias(key), F.lit(v).cast("double").alias(value)) for k, v in card.items()]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def rate_card(spark: SparkSession, card: dict = BASE_RATE) -> DataFrame:
    return _card(spark, card, "shipping_mode", "base_rate")


def zone_card(spark: SparkSession, card: dict = ZONE_FACTOR) -> DataFrame:
    return _card(spark, card, "order_region", "zone_factor")


def unique_card(dim: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The card as (``__k``, ``out``), one row per key; a repeated key raises."""
    repeated = F.raise_error(F.concat(F.lit(f"card lists {key} more than once: "), F.col("__k")))
    card = dim.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(value).alias("__v"))
    return card.select("__k", F.when(F.col("__n") > 1, repeated.cast("double")).otherwise(F.col("__v")).alias(out))


def _join_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, out: str) -> DataFrame:
    d = unique_card(dim, key, value, out)
    return df.join(d, df[key] == d["__k"], "left").drop("__k")


def with_base_rate(df: DataFrame, card=None) -> DataFrame:
    """+ ``base_ship_rate`` by shipping mode; unknown mode -> NULL."""
    card = DEFAULT_COST.base_rate if card is None else card
    if isinstance(card, DataFrame):
        return _join_lookup(df, card, "shipping_mode", "base_rate", "base_ship_rate")
    return df.withColumn("base_ship_rate", literal_lookup(card, F.col("shipping_mode")))


def with_zone_factor(df: DataFrame, card=None, default: float | None = None) -> DataFrame:
    """+ ``zone_factor`` by order region; unknown region -> ``default``."""
    card = DEFAULT_COST.zone_factor if card is None else card
    default = DEFAULT_COST.default_zone_factor if default is None else default
    if isinstance(card, DataFrame):
        out = _join_lookup(df, card, "order_region", "zone_factor", "zone_factor")
        return out.withColumn("zone_factor", F.coalesce("zone_factor", F.lit(default)))
    return df.withColumn(
        "zone_factor",
        F.coalesce(literal_lookup(card, F.col("order_region")), F.lit(default)))
