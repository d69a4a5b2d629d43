"""Reshapes: total rows and display labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_total_row(detail: DataFrame, key: str, label: str, totals, flag: str = "is_total") -> DataFrame:
    """Append a total row to a small aggregated table, in one lineage.

    Each detail row is exploded into itself and its contribution to the
    total row (``totals``: columns summed into the total; other columns are
    NULL there), then the rows are re-aggregated. The detail plan runs once:
    no second branch re-reads or re-aggregates the input, whatever columns
    the total needs. The re-aggregation sees at most two rows per detail row.
    """
    values = [c for c in detail.columns if c != key]
    types = dict(detail.dtypes)
    own = F.struct(F.col(key).alias(key), F.lit(False).alias(flag),
                   *[F.col(c).alias(c) for c in values])
    tot = F.struct(F.lit(label).alias(key), F.lit(True).alias(flag),
                   *[(F.col(c) if c in totals else F.lit(None).cast(types[c])).alias(c) for c in values])
    rows = detail.select(F.explode(F.array(own, tot)).alias("r")).select("r.*")
    return rows.groupBy(key, flag).agg(*[F.sum(c).cast(types[c]).alias(c) for c in values])


def relabel(df: DataFrame, labels: dict[str, str], keep_unlabelled: bool = False) -> DataFrame:
    """Rename columns to display labels (for CSV / spreadsheet export).

    Columns without a label are dropped unless ``keep_unlabelled``.
    """
    cols = [c for c in df.columns if c in labels or keep_unlabelled]
    return df.select(*cols).withColumnsRenamed({c: labels[c] for c in cols if c in labels})
