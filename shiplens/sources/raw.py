"""Raw order-line CSV ingest.

The export has 53 text columns; 16 are used. The file is read with all
columns as strings (no inference pass over the data), the used columns are
selected by header name,
renamed to snake_case once and cast without raising, so one bad value gives
NULL instead of failing the job. Rows whose number of fields differs from the
header's are set aside in ``MALFORMED`` and counted; dates are parsed straight
to zoneless timestamps, so the session's time zone plays no part.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiplens.config import RAW_DATE_FORMAT

# Raw header -> (our name, Spark type). "ts" = timestamp text in RAW_DATE_FORMAT.
# Header names of the source export.
RAW_COLUMNS = {
    "Order Id": ("order_id", "bigint"),
    "Order Item Id": ("line_key", "string"),
    "order date (DateOrders)": ("order_ts", "ts"),
    "shipping date (DateOrders)": ("ship_ts", "ts"),
    "Order Status": ("order_status", "string"),
    "Delivery Status": ("delivery_status", "string"),
    "Days for shipping (real)": ("real_days", "int"),
    "Days for shipment (scheduled)": ("sched_days", "int"),
    "Late_delivery_risk": ("late_risk", "int"),
    "Shipping Mode": ("shipping_mode", "string"),
    "Order Region": ("order_region", "string"),
    "Market": ("market", "string"),
    "Customer Segment": ("customer_segment", "string"),
    "Category Name": ("category_name", "string"),
    "Order Item Quantity": ("qty", "int"),
    "Sales": ("sales", "double"),
}


#: Holds the text of a row that does not fit the header, else NULL.
MALFORMED = "_malformed"


def csv_options(encoding: str = "ISO-8859-1", multi_line: bool = False) -> dict:
    """Options for quoted CSV (a quote inside quotes is doubled). Every file's
    header must list the schema's columns in its order; a file that doesn't
    fails the read. Whole rows are parsed (no column pruning): a row's width
    shows only then. ``multi_line`` admits line breaks inside quotes."""
    return {"header": True, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": multi_line,
            "enforceSchema": False, "columnPruning": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}


def raw_schema(header: list[str]) -> str:
    return ", ".join(f"`{h}` string" for h in [*header, MALFORMED])


def read_raw_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                 multi_line: bool = False, row_numbers: bool = False) -> DataFrame:
    """Raw export as string columns (header row, latin-1 by default) plus
    ``MALFORMED``. ``multi_line``: line breaks inside quotes, still read by many
    tasks per file (``quoted_records``). ``row_numbers``: plus ``ROW_NO``."""
    options = csv_options(encoding, multi_line)
    header = spark.read.options(**options).csv(path).columns
    if not multi_line:
        raw = spark.read.options(**options).schema(raw_schema(header)).csv(path)
        return _numbered(raw) if row_numbers else raw
    if row_numbers:
        raise ValueError("row numbers are not given to exports with line breaks inside quotes")
    records = quoted_records(spark, path, encoding)
    row = F.from_csv("record", raw_schema(header), {k: str(v) for k, v in options.items() if k not in ("header", "enforceSchema", "encoding")})
    names = F.array(*[F.lit(h) for h in header])
    parsed = records.select("file", "is_header", row.alias("r"))
    same = F.array(*[F.col(f"r.`{h}`") for h in header]) == names
    wrong = F.raise_error(F.concat(F.lit("the header of "), "file", F.lit(" differs from the first file's")))
    return (parsed.where(F.when(~F.col("is_header"), True).when(same, False).otherwise(wrong.cast("boolean")))
            .select("r.*"))


#: Most lines of a split whose quotes are counted one after the other.
UNIT_LINES = 1 << 14


def quoted_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file, is_header, record): the records of CSV files with line breaks inside
    quotes, each file read by as many tasks as it has splits.

    Files are read as lines. A line that starts after an odd number of quotes is
    inside a field: whether it does follows from the parity of the quotes of each
    unit (``UNIT_LINES`` lines of a split at most, so that a task's memory does not
    grow with the splits), summed over the units before it, and of the lines before
    it in its unit. Lines that are whole records pass through; only the lines of
    broken records are grouped and joined again. Quotes must follow the usual rule (they
    enclose a field, and are doubled inside one); a file that ends inside quotes
    fails the read. Lines end in a line feed, with or without carriage return.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("no"), F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    lines = lines.withColumns({
        "odd": F.pmod(F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit(""))), F.lit(2)),
        "block": F.floor(F.col("no") / F.lit(UNIT_LINES))})

    # One row per unit: its number in its file, quotes before it, and whether the file's quotes pair up.
    own = ["file", "split", "block"]
    in_file = Window.partitionBy("file").orderBy("split", "block")
    open_quotes = F.raise_error(F.concat(F.lit("quotes are not closed in "), "file")).cast("int")
    units = lines.groupBy(*own).agg(F.sum("odd").alias("odd"))
    units = units.select(*own, F.row_number().over(in_file).alias("unit"),
                         F.coalesce(F.sum("odd").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
                         (F.sum("odd").over(Window.partitionBy("file")) % 2).alias("unpaired"))
    units = units.select(*own, "unit", F.when(F.col("unpaired") == 1, open_quotes).otherwise(F.col("ahead") % 2).alias("ahead"))

    in_unit = Window.partitionBy(*own).orderBy("no")
    ahead = F.coalesce(F.sum("odd").over(in_unit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(units, own).withColumn("starts", (F.col("ahead") + ahead) % 2 == 0)
    upto = in_unit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("number", F.count(F.when(F.col("starts"), 1)).over(upto))  # 0: begun in an earlier unit
    whole = F.col("starts") & (F.col("odd") == 0)
    first = (F.col("unit") == 1) & (F.col("number") == 1)
    one = placed.where(whole).select("file", first.alias("is_header"), F.col("line").alias("record"))

    # The record that is open at a unit's start is the last one begun before it.
    begun = placed.groupBy("file", "unit").agg(F.max("number").alias("records"))
    some = F.col("records") > 0
    before = Window.partitionBy("file").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    owner = begun.select("file", "unit",
                         F.last(F.when(some, F.col("unit")), ignorenulls=True).over(before).alias("owner"),
                         F.last(F.when(some, F.col("records")), ignorenulls=True).over(before).alias("last"))
    broken = placed.where(~whole).join(owner, ["file", "unit"])
    here = F.col("number") > 0
    parts = broken.select("file", F.when(here, F.col("unit")).otherwise(F.col("owner")).alias("owner"),
                          F.when(here, F.col("number")).otherwise(F.col("last")).alias("number"), "unit", "no", "line")
    joined = parts.groupBy("file", "owner", "number").agg(F.array_sort(F.collect_list(F.struct("unit", "no", "line"))).alias("lines"))
    joined = joined.select("file", ((F.col("owner") == 1) & (F.col("number") == 1)).alias("is_header"),
                           F.array_join("lines.line", "\n").alias("record"))
    # Where lines end in a carriage return too, a break inside quotes is read as a line feed.
    text = F.col("record")
    text = F.when(text.endswith("\r"), F.replace(F.left(text, F.length(text) - 1), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    return one.unionByName(joined).withColumn("record", text).where(F.col("record") != "")


#: Place of a row in its export: files by path, rows by place in the file.
ROW_NO = "_row_no"


def _numbered(raw: DataFrame) -> DataFrame:
    """+ ``ROW_NO``, from 0: the rows of all splits before the row's own, counted,
    and its place there. It depends on the files alone, not on how they are split."""
    marked = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"),
                        F.monotonically_increasing_id().alias("__no"))
    splits = marked.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("__rows"), F.min("__no").alias("__first"))
    before = Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    return (marked.join(splits, ["__file", "__split"])
            .withColumn(ROW_NO, F.col("__before") + F.col("__no") - F.col("__first"))
            .drop("__file", "__split", "__no", "__before", "__first"))


# Candidate formats of the date columns, the commonest first.
DATE_FORMATS = ("M/d/yyyy H:mm", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd H:mm", "yyyy/M/d H:mm",
                "d.M.yyyy H:mm", "M-d-yyyy H:mm", "d-M-yyyy H:mm")


def infer_date_format(raw: DataFrame, candidates: tuple[str, ...] = DATE_FORMATS, min_share: float = 0.99) -> str:
    """The format that at least ``min_share`` of all non-empty dates of the export
    fit, voted in one pass over every row. Fails if none does, or if two do that
    read some date differently (days before or after months, none above 12)."""
    dates = [header for header, (_, kind) in RAW_COLUMNS.items() if kind == "ts"]
    if MALFORMED in raw.columns:
        raw = raw.where(F.col(MALFORMED).isNull())
    texts = raw.select(F.explode(F.array(*[F.col(f"`{h}`") for h in dates])).alias("text")).where(F.trim("text") != "")
    # Only what has a format's shape is parsed: a failed parse costs many times a good one.
    shaped = [parse_raw_ts(F.col("text"), c) if (shape := date_shape(c)) is None
              else F.when(F.col("text").rlike(shape), parse_raw_ts(F.col("text"), c)) for c in candidates]
    read = texts.select([p.alias(f"p{i}") for i, p in enumerate(shaped)])
    pairs = list(combinations(range(len(candidates)), 2))
    votes = read.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"p{i}").alias(f"n{i}") for i in range(len(candidates))],
                     *[F.count(F.when(F.col(f"p{i}") != F.col(f"p{j}"), 1)).alias(f"d{i}_{j}") for i, j in pairs]).first()
    counts = {c: votes[f"n{i}"] for i, c in enumerate(candidates)}
    fit = [i for i, c in enumerate(candidates) if votes["n"] and counts[c] >= min_share * votes["n"]]
    if not fit:
        raise ValueError(f"no date format fits the {votes['n']} dates: {counts}")
    if clash := [(candidates[i], candidates[j]) for i, j in pairs if i in fit and j in fit and votes[f"d{i}_{j}"]]:
        raise ValueError(f"the dates fit several formats with different meanings: {clash}")
    return candidates[max(fit, key=lambda i: (counts[candidates[i]], -i))]


#: Numbers that a field can hold, by its letters; signs and leading zeros are left to the parser.
_FIELDS = {"M": "0*(?:1[0-2]|[1-9])", "d": "0*(?:3[01]|[12][0-9]|[1-9])", "H": "0*(?:2[0-3]|1?[0-9])"}


def date_shape(date_format: str) -> str | None:
    """A regular expression found in every text that parses in the format (in others
    too: it rules texts out). None for formats with other than plain numbers."""
    if re.search(r"[^yMdHms\W_]|['\[\]{}#]", date_format):
        return None
    parts = []
    for run in re.findall(r"([A-Za-z])(\1*)|(.)", date_format):
        letter, more, other = run
        width = len(letter + more)
        if other:
            parts.append(re.escape(other))
        elif width == 1:
            parts.append("[+-]?" + _FIELDS.get(letter, "[0-9]+"))
        elif letter == "y" and width > 2:
            parts.append(f"[+-]?[0-9]{{{width},}}")
        elif width == 2:
            parts.append("[0-9]{2}")
        else:
            return None
    return "(?<![0-9])" + "".join(parts)


def parse_raw_ts(text: Column, date_format: str = RAW_DATE_FORMAT) -> Column:
    """Raw date text -> timestamp_ntz; NULL when it does not parse."""
    one = F.from_csv(text, "ts timestamp_ntz", {"timestampNTZFormat": date_format, "sep": "\u0001"})
    return F.when(text.isNotNull(), one["ts"])


def _typed(raw: Column, kind: str, date_format: str) -> Column:
    if kind == "string":
        return raw
    if kind == "ts":
        return parse_raw_ts(raw, date_format)
    return raw.try_cast(kind)


def typed_order_lines(raw: DataFrame, date_format: str = RAW_DATE_FORMAT) -> DataFrame:
    """Select, rename and type the used columns of the raw export's whole rows."""
    if MALFORMED in raw.columns:
        raw = raw.where(F.col(MALFORMED).isNull())
    kept = [ROW_NO] if ROW_NO in raw.columns else []
    return raw.select([
        _typed(F.col(f"`{header}`"), kind, date_format).alias(name)
        for header, (name, kind) in RAW_COLUMNS.items()
    ] + kept)


def ingest_rejects(raw: DataFrame, date_format: str = RAW_DATE_FORMAT) -> DataFrame:
    """One row: raw and malformed rows; per typed column, how many non-empty
    values of the other rows failed to parse."""
    return raw.agg(*reject_counts(raw, date_format))


def reject_counts(raw: DataFrame, date_format: str = RAW_DATE_FORMAT) -> list[Column]:
    """The aggregates of ``ingest_rejects``, to be taken alone or observed on the
    way of the rows."""
    whole = F.col(MALFORMED).isNull() if MALFORMED in raw.columns else F.lit(True)
    checks = [F.count(F.when(~whole, 1)).alias("malformed_rows")]
    for header, (name, kind) in RAW_COLUMNS.items():
        if kind == "string":
            continue
        src = F.col(f"`{header}`")
        bad = whole & src.isNotNull() & (F.trim(src) != "") & _typed(src, kind, date_format).isNull()
        checks.append(F.count(F.when(bad, 1)).alias(f"rejected_{name}"))
    return [F.count(F.lit(1)).alias("raw_rows"), *checks]


def rejected_rows(raw: DataFrame, date_format: str = RAW_DATE_FORMAT) -> DataFrame:
    """(line_key, reasons array<string>, row_text): every raw row that is malformed
    or has a value that does not parse, with the columns at fault."""
    whole = F.col(MALFORMED).isNull() if MALFORMED in raw.columns else F.lit(True)
    reasons = [F.when(~whole, F.lit("malformed"))]
    for header, (name, kind) in RAW_COLUMNS.items():
        if kind != "string":
            src = F.col(f"`{header}`")
            bad = whole & src.isNotNull() & (F.trim(src) != "") & _typed(src, kind, date_format).isNull()
            reasons.append(F.when(bad, F.lit(name)))
    text = F.to_json(F.struct(*[F.col(f"`{h}`") for h in RAW_COLUMNS]))
    if MALFORMED in raw.columns:
        text = F.coalesce(MALFORMED, text)
    return (raw.select(F.when(whole, F.col("`Order Item Id`")).alias("line_key"),
                       F.array_compact(F.array(*reasons)).alias("reasons"), text.alias("row_text"))
            .where(F.size("reasons") > 0))
