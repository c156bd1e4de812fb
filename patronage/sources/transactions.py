"""Transaction-log sources (A1-A3).

The canonical log has one row per invoice line::

    InvoiceNo string, StockCode string, Description string, Quantity long,
    InvoiceDate timestamp, UnitPrice double, CustomerID long, Country string

plus two helper columns every source adds:

* ``unit_cents`` (long): the unit price in whole units of 10**-scale, cents
  unless the column says otherwise (``functions/money.py``).  All money sums are
  integer sums, so totals are exact and independent of the summation order
  (and therefore of partitioning).
* ``line`` (long): a tie-break for "first" semantics within an invoice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.money import parsed_units, scale_of, units
from patronage.session import materialize, pin_utc

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), False),
    T.StructField("StockCode", T.StringType(), False),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.LongType(), False),
    T.StructField("InvoiceDate", T.StringType(), False),
    T.StructField("UnitPrice", T.DoubleType(), False),
    T.StructField("CustomerID", T.DoubleType(), True),
    T.StructField("Country", T.StringType(), True),
])

LOG_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
               "UnitPrice", "CustomerID", "Country", "unit_cents", "line"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_invoice_dates(df: DataFrame, fmt: str | None = None,
                        column: str = "InvoiceDate", on_error: str = "fail") -> DataFrame:
    """A2: parse the date strings.  An unparseable value ends the job, as in the
    published code; with ``on_error='null'`` it becomes NULL.  The check runs
    where the column is read; :func:`read_transactions` checks every row."""
    parsed = _timestamp(F.col(column), fmt)
    if on_error != "null":
        unread = F.raise_error(F.concat(F.lit(f"unreadable {column}: "), F.col(column))).cast("timestamp")
        parsed = F.when(F.col(column).isNotNull() & parsed.isNull(), unread).otherwise(parsed)
    return df.withColumn(column, parsed.cast("timestamp"))


def _timestamp(text: Column, fmt: str | None) -> Column:
    return (F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)).cast("timestamp")


def _given(column: str) -> Column:
    """The field as text; blank and NaN count as missing, like in the published code."""
    text = F.trim(F.col(column).cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def _whole(text: Column) -> Column:
    """A whole number, also written as 17850.0; NULL if it is none."""
    number = text.try_cast("decimal(38,10)")
    return F.when(number == F.floor(number), number.try_cast("long"))


#: Raw fields of a rejected line.
RAW = [f.name for f in TRANSACTION_SCHEMA.fields]
_RECORD = "_record"


def _csv_fields(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    """The eight documented columns as text, found by the header's names in any
    order, and ``_record``: the whole line if its number of fields is wrong.

    The parser reads full lines whatever columns a query needs
    (``columnPruning`` off); with pruned columns it cannot see a wrong line."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line)
    names = reader.csv(path).columns
    missing = [c for c in RAW if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RECORD]])
    return (reader.schema(schema).option("enforceSchema", False).option("columnPruning", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD).csv(path)
            .select(*RAW, _RECORD))


def parse_lines(raw: DataFrame, date_format: str | None = None, money_scale: int = 4) -> DataFrame:
    """A1/A2: canonical log columns of the raw fields, and ``reason``: why a line
    cannot be read, NULL for a good one (the first of: wrong number of fields,
    Quantity, InvoiceDate, UnitPrice, CustomerID).  Unreadable fields are NULL;
    missing ones are NULL too and no reason.

    Prices become whole units of 10**-``money_scale`` (exact, from the decimal
    text); a price with more decimal places is a reason, never rounded."""
    quantity, price, customer = _given("Quantity"), _given("UnitPrice"), _given("CustomerID")
    if dict(raw.dtypes)["InvoiceDate"] == "string":
        text = _given("InvoiceDate")
        date = _timestamp(text, date_format)
        bad_date = text.isNotNull() & date.isNull()
    else:
        text, date, bad_date = F.col("InvoiceDate").cast("string"), F.col("InvoiceDate").cast("timestamp"), F.lit(False)
    whole, cents, id_ = _whole(quantity), parsed_units(price, money_scale), _whole(customer)
    record = F.col(_RECORD) if _RECORD in raw.columns else F.lit(None).cast("string")
    number = price.try_cast("double")
    reason = (F.when(record.isNotNull(), F.concat(F.lit("Malformed line: "), record))
              .when(quantity.isNotNull() & whole.isNull(), F.concat(F.lit("Malformed Quantity: "), quantity))
              .when(bad_date, F.concat(F.lit("unreadable InvoiceDate: "), text))
              .when(price.isNotNull() & number.isNull(), F.concat(F.lit("Malformed UnitPrice: "), price))
              .when(price.isNotNull() & cents.isNull(),
                    F.concat(F.lit(f"UnitPrice is not in whole cents or is too large (money_scale={money_scale}): " if money_scale == 2
                                   else f"UnitPrice has more than {money_scale} decimal places or is too large: "), price))
              .when(customer.isNotNull() & id_.isNull(), F.concat(F.lit("Malformed CustomerID: "), customer)))
    return raw.select(
        F.col("InvoiceNo").cast("string").alias("InvoiceNo"),
        F.col("StockCode").cast("string").alias("StockCode"),
        F.col("Description").cast("string").alias("Description"),
        whole.alias("Quantity"), date.alias("InvoiceDate"), number.alias("UnitPrice"), id_.alias("CustomerID"),
        F.col("Country").cast("string").alias("Country"),
        units(cents, "unit_cents", money_scale),
        F.monotonically_increasing_id().alias("line"),
        reason.alias("reason"), *[F.col(c).cast("string").alias(f"raw_{c}") for c in RAW])


def _parsed(spark: SparkSession, path: str, fmt: str, date_format: str | None, encoding: str,
            money_scale: int, multi_line: bool) -> DataFrame:
    pin_utc(spark)
    raw = _csv_fields(spark, path, encoding, multi_line) if fmt == "csv" else spark.read.format(fmt).load(path)
    return parse_lines(raw, date_format, money_scale)


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      date_format: str | None = None, encoding: str = "ISO-8859-1",
                      on_error: str = "fail", money_scale: int = 2, multi_line: bool = False) -> DataFrame:
    """A1: read a transaction log (CSV with header, Latin-1) as canonical log columns.

    Other formats (``fmt='parquet'``) must carry the eight documented columns.
    By default any line that cannot be read ends every job over the log,
    whatever columns the job needs: the check of all eight fields is a filter
    of the plan.  ``on_error='null'`` reads unreadable fields as NULL;
    ``on_error='skip'`` leaves the lines out (see :func:`read_log` for both
    parts).  Blank and NaN fields are NULL.  Prices are held exactly to
    ``money_scale`` decimal places: cents by default, 4 for a log with prices
    such as 0.125 or 0.001; a price with more places is a line that cannot be read."""
    if on_error not in ("fail", "null", "skip"):
        raise ValueError("on_error is 'fail', 'null' or 'skip'")
    parsed = _parsed(spark, path, fmt, date_format, encoding, money_scale, multi_line)
    if on_error == "fail":
        parsed = parsed.where(F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("boolean")).otherwise(F.lit(True)))
    elif on_error == "skip":
        parsed = parsed.where("reason is null")
    return parsed.select(*LOG_COLUMNS)


class LogRead(NamedTuple):
    """Both parts of a log and how many lines each has (``seen.get``: lines, rejects)."""
    lines: DataFrame
    rejects: DataFrame
    seen: Observation


def read_log(spark: SparkSession, path: str, fmt: str = "csv", date_format: str | None = None,
             encoding: str = "ISO-8859-1", money_scale: int = 4, multi_line: bool = False) -> LogRead:
    """A1/A2 with rejects: one scan of the source gives the lines that can be read
    (canonical log columns) and the others (``line``, ``reason`` and the raw
    fields).  The scan is written once, split by the outcome, under
    ``spark.checkpoint.dir``; each part reads its own folder, and the counts
    are observed while it is written."""
    seen = Observation()
    parsed = _parsed(spark, path, fmt, date_format, encoding, money_scale, multi_line)
    bad = F.col("reason").isNotNull()
    raw = [f"raw_{c}" for c in RAW]
    split = (parsed.observe(seen, F.count_if(~bad).alias("lines"), F.count_if(bad).alias("rejects"))
             .select(*LOG_COLUMNS, "reason", *[F.when(bad, F.col(c)).alias(c) for c in raw], bad.alias("rejected")))
    both = materialize(split, "log", partition_by="rejected")
    lines = both.where(~F.col("rejected")).select(
        *[units(F.col(c), c, money_scale) if c == "unit_cents" else c for c in LOG_COLUMNS])
    rejects = both.where("rejected").select("line", "reason", *[F.col(c).alias(c[4:]) for c in raw])
    return LogRead(lines, rejects, seen)


def write_csv(lines: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    """A log as CSV with header: the eight documented columns, prices as plain decimals."""
    scale = scale_of(lines)
    price = (F.col("unit_cents").cast("decimal(20,0)") / F.lit(10 ** scale).cast("decimal(12,0)")).cast(f"decimal(38,{scale})")
    lines.select("InvoiceNo", "StockCode", "Description", "Quantity",
                 F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"),
                 price.cast("string").alias("UnitPrice"), "CustomerID", "Country").write.mode("overwrite").option(
        "header", True).option("encoding", encoding).csv(path)


def _minutes(col: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), col.cast("int"))


def transactions_from_star(lineitem: DataFrame, orders: DataFrame,
                           customer: DataFrame, nation: DataFrame,
                           part: DataFrame | None = None) -> DataFrame:
    """A3: map the star schema of the test data onto the transaction log.

    Fixed rules (identical in the DuckDB oracle, see FIXTURES.md):

    * InvoiceNo = o_orderkey, prefixed ``C`` when ``l_returnflag = 'R'``
    * StockCode = l_partkey; Description = p_name (only when ``part`` given)
    * Quantity = l_quantity, negated when ``l_returnflag = 'R'`` or
      ``l_suppkey % 41 = 0``
    * InvoiceDate = o_orderdate + ((o_orderkey * 37) % 840 + 360) minutes
    * unit_cents = 0 when ``l_partkey % 97 = 0`` else
      round(l_extendedprice * 100) div l_quantity
    * CustomerID = NULL when ``o_orderkey % 50 = 0`` else o_custkey
    * Country = n_name of the customer's nation

    Join plan: orders takes its customer's country first, so the customer key
    is joined at order grain and the lines meet one join only, on the order key
    (sort-merge, AQE splits skewed keys).  nation is a fixed 25-row dimension
    and is broadcast; AQE turns customer into a broadcast only when its runtime
    size is under the broadcast threshold.
    """
    pin_utc(lineitem.sparkSession)
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         "l_quantity", "l_extendedprice", "l_returnflag")
    od = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    cust = (customer.select("c_custkey", "c_nationkey")
            .join(F.broadcast(nation.select("n_nationkey", "n_name")),
                  F.col("c_nationkey") == F.col("n_nationkey"), "inner")
            .select("c_custkey", "n_name"))
    placed = od.join(cust, F.col("o_custkey") == F.col("c_custkey"), "inner")
    lines = li.join(placed, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    returned = F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast("long")
    unit_cents = F.when(F.col("l_partkey") % 97 == 0, F.lit(0).cast("long")).otherwise(
        F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)"))
    if part is not None:
        lines = lines.join(part.select("p_partkey", "p_name"),
                           F.col("l_partkey") == F.col("p_partkey"), "left")
        description = F.col("p_name")
    else:
        description = F.lit(None).cast("string")
    return lines.select(
        F.concat(F.when(returned, F.lit("C")).otherwise(F.lit("")),
                 F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        description.alias("Description"),
        F.when(returned | (F.col("l_suppkey") % 41 == 0), -qty).otherwise(qty).alias("Quantity"),
        (F.col("o_orderdate").cast("timestamp")
         + _minutes((F.col("o_orderkey") * 37) % 840 + 360)).alias("InvoiceDate"),
        (unit_cents / F.lit(100.0)).alias("UnitPrice"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
        unit_cents.alias("unit_cents"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Alternative input: purchase events as one-line invoices of quantity 1."""
    pin_utc(events.sparkSession)
    buys = events.filter(F.col("event_type") == "purchase")
    cents = F.round(F.col("value") * 100).cast("long")
    return buys.select(
        F.col("event_id").cast("string").alias("InvoiceNo"),
        F.lit("event").alias("StockCode"),
        F.lit(None).cast("string").alias("Description"),
        F.lit(1).cast("long").alias("Quantity"),
        F.col("ts").cast("timestamp").alias("InvoiceDate"),
        (cents / F.lit(100.0)).alias("UnitPrice"),
        F.col("user_id").cast("long").alias("CustomerID"),
        F.lit(None).cast("string").alias("Country"),
        cents.alias("unit_cents"),
        F.lit(1).cast("long").alias("line"),
    )


def load_log(spark: SparkSession, sf_dir: str, with_description: bool = False) -> DataFrame:
    """The transaction log derived from the star tables under ``sf_dir``."""
    tables = {name: read_table(spark, sf_dir, name)
              for name in ("lineitem", "orders", "customer", "nation")}
    part = read_table(spark, sf_dir, "part") if with_description else None
    return transactions_from_star(tables["lineitem"], tables["orders"],
                                  tables["customer"], tables["nation"], part)
