"""Series and messy texts derived from the given tables.

Raw orders meet the one or two customer columns that a panel needs and are then
aggregated to (group, month). That aggregate combines on the map side, so what is
shuffled for it is a few rows a task. The join needs no shuffle where Spark finds the
customer columns small enough to send around; where it does shuffle, adaptive
execution splits a customer with a large share of all orders.
"""

from pyspark.sql import functions as F

from lunario.fixed import MONTH_NAMES
from lunario.functions.calendar import month_start
from lunario.functions.columns import computed_once
from lunario.sources.delimited import cells_long, parse_cells

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# One input file per customer group (c_nationkey % 4); between them they use
# every metric group and scope.
FILES = [
    "Contratos desde 1995 por sector.csv",
    "Parados desde 1995 por sector.csv",
    "Afiliados desde 1995 estatal.csv",
    "P. contratadas desde 1995 estatal.csv",
]


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark, sf):
    """Order month and value in cents."""
    return (
        table(spark, sf, "orders")
        .select(
            "o_custkey",
            month_start(F.col("o_orderdate")).alias("ds"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        )
    )


def national(spark, sf):
    """T1: one national series of monthly order counts (and amounts)."""
    return (
        _orders(spark, sf)
        .groupBy("ds")
        .agg(F.count(F.lit(1)).cast("double").alias("y"), F.sum("cents").alias("cents"))
        .select(F.lit("total").alias("series"), "ds", "y", (F.col("cents") / 100.0).alias("amount"))
    )


def _by_customer(spark, sf, *columns):
    """Orders with columns of their customer."""
    customer = table(spark, sf, "customer").select("c_custkey", *columns)
    joined = _orders(spark, sf).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("ds", "cents", *columns, F.lit(1).alias("orders"))


def panel_5(spark, sf):
    """T2: monthly order counts by customer segment."""
    return (
        _by_customer(spark, sf, "c_mktsegment")
        .groupBy(F.col("c_mktsegment").alias("series"), "ds")
        .agg(F.sum("orders").cast("double").alias("y"))
    )


def amounts_5(spark, sf):
    """T2 with the value of the orders instead of their number."""
    return (
        _by_customer(spark, sf, "c_mktsegment")
        .groupBy(F.col("c_mktsegment").alias("series"), "ds")
        .agg((F.sum("cents") / 100.0).alias("y"))
    )


def panel_25(spark, sf):
    """T3: monthly order counts by nation name; joined after aggregating by key."""
    by_key = _by_customer(spark, sf, "c_nationkey").groupBy("c_nationkey", "ds").agg(F.sum("orders").alias("n"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        by_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("series"), "ds")
        .agg(F.sum("n").cast("double").alias("y"))
    )


def masked_panel(spark, sf):
    """T6: T2 with values removed on a fixed pattern of months."""
    hit = (F.month("ds") * 7 + F.length("series")) % 10 == 0
    return panel_5(spark, sf).withColumn("y", F.when(~hit, F.col("y")))


def wide_5(spark, sf):
    """T2 as a wide table: month and one column per segment."""
    return panel_5(spark, sf).groupBy("ds").pivot("series", SEGMENTS).agg(F.first("y"))


def block_observations(spark, sf):
    """Observations of one file with 60 value columns and one with 5."""
    monthly = _orders(spark, sf)

    def one(file_id, width):
        block = (F.col("o_custkey") % width).cast("int")
        return (
            monthly.groupBy(block.alias("block"), "ds")
            .agg(F.count(F.lit(1)).cast("double").alias("y"))
            .select(
                F.lit(file_id).alias("file_id"),
                F.concat(F.lit("b"), F.col("block")).alias("series"),
                (F.col("block") + 1).alias("col_pos"),
                F.lit(width).alias("n_series"),
                "ds",
                "y",
            )
        )

    return one("Contratos desde 1995 por bloque.csv", 60).unionByName(
        one("Contratos desde 1995 por sector.csv", 5)
    )


def date_text(ds, style):
    """A month written in one of seven styles."""
    names = list(MONTH_NAMES)
    short = F.element_at(F.array(*[F.lit(n) for n in names[:12]]), F.month(ds))
    full = F.element_at(F.array(*[F.lit(n) for n in names[12:]]), F.month(ds))
    year = F.date_format(ds, "yyyy")
    return (
        F.when(style == 0, F.date_format(ds, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(ds, "dd/MM/yyyy"))
        .when(style == 2, F.date_format(ds, "MM/yyyy"))
        .when(style == 3, F.date_format(ds, "MM-yyyy"))
        .when(style == 4, F.concat(F.upper(full), F.lit(" DE "), year))
        .when(style == 5, F.concat(short, F.lit(" "), year))
        .otherwise(F.concat(short, F.lit("-"), F.date_format(ds, "yy")))
    )


def number_text(cents, style):
    """An amount in cents written in one of four styles."""
    units, rest = F.expr("cents div 100"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    grouped = F.translate(F.format_number(units, 0), ",", ".")
    whole = F.translate(F.format_number(F.bround(F.col("cents") / 100.0, 0), 0), ",", ".")
    return (
        F.when(style == 0, F.concat(grouped, F.lit(","), rest))
        .when(style == 1, F.concat(units.cast("string"), F.lit(","), rest))
        .when(style == 2, F.concat(units.cast("string"), F.lit("."), rest))
        .otherwise(whole)
    )


def messy_orders(spark, sf):
    """T4: order date and price as messy text beside the truth."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("ds_true"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    texts = {
        "fecha_raw": date_text(F.col("ds_true"), key % 7),
        "valor_raw": number_text(F.col("cents"), key % 4),
    }
    return computed_once(orders, texts).select("o_orderkey", "fecha_raw", "valor_raw")


def file_of_group(group):
    return F.element_at(F.array(*[F.lit(f) for f in FILES]), group + 1)


def wide_text(spark, sf):
    """T5: rows of the input files as text, one column per segment.

    Values are whole amounts; one in seven is marked confidential.
    """
    group = (F.col("c_nationkey") % 4).alias("grp")
    amounts = (
        _by_customer(spark, sf, "c_nationkey", "c_mktsegment")
        .groupBy(group, "ds")
        .pivot("c_mktsegment", SEGMENTS)
        .agg(F.expr("sum(cents) div 100"))
    )
    month = F.month("ds")

    def cell(name, i):
        amount = F.col(name)
        written = (
            F.when(month % 3 == 0, F.translate(F.format_number(amount, 0), ",", "."))
            .when(month % 3 == 1, F.concat(amount.cast("string"), F.lit(",5")))
            .otherwise(amount.cast("string"))
        )
        confidential = (month + F.year("ds") + i) % 7 == 0
        return F.when(confidential | amount.isNull(), "'-").otherwise(written).alias(name)

    return amounts.select(
        "grp",
        "ds",
        date_text(F.col("ds"), (month + F.col("grp")) % 6).alias("fecha_raw"),
        *[cell(n, i) for i, n in enumerate(SEGMENTS)],
    )


def file_cells(spark, sf):
    """Observations of the four input files, without writing them."""
    rows = wide_text(spark, sf).select(
        file_of_group(F.col("grp")).alias("file_id"),
        F.struct(
            F.lit(0).cast("bigint").alias("block"),
            F.expr("cast(year(ds) * 12 + month(ds) as bigint)").alias("line"),
        ).alias("pos"),
        F.array(F.lit("Fecha"), *[F.lit(n) for n in SEGMENTS]).alias("header"),
        F.array("fecha_raw", *SEGMENTS).alias("cells"),
    )
    return parse_cells(cells_long(rows))


def series_files(spark, sf):
    """One file name per customer, with metric, start year, scope and a model to run."""
    key = F.col("c_custkey")
    metrics = ["Parados", "Afiliados", "Demandantes", "Contratos", "P. contratadas", "Personas Contratadas", "Empleo"]
    metric = F.element_at(F.array(*[F.lit(m) for m in metrics]), (key % 7 + 1).cast("int"))
    scope = F.when(key % 4 == 0, F.lit("estatal")).otherwise(F.concat(F.lit("por "), F.col("c_mktsegment")))
    horizon = F.when(key % 5 == 0, F.lit(" 2025-2028")).otherwise(F.lit(""))
    since = F.when(key % 9 == 8, F.lit(" ")).otherwise(F.lit(" desde "))
    name = F.concat(metric, since, (key % 30 + 1990).cast("string"), F.lit(" "), scope, horizon, F.lit(".csv"))
    models = ["NP", "LSTM", "XGBoost", "ARIMA"]
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        name.alias("file_name"),
        F.element_at(F.array(*[F.lit(m) for m in models]), (F.floor(key / 7) % 4 + 1).cast("int")).alias("model"),
    )
