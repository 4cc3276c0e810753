"""Panel tables derived from a star schema of orders, lines, parts and suppliers.

A store is a supplier, a family is a part type; the daily target is the shipped quantity.
The panel therefore grows with the fact table: suppliers x types x days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.ranking import numbered
from tidepanel.functions.scalars import weekday0
from tidepanel.operators.clean import densify
from tidepanel.operators.splits import Fold
from tidepanel.session import saved_once
from tidepanel.sources.schemas import ENTITY

EVENT = "2001-04-16"
ROWS_PER_BUCKET = 2_000_000
TEST_DAYS = 16  # the last days of the facts are the horizon to forecast


def day(text: str):
    return F.lit(text).cast("date")


@dataclass(frozen=True)
class Warehouse:
    """Lazy views over one data folder; nothing is read until a table is used."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def bounds(self) -> tuple[dt.date, dt.date]:
        """First and last ship date: the panel spans all facts."""
        ship = F.col("l_shipdate").cast("date")
        first, last = self.table("lineitem").agg(F.min(ship), F.max(ship)).first()
        return first, last

    @property
    def train_end(self) -> str:
        return str(self.bounds[1] - dt.timedelta(days=TEST_DAYS))

    def calendar(self) -> DataFrame:
        ship = F.col("l_shipdate").cast("date")
        return self.table("lineitem").agg(F.explode(F.sequence(F.min(ship), F.max(ship))).alias("date"))

    def stores(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").cast("int").alias("store_nbr"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("state"),
                F.substring(F.lit("ABCDE"), F.col("n_nationkey") % 5 + 1, F.lit(1)).alias("type"),
                (F.col("n_nationkey") % 7).cast("int").alias("cluster"),
            )
        )

    def panel_sparse(self, buckets: int | None = None) -> DataFrame:
        """Observed store-family-days. AQE splits a part that holds many lines.

        With ``buckets`` the rows are dealt by store before they are grouped, and lie in so many partitions.
        """
        lines = (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_shipdate").cast("date").alias("date"),
                F.col("l_suppkey").cast("int").alias("store_nbr"),
                F.col("p_type").alias("family"),
                F.col("l_quantity").alias("sales"),
                F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("onpromotion"),
            )
        )
        if buckets:
            lines = lines.repartition(buckets, "store_nbr")
        return lines.groupBy("date", "store_nbr", "family").agg(
            F.sum("sales").alias("sales"), F.sum("onpromotion").cast("int").alias("onpromotion"))

    def panel(self, since: str | None = None, until: str | None = None, with_id: bool = False) -> DataFrame:
        """Dense daily panel; its days from ``since`` to ``until`` only, where given.

        Stored once per application are the observed rows, bucketed by store; a reader fills the missing
        days where the rows lie. The filled panel has many times the rows (25 at sf0.1) and is never written or shuffled here.
        """
        first, last = map(str, self.bounds)
        observed = saved_once(self.spark, ("panel", self.path), ["store_nbr"], self.panel_sparse, self._least_buckets, placed=True)
        if with_id:
            observed = self.numbered_families(observed)
        made = densify(
            observed, entity_cols=ENTITY, date_col="date", start=first, end=last,
            fill={"sales": 0.0, "onpromotion": 0}, placed=True, within=(since, until),
        )
        return self._identified(made) if with_id else made

    def _least_buckets(self) -> int:
        """Buckets that hold ``ROWS_PER_BUCKET`` rows of the filled panel: sorts and groups of a task don't grow with the tables."""
        first, last = self.bounds
        types = self.table("part").select("p_type").distinct().count()
        entities = min(self.table("supplier").count() * types, self.table("lineitem").count())
        return entities * ((last - first).days + 1) // ROWS_PER_BUCKET + 1

    def families(self) -> DataFrame:
        """Number of each part type, in order."""
        types = self.table("part").select(F.col("p_type").alias("family")).distinct()
        return numbered(types, ["family"], "_f")

    def numbered_families(self, observed: DataFrame) -> DataFrame:
        """The observed rows with ``_f``, by store again: they meet the numbers before the days are filled."""
        # Rows grow afterwards: with the number of partitions left open, AQE would merge them into too few tasks.
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self._least_buckets())
        return observed.join(self.families(), "family", "left").repartition(n, "store_nbr")

    def _identified(self, numbered_panel: DataFrame) -> DataFrame:
        """Row id from store, day and family number, each in its own digit: no two rows share one."""
        families = self.families().agg(F.count("*")).scalar()
        first, last = self.bounds
        days = (last - first).days + 1
        of_day = F.col("store_nbr").cast("bigint") * days + F.datediff("date", F.lit(first))
        row_id = of_day * families + F.col("_f")
        return numbered_panel.where(F.col("family").isNotNull()).select(
            row_id.alias("id"), *[c for c in numbered_panel.columns if c != "_f"]
        )

    def with_id(self, panel: DataFrame) -> DataFrame:
        """Row ids of a panel that is filled already; ``panel(with_id=True)`` spares its rows the join."""
        # Every family of the panel is a type of a part. An outer join, as Spark takes the size of the
        # filled panel for that of the observed rows and would send it whole to every task in an inner one.
        return self._identified(panel.where(F.col("family").isNotNull()).join(self.families(), "family", "left"))

    def train(self, with_id: bool = False, since: str | None = None) -> DataFrame:
        """The training panel; from the day ``since`` on, where given."""
        return self.panel(since, self.train_end, with_id)

    def near(self, folds: Sequence[Fold], days: int, with_id: bool = False) -> DataFrame:
        """Training panel from ``days`` days up to the first origin: on a dense panel as many rows of each entity."""
        return self.train(with_id, str(min(f.train_end for f in folds) - dt.timedelta(days=days - 1)))

    def train_days(self) -> DataFrame:
        """The dates of the training panel, which has every day of each entity."""
        return self.calendar().where(F.col("date") <= day(self.train_end))

    def test_days(self) -> DataFrame:
        return self.calendar().where(F.col("date") > day(self.train_end))

    def test(self) -> DataFrame:
        ahead = str(self.bounds[1] - dt.timedelta(days=TEST_DAYS - 1))
        return self.panel(ahead, with_id=True).drop("sales")

    def sample_submission(self) -> DataFrame:
        return self.test().select("id", F.lit(0.0).alias("sales"))

    def oil(self) -> DataFrame:
        """Weekday-only daily price with holes, from the mean order value."""
        price = (
            self.table("orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.avg("o_totalprice").alias("p"))
        )
        return (
            self.calendar()
            .where(weekday0("date") < 5)
            .join(price, "date", "left")
            .select(
                "date",
                F.when(F.dayofmonth("date") % 11 != 0, F.round(F.col("p") / 1000, 2)).alias(
                    "dcoilwtico"
                ),
            )
        )

    def transactions(self) -> DataFrame:
        return (
            self.table("lineitem")
            .where(F.col("l_shipdate") < F.date_add(day(self.train_end), 1).cast("timestamp"))
            .groupBy(
                F.col("l_shipdate").cast("date").alias("date"),
                F.col("l_suppkey").cast("int").alias("store_nbr"),
            )
            .agg(F.count(F.lit(1)).cast("int").alias("transactions"))
        )

    def holidays_events(self) -> DataFrame:
        """Busiest order days: of each month for the country, and per region and nation for their own orders.

        The latest day wins a tie; the number of orders that day gives the kind of event.
        """
        day_ = F.col("o_orderdate").cast("date")
        daily = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey", day_.alias("date")).agg(F.count("*").alias("n"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        places = F.array(*[
            F.struct(F.lit(level).alias("locale"), place.alias("locale_name"))
            for level, place in (("National", F.lit("Country")), ("Regional", F.col("r_name")), ("Local", F.col("n_name")))
        ])
        per_place = daily.select("date", "n", F.explode(places).alias("p")).groupBy("p.locale", "p.locale_name", "date").agg(F.sum("n").alias("n"))
        top = per_place.groupBy("locale", "locale_name", F.trunc("date", "month").alias("_month")).agg(
            F.max(F.struct("n", "date")).alias("top"))
        kinds = F.array(*map(F.lit, ["Holiday", "Transfer", "Bridge", "Work Day", "Additional"]))
        n = F.col("top.n")
        return top.select(
            F.col("top.date").alias("date"), kinds[(n % 5).cast("int")].alias("type"), "locale", "locale_name",
            F.concat(n.cast("string"), F.lit(" orders")).alias("description"), (n % 4 == 0).alias("transferred"),
        )

    def extras(self) -> dict[str, DataFrame]:
        return {
            "oil": self.oil(),
            "holidays_events": self.holidays_events(),
            "stores": self.stores(),
            "transactions": self.transactions(),
        }
