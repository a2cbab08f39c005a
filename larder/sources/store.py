"""Keyed Parquet tables: replace by key, append, read."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.kpi import KPI_KEYS
from larder.operators.ordering import recommendation_table
from larder.operators.quality import DataQualityError
from larder.operators.repair import keep_first
from larder.sources.folder import written
from larder.sources.sales import SALES_SCHEMA

# Table columns and keys.
TABLES = {
    "skus": (
        (
            "sku", "category", "shelf_life_days", "unit_cost", "pack_size", "min_order_quantity",
            "holding_cost_per_unit_per_day", "waste_cost_per_unit", "stockout_cost_per_unit", "abc", "xyz",
            "segment",
        ),
        ("sku",),
    ),
    "sales": (
        ("date", "sku", "units_sold", "temp_c", "bank_holiday", "school_holiday", "weekend", "dow", "promo"),
        ("date", "sku"),
    ),
    "sales_feed": (
        (
            "date", "sku", "units_sold", "ingest_seq", "category", "shelf_life_days", "temp_c", "bank_holiday", "school_holiday",
            "weekend", "dow", "promo",
        ),
        ("date", "sku"),
    ),
    "inventory_snapshots": (
        (
            "date", "sku", "strategy", "opening_stock", "received", "expired_units", "demand", "served",
            "stockout_units", "closing_stock", "on_order", "inventory_value", "mean_age_days",
        ),
        ("date", "sku", "strategy"),
    ),
    "forecasts": (
        (
            "run_id", "as_of", "sku", "forecast_date", "predicted_demand", "lower_bound", "upper_bound",
            "model",
        ),
        ("run_id", "sku", "forecast_date"),
    ),
    "recommendations": (
        (
            "run_id", "as_of", "sku", "model", "policy", "on_hand", "on_order", "inventory_position",
            "forecast_demand_horizon", "forecast_demand_protection", "safety_stock", "target_stock",
            "recommended_order", "order_value", "days_of_cover", "stockout_probability",
            "projected_waste_units", "risk",
        ),
        ("run_id", "sku", "as_of"),
    ),
    "recommendation_overrides": (
        ("run_id", "as_of", "sku", "recommended_order", "override_order", "reason", "recorded_at"),
        (),
    ),
    "simulated_orders": (
        ("run_id", "strategy", "sku", "ordered_on", "arrives_on", "quantity", "order_value"),
        ("run_id", "strategy", "sku", "ordered_on"),
    ),
    "simulation_runs": (
        ("run_id", "strategy", "start_date", "end_date", "config_json", "created_at"),
        ("run_id", "strategy"),
    ),
    "simulation_results": (
        ("run_id", "strategy", "metric", "value"),
        ("run_id", "strategy", "metric"),
    ),
    "model_metadata": (
        ("sku", "model_name", "reason", "segment", "strategy", "selected_at", "candidate_scores"),
        ("sku", "selected_at"),
    ),
}


def columns_of(table: str) -> list[str]:
    return list(TABLES[table][0])


def keys_of(table: str) -> list[str]:
    return list(TABLES[table][1])


def kinds_of(table: str) -> dict[str, str]:
    """Types of the columns of a sales table."""
    days = {f.name: f.dataType.simpleString() for f in SALES_SCHEMA} | {"ingest_seq": "bigint"}
    return {c: days[c] for c in columns_of(table)}


def replace_rows(old: DataFrame | None, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Union where the newest row of each key wins.

    ``version`` orders copies inside ``new`` (ties and the default fall back to all columns).  The
    choice is a ``max_by`` aggregate, so copies of one hot key combine before the shuffle.
    """
    stamped = lambda df, n: df.withColumn("_age", F.lit(n))
    rows = stamped(new, 1) if old is None else stamped(old, 0).unionByName(stamped(new, 1))
    rest = [c for c in new.columns if c not in keys]
    rank = F.struct("_age", *([version] if version else []), *rest)
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r"))
    return picked.select(*keys, "r.*").select(*new.columns)


#: Hash partitions of a table whose key holds no date.
BUCKETS = 64


def part_of(table: str) -> Column:
    """The partition of a row: the month of the first date in its key, else a bucket of the key."""
    dates = [k for k in keys_of(table) if k in ("date", "forecast_date", "as_of", "ordered_on")]
    if dates:
        return F.coalesce(F.date_format(F.col(dates[0]).cast("date"), "yyyy-MM"), F.lit("none"))
    return F.pmod(F.xxhash64(*keys_of(table)), F.lit(BUCKETS)).cast("string")


class Store:
    """Tables under one folder of the shared file system.

    A table is a list of partition folders, kept in a small numbered file; the newest number is the table.  Saving reads and writes
    only the partitions that the new rows fall in, beside the old ones, and then adds the next number in one step: a job lost half way
    leaves the last complete state, and of two writers the second starts over on what the first left.  A read scans every row once.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- the list of partition folders ---------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, table: str) -> tuple[int, dict[str, list[str]]]:
        """Newest number and its partitions; 0 and none without data.  One entry per partition, and one per batch of an append-only table."""
        files, folder = self._files(), self._path(table, "manifest")
        found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = [int(name.removesuffix(".json")) for name in found if name.endswith(".json")]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/{table}/manifest/{max(numbers):09d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _commit(self, table: str, number: int, entries: dict[str, list[str]]) -> bool:
        """Add a numbered list; False if someone else took the number."""
        jvm = self.spark._jvm
        staged = self._path(table, "manifest", f"staged-{uuid.uuid4().hex}")
        out = self._files().create(staged, False)
        out.write(json.dumps(entries, sort_keys=True).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        try:
            context.rename(staged, self._path(table, "manifest", f"{number:09d}.json"), plain)
        except Py4JJavaError as error:
            self._files().delete(staged, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def tables(self) -> list[str]:
        """Names of the tables that hold data."""
        return sorted(t for t in TABLES if self.manifest(t)[0])

    def load_table(self, table: str) -> DataFrame:
        entries = self.manifest(table)[1] if table in TABLES else {}
        if not entries:
            raise DataQualityError(f"no table {table!r}; available: {self.tables()}")
        return self.spark.read.parquet(*[p for part in sorted(entries) for p in entries[part]]).select(*columns_of(table))

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(folder)
        return folder

    def replace(self, table: str, new: DataFrame, first: str | None = None) -> None:
        """Insert or replace by the table's key; partitions without new rows are not read.

        With ``first``, a column, the row with its smallest value stays instead of the newest (a table keyed by SKU and date).
        """
        rows = written(new.select(*columns_of(table)).withColumn("part", part_of(table)))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]
        while touched:
            number, entries = self.manifest(table)
            paths = [p for part in touched for p in entries.get(part, [])]
            old = self.spark.read.parquet(*paths).select(*columns_of(table)) if paths else None
            fresh = rows.drop("part")
            if first is None:
                merged = replace_rows(old, fresh, keys_of(table))
            else:
                merged = keep_first(fresh if old is None else old.unionByName(fresh), first)
            folder = self._write(table, merged.withColumn("part", part_of(table)))
            if self._commit(table, number + 1, entries | {part: [f"{folder}/part={part}"] for part in touched}):
                break

    def append(self, table: str, new: DataFrame) -> None:
        """Add a batch of rows; nothing is replaced."""
        folder = self._write(table, new.select(*columns_of(table)).withColumn("part", F.lit("rows")))
        path = f"{folder}/part=rows"
        if not self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            return  # an empty batch
        while True:
            number, entries = self.manifest(table)
            if self._commit(table, number + 1, {"rows": [*entries.get("rows", []), path]}):
                break

    def expire(self, table: str) -> int:
        """Delete the folders that the newest list does not name, once no reader needs them; how many went."""
        number, entries = self.manifest(table)
        kept = {p.split("/data/")[1].split("/")[0] for paths in entries.values() for p in paths}
        files, folder = self._files(), self._path(table, "data")
        gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in kept] if number else []
        for path in gone:
            files.delete(path, True)
        return len(gone)

    # -- writes ----------------------------------------------------------------------------------

    def save_sku_master(self, master: DataFrame, segments: DataFrame | None = None) -> None:
        self.replace("skus", sku_rows(master, segments))

    def save_sales(self, sales: DataFrame) -> None:
        self.replace("sales", sales)

    def save_forecasts(self, forecast: DataFrame, run_id: str) -> None:
        self.replace("forecasts", forecast.withColumn("run_id", F.lit(run_id)))

    def save_recommendations(self, recs: DataFrame, run_id: str) -> None:
        self.replace("recommendations", recommendation_table(recs).withColumn("run_id", F.lit(run_id)))

    def record_overrides(self, overrides: DataFrame) -> None:
        """Append manager quantities; a negative one fails the job.  Recommendations stay untouched."""
        self.append("recommendation_overrides", checked_overrides(overrides))

    def save_replay(self, run_id: str, ledger: DataFrame, orders: DataFrame, kpis: DataFrame, start, end, config: dict | None = None) -> None:
        """Run header, daily ledger, orders and melted KPIs.  Saving a run again replaces its rows."""
        self.replace("simulation_runs", run_header(kpis, run_id, start, end, config))
        self.replace("inventory_snapshots", ledger)
        self.replace("simulated_orders", orders.withColumn("run_id", F.lit(run_id)))
        self.replace("simulation_results", result_rows(kpis, run_id))

    def save_model_metadata(self, choices: DataFrame) -> None:
        self.replace("model_metadata", metadata_rows(choices))

    # -- reads -----------------------------------------------------------------------------------

    def read(self, query: str, params: dict | None = None) -> DataFrame:
        """A parameterised query over the stored tables it names."""
        for name in TABLES:
            if re.search(rf"\b{name}\b", query) and self.manifest(name)[0]:
                self.load_table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=params or {})

    def load_overrides(self, run_id: str | None = None) -> DataFrame:
        return newest_overrides(self.load_table("recommendation_overrides"), run_id)

    def load_comparison(self) -> DataFrame:
        return run_comparison(self.load_table("simulation_runs"), self.load_table("simulation_results"))


def sku_rows(master: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """SKU table rows with segments attached where known."""
    if segments is None:
        rows = master.withColumns({c: F.lit(None).cast("string") for c in ("abc", "xyz", "segment")})
    else:
        rows = master.join(segments.select("sku", "abc", "xyz", "segment"), "sku", "left")
    return rows.select(*columns_of("skus"))


def checked_overrides(overrides: DataFrame) -> DataFrame:
    """Refuse negative quantities and stamp the time."""
    bad = F.concat(F.lit("override quantity for "), F.col("sku"), F.lit(" cannot be negative"))
    quantity = F.when(F.col("override_order") >= 0, F.col("override_order")).otherwise(F.raise_error(bad).cast("double"))
    out = overrides.withColumn("override_order", quantity)
    if "reason" not in out.columns:
        out = out.withColumn("reason", F.lit(""))
    if "recorded_at" not in out.columns:
        out = out.withColumn("recorded_at", F.current_timestamp())
    return out.select(*columns_of("recommendation_overrides"))


def run_header(kpis: DataFrame, run_id: str, start, end, config: dict | None = None) -> DataFrame:
    text = json.dumps(config or {}, default=str, sort_keys=True)
    return kpis.select(
        F.lit(run_id).alias("run_id"), "strategy", F.lit(start).cast("date").alias("start_date"),
        F.lit(end).cast("date").alias("end_date"), F.lit(text).alias("config_json"), F.current_timestamp().alias("created_at"),
    )


def result_rows(kpis: DataFrame, run_id: str) -> DataFrame:
    """KPIs as (run, strategy, metric, value) rows."""
    present = [k for k in KPI_KEYS if k in kpis.columns]
    return kpis.withColumn("run_id", F.lit(run_id)).unpivot(["run_id", "strategy"], present, "metric", "value")


def metadata_rows(choices: DataFrame) -> DataFrame:
    return choices.withColumn("candidate_scores", F.to_json("candidate_scores")).select(*columns_of("model_metadata"))


def newest_overrides(overrides: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = overrides if run_id is None else overrides.filter(F.col("run_id") == run_id)
    return rows.orderBy(F.desc("recorded_at"), "run_id", "sku")


def run_comparison(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs beside their KPIs, newest run first."""
    joined = runs.join(results, ["run_id", "strategy"])
    return joined.orderBy(F.desc("created_at"), "run_id", "metric").select("run_id", "strategy", "start_date", "end_date", "metric", "value")
