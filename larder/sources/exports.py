"""File exports of results, the model-choice registry and the fitted global model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.kpi import both_strategies
from larder.operators.quality import DataQualityError

CHOICE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("sku", "model_name", "reason", "segment", "strategy", "selected_at")]
    + [T.StructField("candidate_scores", T.MapType(T.StringType(), T.DoubleType()))]
)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that hold scalars only."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result as CSV (with header) or JSON part files."""
    if fmt == "csv":
        flat(df).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise DataQualityError(f"format must be csv or json, got {fmt!r}")


def save_choices(choices: DataFrame, path: str) -> None:
    choices.select(*CHOICE_SCHEMA.fieldNames()).write.mode("overwrite").json(path)


def load_choices(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CHOICE_SCHEMA).json(path)
    except Exception as error:
        raise FileNotFoundError(f"no model choices at {path}; run the selection and save it first") from error


def save_global_model(model, info: DataFrame, path: str) -> None:
    """Fitted pipeline and its one-row description (as_of, training rows, seed)."""
    model.write().overwrite().save(f"{path}/model")
    info.write.mode("overwrite").parquet(f"{path}/info")


def load_global_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/info")


# -- report tables --------------------------------------------------------------------------------


def segmentation_table(segments: DataFrame) -> DataFrame:
    rounded = [F.bround(c, 3).alias(c) for c in ("annual_value", "demand_cv", "zero_day_share")]
    return segments.select("sku", "abc", "xyz", "segment", *rounded)


def selection_table(choices: DataFrame) -> DataFrame:
    return choices.select("sku", "segment", "model_name", "reason")


def outcomes_table(comparison: DataFrame) -> DataFrame:
    return comparison.select("metric", "unit", "baseline", "candidate", "absolute_change", "improvement_pct")


def per_sku_table(per_sku: DataFrame) -> DataFrame:
    measures = ["unit_service_level", "waste_units", "total_cost"]
    both = both_strategies(per_sku, measures)
    return both.select("sku", *[F.bround(c, 2).alias(c) for c in both.columns if c != "sku"])


def report_tables(accuracy, comparison, matched, matched_waste, segments, choices, per_sku) -> dict[str, DataFrame]:
    """The seven report tables by name."""
    return {
        "table1_forecast_accuracy": accuracy,
        "table2_operational_outcomes": outcomes_table(comparison),
        "table3_matched_service_level": matched,
        "table4_matched_waste": matched_waste,
        "table5_segmentation": segmentation_table(segments),
        "table6_model_selection": selection_table(choices),
        "table7_per_sku_outcomes": per_sku_table(per_sku),
    }
