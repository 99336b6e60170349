"""A fitted model as a whole: baseline, base regressors with weights, segment and county experts with blends; saved, loaded, applied.

Everything that was learned is a table or an MLlib pipeline in one folder that all executors share, so a bundle is applied to a
table of any size or to one record in the same way.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.operators.baseline import KEYS, LEVELS, group_states, with_baseline
from parcela.operators.experts import applied, filled_medians, products, solved
from parcela.operators.listing_features import segments
from parcela.operators.models import preparation, regressors
from parcela.operators.state import durable

#: What a record is scored by, beside the columns of the baseline.
PENALTY = 10.0


@dataclass
class Bundle:
    """The parts of a fitted model. Experts are ridges by group; a blend of 0 leaves a group alone."""

    numeric: list[str]
    categorical: list[str]
    baseline: DataFrame
    models: dict[str, PipelineModel]
    weights: dict[str, float]
    experts: dict[str, DataFrame] = field(default_factory=dict)
    blends: dict[str, dict[str, float]] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with baseline, the base prediction and the final one: segments first (the last one that a listing is in and that is blended), then counties."""
        had = "fold" in df.columns
        out = with_baseline(df.withColumnRenamed("fold", "_fold").withColumn("fold", F.lit(0)), self.baseline).drop("fold")
        out = out.withColumnRenamed("_fold", "fold") if had else out
        base, parts = F.col("location_baseline_m2"), []
        for name, model in self.models.items():
            kept = [*out.columns]
            out = model.transform(out).withColumn(f"pred_{name}", F.greatest(F.lit(0.0), base * F.exp("prediction"))).select(*kept, f"pred_{name}")
            parts.append(F.col(f"pred_{name}") * self.weights[name])
        out = out.withColumn("pred_base", sum(parts, F.lit(0.0))).withColumn("pred_final", F.col("pred_base"))
        for name in (n for n in ("segment", "county") if n in self.experts):
            group = self._segment(out) if name == "segment" else F.col("county")
            by = F.create_map(*(x for k, v in self.blends[name].items() for x in (F.lit(k), F.lit(v)))) if self.blends[name] else F.create_map().cast("map<string,double>")
            out = applied(out.withColumn("_group", group), self.experts[name].withColumnRenamed("group", "_group"), ["_group"], self.numeric, ["ridge"])
            blend, expert = F.coalesce(F.element_at(by, F.col("_group")), F.lit(0.0)), F.greatest(F.lit(0.0), base * F.exp("z_ridge"))
            out = out.withColumn("pred_final", F.when((blend > 0) & expert.isNotNull(), (1 - blend) * F.col("pred_final") + blend * expert).otherwise(F.col("pred_final"))).drop("_group", "z_ridge")
        return out

    def _segment(self, df: DataFrame) -> Column:
        """The last segment of a listing that is blended, `none` where there is none."""
        used = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in segments(df).items() if self.blends["segment"].get(n, 0.0) > 0]
        return F.coalesce(*reversed(used), F.lit("none"))

    def save(self, folder: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{folder}/models/{name}")
        self.baseline.write.mode("overwrite").parquet(f"{folder}/baseline")
        for name, state in self.experts.items():
            state.write.mode("overwrite").parquet(f"{folder}/experts/{name}")
        spark = self.baseline.sparkSession
        facts = json.dumps({"numeric": self.numeric, "categorical": self.categorical, "weights": self.weights, "blends": self.blends, "experts": list(self.experts)})
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")


def load(spark: SparkSession, folder: str) -> Bundle:
    facts = json.loads(spark.read.text(f"{folder}/facts").first()["value"])
    models = {n: PipelineModel.load(f"{folder}/models/{n}") for n in facts["weights"]}
    experts = {n: spark.read.parquet(f"{folder}/experts/{n}") for n in facts["experts"]}
    return Bundle(facts["numeric"], facts["categorical"], spark.read.parquet(f"{folder}/baseline"), models, facts["weights"], experts, facts["blends"])


def fit(
    df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str], weights: Mapping[str, float], segment_blends: Mapping[str, float], county_blends: Mapping[str, float],
) -> Bundle:
    """The bundle of all rows, with weights and blends that were settled out of fold (`ensemble_weights`, the reports of the expert layers)."""
    rows = durable(df.where(F.col(target) > 0).drop("fold"))
    state = durable(group_states(rows.withColumn("fold", F.lit(-1)), target, {str(k): keys for k, (keys, _) in LEVELS.items()}, 1))
    data = durable(with_baseline(rows.withColumn("fold", F.lit(0)), state).drop("fold").withColumn("_z", F.ln(F.col(target) / F.col("location_baseline_m2"))))
    models = {n: Pipeline(stages=[*preparation(numeric, categorical), regressors()[n]]).fit(data) for n in names}

    def ridges(grouped: DataFrame) -> DataFrame:
        return durable(solved(products(grouped, ["group"], numeric, "_z"), filled_medians(grouped, ["group"], numeric, None), ["group"], list(numeric), {"ridge": (list(numeric), PENALTY)}))

    member = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in segments(data).items())))
    experts = {"segment": ridges(data.withColumn("group", F.explode(member))), "county": ridges(data.where(F.col("county").isNotNull()).withColumn("group", F.col("county")))}
    return Bundle(list(numeric), list(categorical), state, models, dict(weights), experts, {"segment": dict(segment_blends), "county": dict(county_blends)})


def predict_record(spark: SparkSession, bundle: Bundle, record: str) -> float:
    """The price that a bundle expects for one listing as a JSON object; what the record lacks is unknown."""
    numbers = sorted({*bundle.numeric, "gross_m2", "building_age"})
    names = sorted({*bundle.categorical, *KEYS} - {*numbers})
    schema = T.StructType([*(T.StructField(c, T.DoubleType()) for c in numbers), *(T.StructField(c, T.StringType()) for c in names)])
    row = spark.createDataFrame([(record,)], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
    return float(bundle.predict(row).first()["pred_final"])
