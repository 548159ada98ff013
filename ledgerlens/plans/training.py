"""Model fitting, calibration, operating points and scoring as Spark ML stages over the feature table."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import __version__
from ledgerlens.config import Settings, Training
from ledgerlens.functions.columns import band, logit
from ledgerlens.operators import anomaly, boosting
from ledgerlens.operators.evaluation import operating_thresholds, ranking_metrics, split_summary
from ledgerlens.operators.ordering import wide_quantiles
from ledgerlens.operators.quality import banned_columns
from ledgerlens.operators.rules import rule_hits, rule_score
from ledgerlens.schema import CATEGORIES, FEATURES
from ledgerlens.session import materialize, workspace

LABEL = "is_fraud"
SCORES = {"rules": "score_rules", "robust_z": "score_robust_z", "isolation_forest": "score_iforest",
          "logistic_regression": "score_logreg", "boosted_trees": "score_boosted"}
CANDIDATES = ("boosted_trees", "logistic_regression")  # the longest fit first
PARALLEL_FITS = 4
ROWS_PER_TASK = 200_000
ROWS_WORTH_A_TASK = 20_000
MISSING = -999.0  # below every feature value, so a tree can split missing values off


# ------------------------------------------------------------------------------------------ statistics
def baseline_table(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Exact median of each feature over legitimate training rows (0 when a feature has no value)."""
    medians = wide_quantiles(train.where(F.col(LABEL) == 0), {f: F.col(f) for f in features}, [0.5]).select(
        "feature", F.col("q").alias("baseline"))
    names = train.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(medians, "feature", "left").fillna(0.0, ["baseline"])


def drift_reference(train: DataFrame, t: Training = Training()) -> DataFrame:
    """All rows of the last training days; drift only needs their bin counts."""
    last = train.agg(F.max("day").alias("_last"))
    recent = train.crossJoin(F.broadcast(last)).where(F.col("day") >= F.col("_last") - t.drift_reference_days)
    return recent.drop("_last")


def medians_of(train: DataFrame, features: Sequence[str], accuracy: int = 10_000) -> dict[str, float]:
    """Imputation medians and nothing else: one pass with bounded sketches."""
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5, accuracy).alias(f) for f in features]).first()
    return {f: float(row[f]) if row[f] is not None else 0.0 for f in features}


# -------------------------------------------------------------------------------------------- stages
def _signed_log_sql(f: str) -> str:
    return f"signum(CAST({f} AS DOUBLE)) * log1p(abs(CAST({f} AS DOUBLE)))"


def logistic_stages(train: DataFrame, features: Sequence[str], t: Training, n_rows: int) -> list:
    """Signed log, median imputation with missing indicators, standardisation, class-balanced L2 regression."""
    medians = medians_of(train, features)
    counts = train.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in features]).first()
    with_missing = [f for f in features if counts[f] > 0]

    def imputed(f):
        m = math.copysign(math.log1p(abs(medians[f])), medians[f]) if medians[f] else 0.0
        return f"coalesce({_signed_log_sql(f)}, CAST({m!r} AS DOUBLE)) AS x_{f}"

    flags = [f"CAST({f} IS NULL AS DOUBLE) AS m_{f}" for f in with_missing]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join([*map(imputed, features), *flags])} FROM __THIS__")
    columns = [*[f"x_{f}" for f in features], *[f"m_{f}" for f in with_missing]]
    return [prepare, VectorAssembler(inputCols=columns, outputCol="_raw_vector"),
            StandardScaler(inputCol="_raw_vector", outputCol="_vector", withMean=True),
            LogisticRegression(featuresCol="_vector", labelCol=LABEL, weightCol="_weight", maxIter=t.logistic_iterations,
                               regParam=1.0 / (t.logistic_c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False,
                               probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_label")]


def fit_boosted(train: DataFrame, features: Sequence[str], t: Training, n_rows: int) -> PipelineModel:
    """Gradient-boosted trees; categories become one-hot columns, missing values a value of their own."""
    numeric = [f for f in features if f != "category_code"]
    exprs = [f"coalesce(CAST({f} AS DOUBLE), {MISSING}) AS x_{f}" for f in numeric]
    hot = [f"CAST(category_code <=> {i} AS DOUBLE) AS c_{i}" for i in range(len(CATEGORIES))] if "category_code" in features else []
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join([*exprs, *hot])} FROM __THIS__")
    columns = [*[f"x_{f}" for f in numeric], *[h.rsplit(" ", 1)[1] for h in hot]]
    shape = boosting.Shape(t.boosting_rounds, t.boosting_step, t.boosting_depth, t.min_leaf_rows, bins=64)
    trees, cuts = boosting.fit(prepare.transform(train), columns, LABEL, shape, t.seed, n_rows)
    model = boosting.classifier(train.sparkSession, trees, cuts, t.boosting_step, "_vector", "_label", "_margin", "_probability")
    return PipelineModel([prepare, VectorAssembler(inputCols=columns, outputCol="_vector"), model])


def fit_candidate(name: str, train: DataFrame, features: Sequence[str], t: Training, n_rows: int,
                  fraud_rate: float) -> PipelineModel:
    if name == "logistic_regression":
        balanced = F.when(F.col(LABEL) == 1, 0.5 / max(fraud_rate, 1e-9)).otherwise(0.5 / max(1 - fraud_rate, 1e-9))
        stages = logistic_stages(train, features, t, n_rows)
        return Pipeline(stages=stages).fit(train.withColumn("_weight", balanced))
    return fit_boosted(train, features, t, n_rows)


@dataclass(frozen=True)
class TrainRows:
    """Training rows in as many tasks as fitting needs, and the row of ``split_summary`` of every split."""

    rows: DataFrame
    facts: dict


def train_rows(data: DataFrame) -> TrainRows:
    facts = {r["split"]: r for r in split_summary(data.where(F.col("split").isNotNull())).collect()}  # three rows
    n_rows, context = facts["train"]["n_rows"], data.sparkSession.sparkContext
    # the logistic fit runs hundreds of short jobs: a task for every core if the rows are worth it, but no more than they need
    tasks = max(n_rows // ROWS_PER_TASK + 1, min(n_rows // ROWS_WORTH_A_TASK, context.defaultParallelism))
    return TrainRows(data.where(F.col("split") == "train").coalesce(tasks), facts)


def fit_candidates(parts: Sequence[TrainRows], features: Sequence[str], t: Training) -> list[dict[str, PipelineModel]]:
    """Every candidate on each of ``parts``, ``PARALLEL_FITS`` at a time: the short jobs of a single fit leave most of a cluster idle."""
    spark = parts[0].rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(workspace(spark))  # boosting cuts its lineage there

    def fit(name: str, part: TrainRows) -> PipelineModel:
        return fit_candidate(name, part.rows, features, t, part.facts["train"]["n_rows"], part.facts["train"]["fraud_rate"])

    jobs = [inheritable_thread_target(spark)(partial(fit, name, part)) for part in parts for name in CANDIDATES]
    with ThreadPool(min(PARALLEL_FITS, len(jobs))) as pool:
        models = pool.map(lambda job: job(), jobs, chunksize=1)
    found = [dict(zip(CANDIDATES, models[i:i + len(CANDIDATES)])) for i in range(0, len(models), len(CANDIDATES))]
    return [{name: own[name] for name in ("logistic_regression", "boosted_trees")} for own in found]


def raw_score(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Adds the model's probability of fraud and drops its working columns."""
    scored = model.transform(df).withColumn(out, vector_to_array("_probability")[1])
    return scored.select(*df.columns, out)


# ----------------------------------------------------------------------------------------- calibration
@dataclass(frozen=True)
class Platt:
    """Monotone sigmoid recalibration of a raw score."""

    slope: float
    intercept: float

    def predict(self, raw: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(self.slope * logit(raw) + self.intercept)))


def fit_platt(scored: DataFrame, raw: str, steps: int = 20, ridge: float = 1e-9) -> Platt:
    """Two-parameter logistic regression of the label on the score's log-odds, by Newton steps from the base rate.

    Rows are counted once per score value; a step sums five numbers over these counts. ``ridge`` keeps the slope finite if the score separates the labels,
    and a step that would raise the loss is halved.
    """
    value = F.col(raw).cast("double")
    counts = scored.where(value.isNotNull() & F.col(LABEL).isNotNull()).groupBy(value.alias("s")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(LABEL).cast("double")).alias("pos"))
    counts = materialize(counts.select(logit(F.col("s")).alias("z"), "n", "pos"), "platt")
    n, pos = counts.agg(F.sum("n"), F.sum("pos")).first()
    if not n or pos in (0.0, n):
        return Platt(0.0, math.log(max(pos or 0.0, 1e-9) / max((n or 0.0) - (pos or 0.0), 1e-9)))

    def sums(a: float, b: float) -> tuple[float, ...]:
        m = F.col("z") * a + b
        p = 1.0 / (1.0 + F.exp(-m))
        w, gap = F.col("n") * p * (1.0 - p), F.col("n") * p - F.col("pos")
        loss = F.col("n") * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))) - F.col("pos") * m
        return tuple(counts.agg(*[F.sum(x) for x in (gap * F.col("z"), gap, w * F.col("z") * F.col("z"), w * F.col("z"), w, loss)]).first())

    a, b = 0.0, math.log(pos / (n - pos))
    now = sums(a, b)
    for _ in range(steps):
        ga, gb, haa, hab, hbb, loss = now
        ga, haa = ga + ridge * n * a, haa + ridge * n
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        before = loss + ridge * n * a * a / 2
        for _ in range(20):
            now = sums(a - da, b - db)
            if now[5] + ridge * n * (a - da) ** 2 / 2 <= before + 1e-12 * abs(before):
                break
            da, db = da / 2, db / 2
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-12:
            break
    return Platt(a, b)


# ---------------------------------------------------------------------------------------------- model
@dataclass(frozen=True)
class RiskModel:
    """What scoring a feature row needs."""

    name: str
    pipeline: PipelineModel
    platt: Platt
    features: list[str]
    review: float
    block: float
    baseline: dict[str, float]
    robust_z: dict[str, tuple[float, float]]
    meta: dict = field(default_factory=dict)

    def raw(self, df: DataFrame, out: str = "raw_score") -> DataFrame:
        return raw_score(self.pipeline, df, out)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``p_model`` (calibrated) and ``band``."""
        scored = self.raw(df, "_raw").withColumn("p_model", self.platt.predict(F.col("_raw")))
        return scored.withColumn("band", band(F.col("p_model"), self.review, self.block)).drop("_raw")

    def save(self, path: str) -> None:
        """The Spark ML pipeline plus one JSON row with everything else."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        record = {"name": self.name, "platt": asdict(self.platt), "features": self.features, "review": self.review,
                  "block": self.block, "baseline": self.baseline, "robust_z": self.robust_z, "meta": self.meta}
        spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/model")

    @staticmethod
    def load(path: str) -> RiskModel:
        spark = SparkSession.getActiveSession()
        r = json.loads(spark.read.text(f"{path}/model").first()["value"])
        return RiskModel(r["name"], PipelineModel.load(f"{path}/pipeline"), Platt(**r["platt"]), r["features"], r["review"],
                         r["block"], r["baseline"], {k: tuple(v) for k, v in r["robust_z"].items()}, r["meta"])


@dataclass(frozen=True)
class Trained:
    model: RiskModel
    scored: DataFrame  # validation and test rows with every method's score
    valid_pr_auc: dict[str, float]
    forest: anomaly.IsolationForest | None


def train_all(data: DataFrame, settings: Settings = Settings(), features: Sequence[str] = FEATURES,
              forest: bool = True, part: TrainRows | None = None, candidates: Mapping[str, PipelineModel] | None = None) -> Trained:
    """Fits detectors and candidates on train, selects and calibrates on validation, scores validation and test.

    ``data`` is the stored dataset (features, day, split). Test labels are read by nothing here. ``part`` and ``candidates`` are its
    ``train_rows`` and the models fitted on them, if the caller has them already.
    """
    if banned_columns(data.select(*features)):
        raise ValueError("ground-truth columns among the features")
    t = settings.training
    ev = data.where(F.col("split").isin("valid", "test"))
    part = part or train_rows(data)
    train, facts = part.rows, part.facts

    z = anomaly.robust_z_params(anomaly.fit_robust_z(train))
    ev = ev.withColumns({"rule_hits": rule_hits(), "score_rules": rule_score(), "score_robust_z": anomaly.robust_z_score(z)})
    grown = None
    if forest:
        grown = anomaly.fit_forest(train, t.seed, t.forest_trees, t.forest_sample)
        ev = ev.withColumn("score_iforest", anomaly.forest_score(grown, ev))

    candidates = candidates or fit_candidates([part], features, t)[0]
    for name, model in candidates.items():
        ev = raw_score(model, ev, SCORES[name])
    ev = materialize(ev, "candidate-scores")
    valid = ev.where(F.col("split") == "valid")
    ap = {name: ranking_metrics(valid, SCORES[name]).first()["pr_auc"] or 0.0 for name in candidates}
    best = max(ap, key=ap.get)

    platt = fit_platt(valid, SCORES[best])
    ev = ev.withColumn("p_model", platt.predict(F.col(SCORES[best])))
    limits = operating_thresholds(ev.where(F.col("split") == "valid"), "p_model", settings.cost).first()
    review, block = float(limits["review"]), float(limits["block"])
    baseline = {r["feature"]: r["baseline"] for r in baseline_table(train, features).collect()}  # one row per feature
    # fixed values: the names of the metadata entries
    meta = {"model_version": __version__, "algorithm": best, "selected_by": "validation PR-AUC",
            "candidate_valid_pr_auc": ap, "seed": t.seed, "split": asdict(settings.split), "cost": asdict(settings.cost),
            "valid_cost_at_review": float(limits["valid_cost"]),
            **{f"n_{k}": r["n_rows"] for k, r in facts.items()}, **{f"{k}_fraud_rate": r["fraud_rate"] for k, r in facts.items()},
            **{f"{k}_days": [r["first_day"], r["last_day"]] for k, r in facts.items()}}
    model = RiskModel(best, candidates[best], platt, list(features), review, block, baseline, z, meta)
    scored = materialize(ev.withColumn("band", band(F.col("p_model"), review, block)), "scored")
    return Trained(model, scored, ap, grown)


