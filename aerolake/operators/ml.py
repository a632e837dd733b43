"""Section J: training, inference and evaluation on pyspark.ml."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.runtime import materialize

SEED = 42
#: Classes that are fitted at once; rows of a task of a fit, about.
AT_ONCE, EACH = 4, 5000


def assembled(frame: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Numbers as a vector; gaps are 0."""
    return VectorAssembler(inputCols=columns, outputCol=out).transform(frame.fillna(0, columns))


def balanced(frame: DataFrame, label: str = "label") -> DataFrame:
    """A weight column that gives every class the same total."""
    n = frame.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return frame.join(F.broadcast(n.join(F.broadcast(total))), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def split(frame: DataFrame, label: str = "label", test: float = 0.25, key: str = "id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A stratified split by a hash of ``key``: every row is dealt by itself, so no class is ordered.

    About ``test`` of each class is held out; a class's row of least hash always trains,
    so classes of one row train only.
    """
    tagged = frame.withColumn("_h", F.xxhash64(F.lit(seed), key))
    least = tagged.groupBy(label).agg(F.min("_h").alias("_least"))  # a row a class
    tagged = tagged.join(least, label)
    held = (F.pmod("_h", F.lit(1_000_000)) >= int((1 - test) * 1_000_000)) & (F.col("_h") != F.col("_least"))
    return tagged.where(~held).select(*frame.columns), tagged.where(held).select(*frame.columns)


def exact_quantiles(frame: DataFrame, column: str, shares: list[float], parts: int = 4096) -> list[float | None]:
    """Interpolated quantiles of a column's values (nulls and NaN left out), found by counting.

    Each pass splits the range that holds the wanted rank into ``parts`` and counts its
    rows, so no task holds or sorts all values.  Infinities are counted apart; between one
    and another value the quantile is the infinity.
    """
    values = frame.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    infinite = F.lit(float("inf"))
    finite = values.where((F.col("v") < infinite) & (F.col("v") > -infinite))
    n, under, over = values.agg(F.count("v"), F.count_if(F.col("v") == -infinite), F.count_if(F.col("v") == infinite)).first()
    low_, high_ = finite.agg(F.min("v"), F.max("v")).first()

    def at(rank: int) -> float:
        if rank < under or rank >= n - over:
            return float("-inf") if rank < under else float("inf")
        low, high, below, narrow = low_, high_, under, True
        while low < high:
            half = high / 2 - low / 2  # halves, as the whole range may be no number
            part = F.least(F.lit(parts - 1), F.floor((F.col("v") / 2 - low / 2) / half * parts)).cast("int") if half > 0 and narrow else F.when(F.col("v") > low, 1).otherwise(0)
            for r in finite.where(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("part").collect():
                if below + r.n > rank:
                    break
                below += r.n
            narrow = (low, high) != (r.a, r.b)
            low, high = r.a, r.b
        return low

    def quantile(q: float) -> float:
        first = at(int(q * (n - 1)))
        left = q * (n - 1) - int(q * (n - 1))
        if not left > 0 or math.isinf(first):
            return first
        second = at(int(q * (n - 1)) + 1)
        return second if math.isinf(second) else first + left * (second - first)

    return [quantile(q) if n else None for q in shares]


class Calibrated(Transformer):
    """A fitted classifier whose probability of class 1 goes through an isotonic map."""

    def __init__(self, model: PipelineModel, isotonic):
        super().__init__()
        self.model, self.isotonic = model, isotonic

    def _transform(self, frame: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = self.model.transform(frame).withColumn("_raw", vector_to_array("probability")[1]).drop("prediction")
        out = self.isotonic.transform(out).withColumnRenamed("prediction", "_p")
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).withColumn("prediction", (F.col("_p") >= 0.5).cast("double")).drop("_raw", "_p")


def out_of_fold(train: DataFrame, fit, folds: int = 3, key: str = "id", seed: int = SEED) -> DataFrame:
    """Every row's prediction by a model that ``fit`` made from the other folds; folds follow from a hash of ``key``."""
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(folds))
    parts = [fit(train.where(fold != k)).transform(train.where(fold == k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train_pairs(frame: DataFrame, columns: list[str]) -> tuple[Calibrated, dict]:
    """Balanced logistic regression on scaled pair features (label 0/1, id), calibrated; AUC and Brier score on held-out rows.

    The calibration sees each training row under a model that did not learn from it.
    """
    train, test = split(frame)
    train = materialize(assembled(balanced(train), columns, "raw"), "pairs-to-train")
    steps = [StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50)]
    model = Pipeline(stages=steps).fit(train)
    p = out_of_fold(train, lambda rows: Pipeline(stages=steps).fit(rows)).withColumn("_raw", vector_to_array("probability")[1])
    calibrated = Calibrated(model, IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight").fit(p.drop("prediction", "rawPrediction", "probability", "features", "raw")))
    out = calibrated.transform(assembled(test, columns, "raw")).withColumn("p", vector_to_array("probability")[1])
    brier = out.agg(F.avg((F.col("p") - F.col("label")) ** 2)).first()[0]
    return calibrated, {"auc": BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(out), "brier": brier}


def retrain(frame: DataFrame, columns: list[str], least: int = 50):
    """Train only when there are labels enough."""
    return train_pairs(frame, columns) if frame.limit(least).count() >= least else None


def train_behaviour(features: DataFrame, labels: DataFrame, columns: list[str], trees: int = 100) -> tuple[PipelineModel, list[str]]:
    """Device types (labels: mac, device_type) from behaviour (client and numbers), joined on the lower-case address."""
    from pyspark.ml.feature import StringIndexer

    rows = features.join(labels.select(F.lower("mac").alias("_mac"), "device_type"), F.lower("client") == F.col("_mac")).drop("_mac")
    index = StringIndexer(inputCol="device_type", outputCol="label").fit(rows)
    train, _ = split(index.transform(rows), key="client")
    train = assembled(balanced(train), columns, "raw")
    steps = [StandardScaler(inputCol="raw", outputCol="features"), RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, seed=SEED)]
    return Pipeline(stages=steps).fit(train), index.labels


def classifiers(width: int, classes: int) -> dict:
    """The candidates by name."""
    out = {"random_forest": RandomForestClassifier(numTrees=50, seed=SEED), "gradient_boosting": OneVsRest(classifier=GBTClassifier(maxIter=10, seed=SEED), parallelism=AT_ONCE), "svm": OneVsRest(classifier=LinearSVC(maxIter=30), parallelism=AT_ONCE), "mlp": MultilayerPerceptronClassifier(layers=[width, 32, classes], seed=SEED, maxIter=60)}
    return out


def train_device(frame: DataFrame, columns: list[str], names: list[str] | None = None) -> tuple[str, object, dict[str, float]]:
    """The candidate with the best held-out accuracy (label, id and numbers).

    The two sides of the split are written once, dealt by id, as fits pass over them many times and a
    table of one row group would be one task in each pass.
    """
    n, most = frame.agg(F.count(F.lit(1)), F.max("label")).first()
    train, test = (materialize(assembled(x, columns).select("id", "label", "features").repartition(max(1, min(1000, n // EACH)), "id"), "devices") for x in split(frame))
    classes = int(most) + 1
    scores, models = {}, {}
    for name, estimator in classifiers(len(columns), classes).items():
        if names is None or name in names:
            models[name] = estimator.fit(train)
            scores[name] = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(models[name].transform(test))
    best = max(scores, key=scores.get)
    return best, models[best], scores


def vote(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """Hard vote of several prediction frames; the smaller class wins ties."""
    rows = frames[0].select(key, "prediction")
    for f in frames[1:]:
        rows = rows.unionByName(f.select(key, "prediction"))
    n = rows.groupBy(key, "prediction").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("prediction"))


def soft_vote(frames: list[DataFrame], key: str = "id", weights: list[float] | None = None) -> DataFrame:
    """The class of the largest mean probability; the smaller class wins ties.  frames: (key, probability array)."""
    weights = weights or [1.0] * len(frames)
    rows = None
    for f, w in zip(frames, weights, strict=True):
        one = f.select(key, F.posexplode("probability").alias("class", "p")).withColumn("p", F.col("p") * F.lit(float(w)))
        rows = one if rows is None else rows.unionByName(one)
    mean = rows.groupBy(key, "class").agg((F.sum("p") / F.lit(float(sum(weights)))).alias("p"))
    return mean.groupBy(key).agg(F.max_by("class", F.struct("p", -F.col("class"))).cast("double").alias("prediction"), F.max("p").alias("confidence"))


def ensemble(frame: DataFrame, columns: list[str], names: list[str] = ("random_forest", "logistic", "tree"), folds: int = 5, more: tuple[str, ...] = ()) -> tuple[dict[str, float], dict]:
    """Base models, hard and soft votes, and a logistic regression stacked on their out-of-fold probabilities.

    frame: label, id and numbers.  more: "adaboost" and "bagging" beside them, which do not vote.  Returns
    held-out accuracies by name and the fitted models.
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    train, test = (materialize(assembled(x, columns).select("id", "label", "features"), "ensemble") for x in split(frame))
    options = {"random_forest": RandomForestClassifier(numTrees=20, seed=SEED), "logistic": LogisticRegression(maxIter=20), "tree": DecisionTreeClassifier(seed=SEED)}
    models = {n: options[n].fit(train) for n in names}
    tested = {n: materialize(m.transform(test).select("id", "label", "prediction", vector_to_array("probability").alias("probability")), "ensemble-test") for n, m in models.items()}
    right = lambda df: df.join(test.select("id", "label"), "id").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
    scores = {n: right(t.select("id", "prediction")) for n, t in tested.items()}
    if "adaboost" in more:
        models["adaboost"] = boosted(train, int(frame.agg(F.max("label")).first()[0]) + 1)
        scores["adaboost"] = right(models["adaboost"].transform(test).select("id", "prediction"))
    if "bagging" in more:
        models["bagging"] = bagged(train)
        scores["bagging"] = right(soft_vote([m.transform(test).select("id", vector_to_array("probability").alias("probability")) for m in models["bagging"]]))
    scores["hard_vote"] = right(vote(list(tested.values())))
    scores["soft_vote"] = right(soft_vote(list(tested.values())))

    def beside(parts: dict[str, DataFrame], base: DataFrame) -> DataFrame:
        out = base.select("id", "label")
        for n, part in parts.items():
            out = out.join(part.select("id", F.col("probability").alias(f"_{n}")), "id")
        from pyspark.ml.functions import array_to_vector

        return out.select("id", "label", array_to_vector(F.concat(*[f"_{n}" for n in parts])).alias("features"))

    seen = {n: out_of_fold(train, options[n].fit, folds).select("id", vector_to_array("probability").alias("probability")) for n in names}
    models["stacked"] = LogisticRegression(maxIter=20).fit(materialize(beside(seen, train), "ensemble-stack"))
    scores["stacked"] = right(models["stacked"].transform(beside(tested, test)).select("id", "prediction"))
    return scores, models


class Boosted(Transformer):
    """Trees with the logarithmic weights of their rounds; the class of most weight wins, the smaller of equals."""

    def __init__(self, models: list, alphas: list[float], classes: int):
        super().__init__()
        self.models, self.alphas, self.classes = models, alphas, classes

    def _transform(self, frame: DataFrame) -> DataFrame:
        out, votes = frame, [F.lit(0.0)] * self.classes
        for k, (model, alpha) in enumerate(zip(self.models, self.alphas, strict=True)):
            out = model.transform(out).withColumn(f"_said{k}", F.col("prediction")).drop("prediction", "rawPrediction", "probability")
            votes = [v + F.when(F.col(f"_said{k}") == c, float(alpha)).otherwise(0.0) for c, v in enumerate(votes)]
        total = float(sum(self.alphas)) or 1.0
        out = out.withColumn("_votes", F.array(*votes))
        out = out.withColumn("prediction", (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"))
        return out.withColumn("probability", F.transform("_votes", lambda v: v / total)).drop("_votes", *[f"_said{k}" for k in range(len(self.models))])


def boosted(train: DataFrame, classes: int, rounds: int = 20, depth: int = 1, weights: list | None = None) -> Boosted:
    """AdaBoost (SAMME) over (id, label, features): each round's tree sees the rows reweighted by the last one's mistakes.

    The weights are a table that every round rewrites in shared storage.  weights: takes each round's.
    Ends early where a tree makes no mistake, or does no better than chance.
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    from aerolake.runtime import discard

    n = train.count()
    now = materialize(train.select("id", "label", "features", F.lit(1.0 / max(1, n)).alias("_w")), "boost")
    models, alphas = [], []
    for _ in range(rounds if n else 0):
        tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxDepth=depth, minWeightFractionPerNode=0.0, seed=SEED).fit(now)
        said = tree.transform(now).select("id", "label", "features", "_w", (F.col("prediction") != F.col("label")).alias("_wrong"))
        error, total = said.agg(F.sum(F.when(F.col("_wrong"), F.col("_w")).otherwise(0.0)), F.sum("_w")).first()
        error /= total
        if error >= 1 - 1 / classes:
            break
        alpha = math.log((1 - error) / max(error, 1e-12)) + math.log(classes - 1)
        models.append(tree)
        alphas.append(alpha)
        if error <= 0:
            break
        whole = total - error * total + error * total * math.exp(alpha)
        after = materialize(said.select("id", "label", "features", (F.col("_w") * F.when(F.col("_wrong"), math.exp(alpha)).otherwise(1.0) / whole).alias("_w")), "boost")
        discard(now)
        now = after
        if weights is not None:
            weights.append({r["id"]: r["_w"] for r in now.select("id", "_w").collect()})
    return Boosted(models, alphas, classes)


def poisson_weight(key: str, tree: int, seed: int = SEED):
    """How often a row is drawn into a bootstrap sample: a Poisson number of mean 1 from a hash, so that retried tasks agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), key), 11).cast("double") + 0.5) / float(1 << 53)
    steps, p, total = F.lit(0.0), math.exp(-1), 0.0
    for k in range(12):
        total += p
        steps = steps + (u >= total).cast("double")
        p /= k + 1
    return steps


def bagged(train: DataFrame, trees: int = 10, depth: int = 5, key: str = "id") -> list:
    """Trees of Poisson bootstrap samples of (id, label, features); ``soft_vote`` joins what they say."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = materialize(train.select(key, "label", "features"), "bag")
    return [DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxDepth=depth, seed=SEED + k).fit(rows.withColumn("_w", poisson_weight(key, k)).where("_w > 0")) for k in range(trees)]


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    """The exact area under the ROC curve: chance that a positive row scores above a negative one, ties by half.

    Rows are counted by score; positives below each score are summed over ranges of
    scores, so no task orders all of them.
    """
    by = materialize(scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg")), "by-score")
    low, high, pos, neg = by.agg(F.min("s"), F.max("s"), F.sum("pos"), F.sum("neg")).first()
    if not pos or not neg:
        return 0.5
    part = F.floor((F.col("s") - F.lit(low)) / F.lit(((high - low) / 1024) or 1.0)).cast("int")
    by = by.withColumn("part", part)
    totals = by.groupBy("part").agg(F.sum("neg").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("earlier"))  # a row a part
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = by.withColumn("inside", inside).join(F.broadcast(totals), "part")
    return below.agg(F.sum(F.col("pos") * (F.col("inside") + F.col("earlier") + F.col("neg") / 2))).first()[0] / (pos * neg)


def anomaly_scores(frame: DataFrame, columns: list[str], key: str = "id", share: float = 0.1) -> DataFrame:
    """Squared Mahalanobis distances; the ``share`` farthest rows are anomalies.

    One aggregate gives the covariance (columns squared numbers reach the driver).
    """
    import numpy as np

    filled = frame.fillna(0, columns)
    stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    k = len(columns)
    cov = np.array([[stats[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - F.lit(float(stats[f"m_{c}"] or 0.0)) for c in columns]
    distance = sum((d[i] * d[j] * F.lit(float(inv[i, j])) for i in range(k) for j in range(k)), F.lit(0.0))
    rows = filled.select(key, distance.alias("distance"))
    rows = materialize(rows, "distances")
    cut = exact_quantiles(rows, "distance", [1 - share])[0]
    return rows.select(key, "distance", (F.col("distance") > F.lit(cut)).alias("anomaly"))


def train_regressor(frame: DataFrame, columns: list[str], names: list[str] | None = None) -> tuple[str, object, dict[str, float]]:
    """The candidate with the best held-out R2 (label, id and numbers)."""
    train, test = (assembled(x, columns) for x in split(frame.withColumn("_one", F.lit(1)), label="_one"))
    options = {"linear": LinearRegression(), "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0), "random_forest": RandomForestRegressor(numTrees=30, seed=SEED), "gradient_boosting": GBTRegressor(maxIter=10, seed=SEED)}
    scores, models = {}, {}
    for name, estimator in options.items():
        if names is None or name in names:
            models[name] = estimator.fit(train)
            scores[name] = RegressionEvaluator(metricName="r2").evaluate(models[name].transform(test))
    if names is None or "neural_network" in names:
        from aerolake.operators.networks import fit_regressor

        models["neural_network"] = fit_regressor(train)
        scores["neural_network"] = RegressionEvaluator(metricName="r2").evaluate(models["neural_network"].transform(test))
    best = max(scores, key=scores.get)
    return best, models[best], scores


def auto(frame: DataFrame, columns: list[str], keep: int = 20, folds: int = 3) -> PipelineModel:
    """Feature selection and a searched random forest in one pipeline."""
    select = UnivariateFeatureSelector(featuresCol="raw", outputCol="features", labelCol="label").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(keep, len(columns)))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", seed=SEED)
    grid = ParamGridBuilder().addGrid(forest.numTrees, [20, 50]).addGrid(forest.maxDepth, [4, 8]).build()
    search = CrossValidator(estimator=Pipeline(stages=[select, forest]), estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(), numFolds=folds, seed=SEED)
    return search.fit(assembled(frame, columns, "raw")).bestModel


def imputed(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps filled with medians, found by counting; a column without values stays empty."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    numbers = frame.withColumns({c: finite(c) for c in columns})
    medians = {c: exact_quantiles(numbers, c, [0.5])[0] for c in columns}
    return numbers.withColumns({c: F.coalesce(c, F.lit(m)) for c, m in medians.items() if m is not None})


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A row with accuracy and weighted precision, recall and F1, from one confusion count."""
    c = confusion(scored, label, prediction)
    hit = F.sum(F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0))
    truth = c.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    said = c.groupBy(F.col("z").alias("k")).agg(F.sum("n").alias("said"))
    per = truth.join(said, "k", "left").select("support", "tp", (F.col("tp") / F.col("support")).alias("r"), F.coalesce(F.col("tp") / F.col("said"), F.lit(0.0)).alias("p"))
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    total = F.sum("support")
    return per.agg((F.sum("tp") / total).alias("accuracy"), *[(F.sum(F.col(x) * F.col("support")) / total).alias(name) for x, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts by truth and prediction."""
    return scored.groupBy(F.col(label).alias("y"), F.col(prediction).alias("z")).agg(F.count(F.lit(1)).alias("n"))


def regression_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mse, rmse, mae, r2 and mape in one aggregate."""
    e = F.col(label) - F.col(prediction)
    mse = F.avg(e * e)
    return scored.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - mse / F.var_pop(label)).alias("r2"), F.avg(F.when(F.col(label) != 0, F.abs(e / F.col(label)))).alias("mape"))


def infer(model: Transformer, rows: DataFrame, columns: list[str], labels: list[str] | None = None, key: str = "id", raw: str = "raw") -> DataFrame:
    """Predictions with confidence for rows; labels name the classes."""
    out = model.transform(assembled(rows, columns, raw))
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int")) if labels else F.col("prediction")
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(key, name.alias("prediction"), sure.alias("confidence"))


def usage(predictions: DataFrame) -> DataFrame:
    """How often each class was predicted, and how surely."""
    return predictions.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def compare(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of several models side by side."""
    out = None
    for name, report in reports.items():
        one = report.select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def save(model, path: str) -> None:
    """A fitted pipeline, in the shared folder."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A18."""
    return PipelineModel.load(path)
