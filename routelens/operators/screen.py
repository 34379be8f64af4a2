"""Models over features of mixed type (T16-T19, T26): Spark ML pipelines, fitted and scored where the rows are."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Imputer, NGram, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import scratch
from .assoc import average_precision
from .report import top_shares

SCORE_STEPS = 10_000


def filled(df: DataFrame, numbers: list[str], categories: list[str], texts: list[str] = []) -> DataFrame:  # noqa: B006
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")) for c in categories} | {c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts}
    )


def common_levels(train: DataFrame, df: DataFrame, categories: list[str], least: int) -> DataFrame:
    """df with `<RARE>` for levels that fewer than `least` training rows have (T16). Only the frequent levels are looked up, at most rows / least of each feature."""
    for c in categories:
        known = train.groupBy(F.col(c).alias("__known")).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("__known")
        df = df.join(known, F.col(c) == F.col("__known"), "left").withColumn(c, F.coalesce("__known", F.lit("<RARE>"))).drop("__known")
    return df


def preparation(numbers: list[str], categories: list[str], texts: list[str] = [], width: int = 1 << 12) -> list:  # noqa: B006
    """Stages to `features`: medians, one-hot levels, and TF-IDF of 1- and 2-grams."""
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__f" for c in numbers])] if numbers else []
    if categories:
        stages += [
            StringIndexer(inputCols=categories, outputCols=[f"{c}__i" for c in categories], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=[f"{c}__o" for c in categories], handleInvalid="keep"),
        ]
    found = [f"{c}__f" for c in numbers] + [f"{c}__o" for c in categories]
    for c in texts:
        stages += [RegexTokenizer(inputCol=c, outputCol=f"{c}__t", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2), NGram(n=2, inputCol=f"{c}__t", outputCol=f"{c}__b")]
        for part in "tb":
            stages += [HashingTF(inputCol=f"{c}__{part}", outputCol=f"{c}__{part}h", numFeatures=width), IDF(inputCol=f"{c}__{part}h", outputCol=f"{c}__{part}i", minDocFreq=2)]
            found.append(f"{c}__{part}i")
    return [*stages, VectorAssembler(inputCols=found, outputCol="features")]


def without_zeros(prepared: PipelineModel) -> PipelineModel:
    """Fitted stages of preparation() without the columns of texts that weigh zero, which are zero in any row: most of those that no term was hashed to."""
    stages, found = [], prepared.stages[-1].getInputCols()
    for stage in prepared.stages[:-1]:
        stages.append(stage)
        if isinstance(stage, IDFModel):
            c = stage.getOutputCol()
            kept = [k for k, (weight, n) in enumerate(zip(stage.idf, stage.docFreq, strict=True)) if weight != 0 and n > 0]
            if kept:
                stages.append(VectorSlicer(inputCol=c, outputCol=f"{c}s", indices=kept))
            found = [f"{c}s" if x == c else x for x in found if x != c or kept]
    return PipelineModel([*stages, VectorAssembler(inputCols=found, outputCol="features")])


def logistic() -> LogisticRegression:
    return LogisticRegression(labelCol="target", weightCol="weight", maxIter=50, regParam=0.01)


def forest(trees: int, depth: int, subset: str = "auto") -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="target", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=10, subsamplingRate=0.7, featureSubsetStrategy=subset, seed=42)


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with score, the probability of target 1 in SCORE_STEPS steps, so that thresholds can be counted by value."""
    return model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1] * SCORE_STEPS) / SCORE_STEPS)


def screen(train: DataFrame, test: DataFrame, numbers: list[str], categories: list[str], trees: int = 50, depth: int = 8, rare: int = 25) -> DataFrame:
    """model, area under ROC and precision-recall on test of a logistic regression and a forest.

    Rows: target 0/1, weight, numbers as double, categories as string. Missing numbers take the median; missing levels are one of their own, rare and unseen ones another.
    """
    train, test = filled(train, numbers, categories), filled(test, numbers, categories)
    train, test = common_levels(train, train, categories, rare), common_levels(train, test, categories, rare)
    rows = []
    for name, model in (("logistic", logistic()), ("forest", forest(trees, depth))):
        scored = Pipeline(stages=[*preparation(numbers, categories), model]).fit(train).transform(test)
        area = {m: BinaryClassificationEvaluator(labelCol="target", metricName=m).evaluate(scored) for m in ("areaUnderROC", "areaUnderPR")}
        rows.append((name, float(area["areaUnderROC"]), float(area["areaUnderPR"])))
    return train.sparkSession.createDataFrame(rows, "model string, roc_auc double, average_precision double")


def operating_threshold(scored: DataFrame, precision: float) -> float:
    """The score with the largest recall among those with enough precision, else that with the best F1 (T17). Of equal ones the highest."""
    counts = scored.groupBy("score").agg(F.sum("target").alias("p"), F.count("*").alias("n"))  # at most SCORE_STEPS + 1 rows
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    all_p = scored.agg(F.sum("target").alias("all_p"))
    c = counts.withColumns({"tp": F.sum("p").over(w), "k": F.sum("n").over(w)}).crossJoin(F.broadcast(all_p))  # one row
    c = c.withColumns({"precision": F.col("tp") / F.col("k"), "recall": F.try_divide("tp", F.col("all_p").cast("double"))})
    enough = F.col("precision") >= precision
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    best = c.agg(F.max(F.when(enough, F.struct("recall", "score"))).alias("a"), F.max(F.struct(f1.alias("f1"), "score")).alias("b")).first()
    return float((best.a or best.b).score)


def at_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, false positives, average precision, ROC AUC, and recall of the top 5 %."""
    hit, wrong = F.col("score") >= threshold, F.col("target") == 0
    n = lambda c: F.count(F.when(c, 1))
    one = scored.agg(n(hit).alias("flagged"), n(hit & ~wrong).alias("tp"), n(hit & wrong).alias("false_positives"), n(~wrong).alias("cases"))
    one = one.select(F.lit(threshold).alias("threshold"), F.try_divide(F.col("tp").cast("double"), F.col("flagged")).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("cases")).alias("recall"), "false_positives")
    top = top_shares(scored.select("score", "target"), (0.05,)).select(F.col("recall").alias("recall_top_5pct"))
    return one.crossJoin(average_precision(scored.select("score", "target"))).crossJoin(top)  # one row each


def baseline_and_forest(train: DataFrame, validation: DataFrame, test: DataFrame, numbers: list[str], categories: list[str], texts: list[str], precision: float = 0.5, trees: int = 250, depth: int = 20) -> DataFrame:
    """The figures of at_threshold() on test for a logistic baseline and a forest, thresholds chosen on validation.

    Features are made once and written, as models read them many times. Columns that are zero in any row are left out; so that a forest's
    nodes are dealt as large a share of the others, it is that of a square root of all columns.
    """
    parts = [filled(x, numbers, categories, texts) for x in (train, validation, test)]
    prepared, at = Pipeline(stages=preparation(numbers, categories, texts)).fit(parts[0]), scratch(train.sparkSession, "screen")
    one = prepared.transform(parts[0]).select("features").first()
    subset = repr(len(one.features) ** -0.5) if one else "auto"
    features = without_zeros(prepared)
    for k, x in enumerate(parts):
        features.transform(x).select("target", "weight", "features").write.parquet(f"{at}/{k}")
        parts[k] = train.sparkSession.read.parquet(f"{at}/{k}")
    out = None
    for name, model in (("logistic", logistic()), ("forest", forest(trees, depth, subset))):
        fitted = PipelineModel([model.fit(parts[0])])
        cut = operating_threshold(probabilities(fitted, parts[1]), precision)
        row = at_threshold(probabilities(fitted, parts[2]), cut).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def shuffled(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """rows with one column's values dealt out anew: both sides are numbered by an independent hash order and meet by number."""
    base = rows.withColumn("__a", F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), "__row"))))
    values = rows.select(F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed + 7919), "__row"))).alias("__a"), F.col(column).alias("__v"))
    return base.join(values, "__a").withColumn(column, F.col("__v")).drop("__a", "__v")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], repeats: int = 5, most_rows: int = 10_000) -> DataFrame:
    """feature, mean and spread of the loss of average precision when the feature is shuffled.

    rows: prepared as for the model, with a unique `__row`; at most `most_rows` of them, drawn by a hash of it, as the method does.
    """
    n = rows.count()
    kept = rows if n <= most_rows else rows.where(F.pmod(F.xxhash64(F.lit(13), "__row"), F.lit(1 << 30)) < int((1 << 30) * most_rows / n))
    quality = lambda df: average_precision(probabilities(model, df).select("score", "target")).first().average_precision
    whole = quality(kept)
    losses = [(f, [float(whole - quality(shuffled(kept, f, 1000 * k + i))) for k in range(repeats)]) for i, f in enumerate(features)]
    rows_out = [(f, sum(x) / len(x), (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5) for f, x in losses]
    return rows.sparkSession.createDataFrame(rows_out, "feature string, importance double, std double")


def text_challenger(train: DataFrame, current: DataFrame, text: str, label: str, predicted: str, width: int = 1 << 14) -> DataFrame:
    """Rows, accuracy, and how often a TF-IDF logistic challenger disagrees with the deployed model, in per cent (T26). Labels are text."""
    fold = lambda df: df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    index = StringIndexer(inputCol=label, outputCol="target", handleInvalid="skip").fit(train)
    model = Pipeline(stages=[*preparation([], [], [text], width), LogisticRegression(labelCol="target", maxIter=30, regParam=0.01)]).fit(index.transform(fold(train.select(text, label))))
    named = F.element_at(F.array(*map(F.lit, index.labels)), F.col("prediction").cast("int") + 1)
    scored = model.transform(fold(current).withColumnRenamed(predicted, "__deployed")).withColumn("challenger", named)
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("challenger") == F.col(label)).cast("double")).alias("accuracy"), (100 * F.avg((F.col("challenger") != F.col("__deployed")).cast("double"))).alias("disagreement_pct"))
