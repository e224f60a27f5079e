"""Models over terms and texts: TF-IDF, clusters, components, part-of-speech classes."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, IDF, NGram, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F


def tfidf(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, word, weight: counts times ln((1 + n) / (1 + df)) + 1, each text's weights of length 1."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("word"))
    tf = words.groupBy("id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    raw = tf.join(df, "word").crossJoin(n).select("id", "word", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "word", (F.col("w") / F.col("norm")).alias("weight"))


def _scaled(items: DataFrame, vector_col: str) -> DataFrame:
    """items with a column of features, each of mean 0 and deviation 1."""
    v = items.withColumn("__raw", array_to_vector(F.col(vector_col).cast("array<double>")))
    return StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True).fit(v).transform(v).drop("__raw")


def clusters(items: DataFrame, id_col: str, vector_col: str, k: int, seed: int = 42) -> DataFrame:
    """id, cluster."""
    v = _scaled(items, vector_col)
    found = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster", initSteps=5).fit(v).transform(v)
    return found.select(F.col(id_col).alias("id"), "cluster")


def elbow(items: DataFrame, vector_col: str, ks: list[int], seed: int = 42) -> DataFrame:
    """k, cost, bend: the second difference of costs; the best k bends most."""
    v = _scaled(items, vector_col).select("__features").persist()
    costs = [float(KMeans(k=k, seed=seed, featuresCol="__features").fit(v).summary.trainingCost) for k in ks]
    v.unpersist()
    bends = [None, *(costs[i - 1] - 2 * costs[i] + costs[i + 1] for i in range(1, len(ks) - 1)), None]
    return items.sparkSession.createDataFrame(list(zip(ks, costs, bends, strict=True)), "k int, cost double, bend double")


def components(items: DataFrame, id_col: str, vector_col: str, k: int = 2) -> DataFrame:
    """id and its first principal components."""
    v = _scaled(items, vector_col)
    out = PCA(k=k, inputCol="__features", outputCol="__pca").fit(v).transform(v).withColumn("__a", vector_to_array("__pca"))
    return out.select(F.col(id_col).alias("id"), *(F.col("__a")[i].alias(f"pc{i + 1}") for i in range(k)))


def text_classes(labelled: DataFrame, asked: DataFrame, text_col: str, label_col: str, *, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """asked with label and probability: words, word pairs and letter groups, balanced logistic regression.

    Labels with fewer than `least` rows aren't learnt; below the threshold the label is TBD.
    """
    counts = labelled.groupBy(label_col).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    total, kinds = counts.agg(F.sum("__n"), F.count("*")).first()
    train = labelled.join(counts, label_col).withColumn("__w", F.lit(float(total)) / (F.col("__n") * kinds))
    grams = [NGram(n=n, inputCol="__chars", outputCol=f"__c{n}") for n in (3, 4, 5)]
    stages = [
        StringIndexer(inputCol=label_col, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"[^\p{L}]+"),
        NGram(n=2, inputCol="__words", outputCol="__pairs"),
        RegexTokenizer(inputCol=text_col, outputCol="__chars", pattern=r"(?s).", gaps=False),
        *grams,
    ]
    names = ["__words", "__pairs", *(g.getOutputCol() for g in grams)]
    stages += [s for n in names for s in (HashingTF(inputCol=n, outputCol=f"{n}_tf", numFeatures=1 << 12), IDF(inputCol=f"{n}_tf", outputCol=f"{n}_idf"))]
    stages += [VectorAssembler(inputCols=[f"{n}_idf" for n in names], outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=20, regParam=0.01)]
    model = Pipeline(stages=stages).fit(train)
    labels = F.array(*(F.lit(x) for x in model.stages[0].labels))
    out = model.transform(asked.withColumn(label_col, F.lit(None).cast("string"))).withColumn("__p", vector_to_array("probability"))
    best = F.array_max("__p")
    return out.select(*(c for c in asked.columns if c != label_col), F.when(best >= threshold, F.try_element_at(labels, F.array_position("__p", best).cast("int"))).otherwise("TBD").alias(label_col), best.alias("probability"))
