"""Models on given vectors: one-vs-rest logistic regression with balanced classes, clusters and their words."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

MIN_POSITIVES = 12


def logistic(vector, coefficients, intercept):
    """The probability that a fitted model gives, as an expression: nothing of the model but its numbers reaches the tasks."""
    products = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(c)) for c in coefficients]), lambda x, c: x * c)
    return 1 / (1 + F.exp(-F.aggregate(products, F.lit(float(intercept)), lambda total, x: total + x)))


def one_vs_rest(train, test, vector, label, value, c=2.0):
    """Score of `value` against the rest for every test row; NULL scores if the test set has too few positives.

    Classes weigh n / (2 n_c) and the penalty is 1 / (c n), all from one count of the
    training rows by class. Rows without a label are of the rest; with one class alone in
    training every score is NULL.
    """
    y = F.coalesce((F.col(label) == value).cast("double"), F.lit(0.0))
    counts = {r["y"]: r["n"] for r in train.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two at most
    if len(counts) < 2:
        return test.withColumn("score", F.lit(None).cast("double"))
    n = sum(counts.values())
    weight = F.when(F.col("y") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
    known = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), y.alias("y")).withColumn("weight", weight)
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * n), standardization=False, maxIter=100).fit(known)
    enough = F.broadcast(test.agg((F.count_if(F.col(label) == value) >= MIN_POSITIVES).alias("_enough")))
    return test.crossJoin(enough).withColumn("score", F.when(F.col("_enough"), logistic(vector, model.coefficients, model.intercept))).drop("_enough")


def clusters(df, vector, k, seed=42):
    """k-means on the given vectors: a stand-in, not the density clustering of the topic model it stands for."""
    data = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data).drop("features")


def cluster_words(df, cluster, tokens, top=10):
    """Words of each cluster by class-based tf-idf: frequency in the cluster times log(1 + mean cluster size / frequency overall)."""
    from pyspark.sql import Window

    flat = df.select(cluster, F.explode(tokens).alias("word"))
    tf = flat.groupBy(cluster, "word").agg(F.count(F.lit(1)).alias("tf"))
    sizes = tf.groupBy(cluster).agg(F.sum("tf").alias("size"))
    overall = tf.groupBy("word").agg(F.sum("tf").alias("all"))
    mean = sizes.agg(F.avg("size").alias("mean_size"))
    scored = tf.join(sizes, cluster).join(overall, "word").crossJoin(F.broadcast(mean)).withColumn("score", F.col("tf") / F.col("size") * F.ln(1 + F.col("mean_size") / F.col("all")))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(cluster, "rank", "word", "score")
