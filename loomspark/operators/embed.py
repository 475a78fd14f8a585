"""Vectors of texts from a caller's model, in batches, each text once.

A store keeps vectors by the hash of their text. A run looks the texts up there, gives each missing text to
the model once (in batches of Arrow arrays; the model is made once in each Python worker), adds the new vectors to the
store and joins all. Runs write folders of their own, so that one that failed leaves nothing that counts.

Edge cases: null and blank texts have no vector; equal texts share one; a text whose vector is stored never reaches the model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomspark.sources.scratch import stored

STORED = "hash string, vector array<float>, run long"
#: Texts that the model gets at once.
BATCH = 64


def known_vectors(spark: SparkSession, path: str) -> DataFrame:
    """hash, vector and run of all finished runs of a store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    return spark.read.schema(STORED).option("basePath", path).parquet(path)


def embed(texts: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], path: str, key: str = "key", text: str = "text", batch: int = BATCH) -> DataFrame:
    """(key, vector, fresh) of texts: fresh tells what this run gave to the model. make_model() returns a function from an array of texts to an array of vectors."""
    known = known_vectors(texts.sparkSession, path)
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    named = texts.select(F.col(key).alias(key), F.col(text).cast("string").alias("x_text"))
    named = named.withColumn("hash", F.when(F.trim("x_text") != "", F.sha2("x_text", 256)))
    missing = named.filter("hash is not null").join(known.select("hash").distinct(), "hash", "left_anti").dropDuplicates(["hash"])
    predict = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch)
    # written before use, so that no later step asks the model again
    missing.repartition("hash").select("hash", predict("x_text").alias("vector")).write.mode("overwrite").parquet(f"{path}/run={run}")
    vectors = known_vectors(texts.sparkSession, path).select("hash", "vector", (F.col("run") == run).alias("fresh"))
    return stored(named.select(key, "hash").join(vectors, "hash", "left").select(key, "vector", F.coalesce("fresh", F.lit(False)).alias("fresh")), "embedded")
