"""The table digest: of sparse keys, whatever the partitions, and of changed rows."""

from pyspark.sql import functions as F

from gridloom.operators import contracts as K


def test_sparse_keys(spark):
    df = spark.range(3_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("v")).dropDuplicates(["k"])
    digest = lambda d: tuple(K.table_digest(d, "k", ["v"], span=16).first())
    one = digest(df)
    assert one == digest(df.repartition(13)) and one[1] == df.count()
    least = df.agg(F.min("k")).first()[0]
    assert digest(df.withColumn("v", F.when(F.col("k") == least, F.lit(9)).otherwise(F.col("v"))))[0] != one[0]
