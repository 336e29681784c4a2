import pytest

from sparkloom.staging import balanced, checkpoint, discard, free_name, scratch


def test_small_tables_in_few_parts_are_dealt_anew(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = balanced(docs)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
    many = docs.repartition(50)
    assert balanced(many) is many


def test_checkpoints_names_and_scratch(spark):
    df = spark.range(5)
    assert checkpoint(df).count() == 5
    path = scratch(spark, "x")
    df.write.parquet(path)
    assert spark.read.parquet(path).count() == 5
    discard(spark, path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    assert free_name(df.selectExpr("id", "1 as A", "2 as _a"), "a") == "__a"


def test_a_table_that_meets_every_row_is_bounded(spark):
    from sparkloom.staging import with_each

    few = spark.range(3).withColumnRenamed("id", "k")
    assert with_each(spark.range(5), few, 3).count() == 15
    with pytest.raises(ValueError):
        with_each(spark.range(5), few, 2)
