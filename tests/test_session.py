"""Session helpers: checkpoint folder, code shipping, cluster sizing."""

from dupstream import session as SS


def test_checkpoint_dir_is_set_once(spark):
    first = SS.ensure_checkpoint_dir(spark)
    assert first and SS.ensure_checkpoint_dir(spark) == first


def test_package_is_shipped_once(spark):
    SS.ship_package(spark)
    SS.ship_package(spark)     # second call is a no-op
    assert spark.sparkContext.applicationId in SS._SHIPPED
    # a Python worker can import the package
    got = spark.sparkContext.parallelize([1], 1).map(lambda _: __import__("dupstream").__version__).collect()
    assert got == [__import__("dupstream").__version__]


def test_cluster_settings_scale_with_input():
    small = SS.cluster_settings(10 << 30, 64)
    big = SS.cluster_settings(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) >= 128
    assert int(big["spark.sql.shuffle.partitions"]) == SS.MAX_SHUFFLE_PARTITIONS
    assert int(big["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) > 256 << 20
    assert small["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(256 << 20)
