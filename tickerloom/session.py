"""Session defaults. A cluster's own settings win; these only fill gaps for tests and bench."""

from pyspark.sql import SparkSession


def build_session(master="local[8]", app="tickerloom", shuffle_partitions=8, memory="12g"):
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
