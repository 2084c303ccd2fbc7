"""The one place where sessions are configured."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere; ANSI arithmetic; adaptive plans. Parsed JSON is kept as one shared expression: pushing
#: pruned copies of the parse below each predicate costs more than it saves on wide predicates.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
    "spark.sql.sources.partitionOverwriteMode": "static",
}
#: Unbounded dedup state belongs on disk, not on the heap.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def session(app_name: str = "orderloom", master: str | None = None, state_on_disk: bool = True, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | (STATE if state_on_disk else {}) | more).getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Applies the run-time settings to a session that was built elsewhere."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def catalog_conf(name: str, warehouse: str, uri: str, user: str = "", password: str = "") -> dict[str, str]:
    """Session settings of a snapshot catalog over JDBC; its jar must be on the class path."""
    prefix = f"spark.sql.catalog.{name}"
    conf = {
        "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions",
        prefix: "org.apache.iceberg.spark.SparkCatalog", f"{prefix}.type": "jdbc", f"{prefix}.uri": uri, f"{prefix}.warehouse": warehouse,
        f"{prefix}.io-impl": "org.apache.iceberg.hadoop.HadoopFileIO",
    }
    return conf | ({f"{prefix}.jdbc.user": user, f"{prefix}.jdbc.password": password} if user else {})
