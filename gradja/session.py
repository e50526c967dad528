"""Session settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gradja", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; anything given wins, the master is left to the cluster."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster sets it in spark.checkpoint.dir.

    It is left as it is set. Where none is set, a session on one machine gets a temporary
    one, as in tests; on a cluster that is an error, since executors would not see it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            import tempfile

            named = tempfile.mkdtemp(prefix="gradja-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession) -> str:
    """A new name inside the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
