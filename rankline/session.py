"""Session helpers: local session for tests/bench, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and bench. On a cluster, the platform's session is used."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder there. When it is unset, a local session (one JVM)
    gets a scratch folder; any other master is refused, since its executors would not
    share a folder of the driver's machine.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        current = tempfile.mkdtemp(prefix="rankline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder (for staging tables, landing dirs)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *[p.strip("/") for p in parts]])


def cut_lineage(df):
    """``df.checkpoint()`` into the shared checkpoint folder (eager): the plan is computed
    once, written reliably, and later reads start from the files.

    A checkpoint keeps the size estimate of the plan it cuts, and that of a join is the product
    of its sides. Where rounds join what earlier rounds left, its digits double with every round
    (25 rounds: numbers of many megabytes on the driver). Past 64 bits it tells nothing and is
    dropped: the rows then count as of unknown size, and AQE goes by what it measures."""
    ensure_checkpoint_dir(df.sparkSession)
    cut = df.checkpoint(eager=True)
    plan = cut._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() < 64:
        return cut
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.logical().rdd(), cut._jdf.schema(), False), spark)
