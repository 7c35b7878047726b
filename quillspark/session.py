"""Sessions with sensible defaults, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: What one Arrow batch may hold, so that a Python worker's memory does not follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def get_session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times; `conf` overrides."""
    build = SparkSession.builder.appName(app)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in (defaults | conf).items():
        build = build.config(k, v)
    return build.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application, for Python functions that run there.

    Arrow batches that have Spark's own default size are made smaller in this session; others are left as they are set.
    """
    for key, default, mine in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, mine)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quill-"), "quillspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("quillspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
