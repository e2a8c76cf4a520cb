"""Tables written once to the folder that driver and executors share, to end lineage between rounds of a loop.

All of a session lie in one folder of its own below it, which ``clear`` removes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions for which none is named.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's folder in the one that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode, where that is
    unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="orrery-")
        folder = _LOCAL[app]
    return f"{folder.rstrip('/')}/orrery-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors cost nothing made before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this session has written there. Only when every result made from it is written elsewhere; a session's last step."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
