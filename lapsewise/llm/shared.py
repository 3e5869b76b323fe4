"""Tables written to the folder that every executor sees, places of rows, and column names that clash with none."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.sources import stages


def folder(spark: SparkSession) -> str:
    """A folder that all executors see and that goes when the application ends: below ``spark.checkpoint.dir``.

    Where that is unset, it is a new temporary folder, on a local master only.
    """
    found = stages.scratch(spark)
    return found if urlparse(found).scheme or not spark.sparkContext.master.startswith("local") else f"file://{found}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under a new name in the shared folder and read back: it survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What may stand above a scan whose rows are each one row of a file.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias"}


def place(docs: DataFrame) -> Column:
    """Where each row of a ``scan`` lies: a hash of its file's name and its number there.

    It is the same in every read, however the files are split among tasks.
    """
    meta = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows are rows of Parquet files, else ``docs`` written and read back, so that rows have a place."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROW_BY_ROW:
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            docs.select(place(docs))
        except AnalysisException:  # files of a kind that does not number its rows
            return stored(docs)
        return docs
    return stored(docs)


def fresh(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (in either case)."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to the executors' Python once, as ``--py-files`` would."""
    _ship(spark.sparkContext.applicationId)
    return spark


@cache
def _ship(application: str) -> None:
    package = Path(__file__).resolve().parents[1]
    # read by the driver alone, which serves it to the executors
    target = Path(tempfile.mkdtemp(prefix="lapsewise-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, f"{package.name}/{source.relative_to(package)}")
    SparkSession.active().sparkContext.addPyFile(str(target))
