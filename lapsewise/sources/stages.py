"""Stage tables: versions of Parquet tables in a shared folder, bucketed where joins ask for it.

A stage is a folder. Each write adds a version, a folder of its own, and then one small file that names it: the marker.
The highest marker is the stage. Nothing is overwritten, so a write that breaks anywhere leaves the version before it,
and readers of that version go on. ``prune`` removes versions that are no longer wanted.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import cache
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"
WHOLE_KEYS_CONF = "spark.sql.requireAllClusterKeysForCoPartition"
MARKERS = "_versions"


@dataclass(frozen=True)
class Version:
    """One written state of a stage; ``rows`` was observed while it was written."""

    number: int
    folder: str
    rows: int
    schema: str
    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0

    @property
    def table(self) -> str:
        """Name under which a bucketed version is known to the session's catalog."""
        return f"stage_{self.folder}"


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions of the stage at ``path``, the earliest first."""
    place, files = _at(spark, f"{path}/{MARKERS}")
    if not files.exists(place):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(place))
    return [_marked(spark, f"{path}/{MARKERS}/{name}") for name in names if name.endswith(".json")]


def _marked(spark: SparkSession, path: str) -> Version:
    place, files = _at(spark, path)
    stream = files.open(place)
    try:
        found = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def _mark(spark: SparkSession, path: str, version: Version) -> None:
    """Write the marker aside and give it its name: from then on the version is the stage."""
    spare, files = _at(spark, f"{path}/{MARKERS}/{version.folder}.new")
    stream = files.create(spare)
    try:
        stream.write(bytearray(json.dumps(asdict(version)).encode()))
    finally:
        stream.close()
    name, _ = _at(spark, f"{path}/{MARKERS}/{version.number:08d}-{version.folder}.json")
    if not files.rename(spare, name):
        raise OSError(f"{spare} could not be renamed to {name}")


def write_stage(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> DataFrame:
    """Add a version of the stage at ``path`` and read it back with a short lineage.

    With ``bucket_by`` the rows are dealt to ``buckets`` by these columns (a task per bucket), so that stages bucketed
    alike join without a shuffle. Rows are counted while they are written.
    """
    spark = df.sparkSession
    earlier = versions(spark, path)
    folder, seen = uuid.uuid4().hex, Observation()
    version = Version(
        number=earlier[-1].number + 1 if earlier else 1,
        folder=folder,
        rows=0,
        schema=df.schema.json(),
        partition_by=tuple(partition_by),
        bucket_by=tuple(bucket_by),
        buckets=buckets if bucket_by else 0,
    )
    if bucket_by:
        df = df.repartition(buckets, *bucket_by)
    writer = df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer.bucketBy(buckets, *bucket_by).option("path", f"{path}/{folder}").saveAsTable(version.table)
    else:
        writer.parquet(f"{path}/{folder}")
    version = Version(**asdict(version) | {"rows": seen.get["n_rows"]})
    _mark(spark, path, version)
    return _read(spark, path, version)


def _read(spark: SparkSession, path: str, version: Version) -> DataFrame:
    schema = StructType.fromJson(json.loads(version.schema))
    if not version.bucket_by:
        return spark.read.schema(schema).parquet(f"{path}/{version.folder}")
    if not spark.catalog.tableExists(version.table):
        quoted = lambda names: ", ".join(f"`{n}`" for n in names)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        split = f"partitioned by ({quoted(version.partition_by)})" if version.partition_by else ""
        spark.sql(
            f"create table {version.table} ({columns}) using parquet {split} "
            f"clustered by ({quoted(version.bucket_by)}) into {version.buckets} buckets location '{path}/{version.folder}'"
        )
        if version.partition_by:
            spark.sql(f"alter table {version.table} recover partitions")
    return spark.table(version.table).select(*[f"`{n}`" for n in schema.names])


def read_stage(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The stage at ``path``: its last version, or the one of that number."""
    found = [v for v in versions(spark, path) if number in (None, v.number)]
    if not found:
        raise FileNotFoundError(f"no version {number or ''} of a stage at {path}")
    return _read(spark, path, found[-1])


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins on more columns than the buckets' own use the buckets too.

    Spark shuffles such joins by default, for fear of skew; what is bucketed here is sums per month, of which no
    entity has many.
    """
    before = spark.conf.get(WHOLE_KEYS_CONF)
    spark.conf.set(WHOLE_KEYS_CONF, "false")
    try:
        yield
    finally:
        spark.conf.set(WHOLE_KEYS_CONF, before)


def _forget(spark: SparkSession, path: str) -> None:
    for version in versions(spark, path):
        if version.bucket_by:
            spark.sql(f"drop table if exists {version.table}")


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` versions of the stage, their markers first."""
    for version in versions(spark, path)[:-keep]:
        if version.bucket_by:
            spark.sql(f"drop table if exists {version.table}")
        for part in (f"{MARKERS}/{version.number:08d}-{version.folder}.json", version.folder):
            place, files = _at(spark, f"{path}/{part}")
            files.delete(place, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stage, or a folder of stages, if it is there."""
    place, files = _at(spark, path)
    if files.exists(place) and files.getFileStatus(place).isDirectory():
        for folder in [path, *(f"{path}/{f.getPath().getName()}" for f in files.listStatus(place))]:
            _forget(spark, folder)
    files.delete(place, True)


def observed_rows(df: DataFrame) -> int:
    """Rows of ``df``, counted while it is made in full; nothing is kept."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.format("noop").mode("overwrite").save()
    return seen.get["n_rows"]


_scratch: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of the application below the shared one, deleted when the application ends: for what no one reads later."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _scratch:
        path = f"{key[1]}/scratch-{uuid.uuid4().hex}"
        place, files = _at(spark, path)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _scratch[key] = path
    return _scratch[key]


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-", dir=tempfile.gettempdir())


def _on_this_machine(spark: SparkSession, folder: str) -> bool:
    """Whether the folder lies below a place that each machine has for itself."""
    place = urlparse(folder)
    if not place.scheme:
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS")
        place = urlparse(f"{default}".rstrip("/") + place.path) if default else place
    if place.scheme not in ("", "file"):
        return False
    own = {tempfile.gettempdir(), "/tmp", "/var/tmp", "/dev/shm", "/run"}
    return any(f"{place.path.rstrip('/')}/".startswith(f"{top.rstrip('/')}/") for top in own)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master.

    A folder below a machine's own temporary ones is refused on a cluster, where each machine would see another. Other
    local paths may be mounts that all machines share and are taken as they are.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    found = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if found:
        if not local and _on_this_machine(spark, found):
            raise ValueError(f"{found} lies on each machine by itself; set {CHECKPOINT_CONF} to a shared folder")
        return found.rstrip("/")
    if not local:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return _own_folder(context.applicationId)
