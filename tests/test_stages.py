import re
import tempfile

import pytest

from conftest import rows
from lapsewise.sources import stages


def test_write_replaces(spark, tmp_path):
    path = str(tmp_path / "stage")
    stages.write_stage(spark.range(10).toDF("a"), path)
    again = stages.write_stage(spark.range(3).toDF("b"), path)
    assert rows(again) == rows(stages.read_stage(spark, path)) == [(0,), (1,), (2,)]


def test_write_partitioned(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = spark.range(6).selectExpr("id", "id % 2 as part")
    back = stages.write_stage(df, path, ("part",))
    assert sorted(p.name for p in (tmp_path / "stage").glob("*/part=*")) == ["part=0", "part=1"]
    assert rows(back, "id", "part") == rows(df, "id", "part")


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "stage")
    stages.write_stage(spark.range(10).toDF("a"), path)
    with pytest.raises(Exception, match="no"):
        stages.write_stage(spark.range(3).selectExpr("raise_error('no') as b"), path)
    assert stages.read_stage(spark, path).count() == 10
    stages.remove(spark, path)
    stages.remove(spark, path)
    assert not (tmp_path / "stage").exists()


def test_a_write_that_breaks_before_its_marker_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stage")
    stages.write_stage(spark.range(10).toDF("a"), path)
    with monkeypatch.context() as broken:
        broken.setattr(stages, "_mark", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            stages.write_stage(spark.range(3).toDF("a"), path)
    assert stages.read_stage(spark, path).count() == 10
    assert stages.write_stage(spark.range(4).toDF("a"), path).count() == 4
    assert [v.number for v in stages.versions(spark, path)] == [1, 2]


def test_readers_of_an_earlier_version_go_on(spark, tmp_path):
    path = str(tmp_path / "stage")
    old = stages.write_stage(spark.range(10).toDF("a"), path)
    stages.write_stage(spark.range(3).toDF("a"), path)
    assert old.count() == 10
    assert stages.read_stage(spark, path, 1).count() == 10
    assert [(v.number, v.rows) for v in stages.versions(spark, path)] == [(1, 10), (2, 3)]
    stages.write_stage(spark.range(5).toDF("a"), path)
    stages.prune(spark, path, keep=2)
    assert [v.number for v in stages.versions(spark, path)] == [2, 3]
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, path, 1)
    assert stages.read_stage(spark, path).count() == 5


def test_bucketed_stages_join_without_a_shuffle(spark, tmp_path):
    one, other = (str(tmp_path / n) for n in ("one", "other"))
    df = spark.range(1000).selectExpr("id as entity_id", "id % 3 as chain", "id % 4 as month")
    a = stages.write_stage(df, one, ("month",), ("entity_id",), 3)
    b = stages.write_stage(df.selectExpr("entity_id", "chain", "month + 1 as later"), other, (), ("entity_id",), 3)
    assert a.columns == ["entity_id", "chain", "month"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with stages.co_located(spark):
            joined = a.join(b, ["entity_id", "chain"])
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            third = stages.write_stage(joined, str(tmp_path / "third"), ("month",), ("entity_id",), 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(third) == sorted(((k, k % 3, k % 4, k % 4 + 1) for k in range(1000)), key=repr)
    # another session defines the table anew
    spark.sql(f"drop table {stages.versions(spark, one)[0].table}")
    assert rows(stages.read_stage(spark, one)) == rows(df)
    assert stages.versions(spark, one)[0].rows == 1000
    stages.remove(spark, str(tmp_path))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]


class Context:
    def __init__(self, master):
        self.master, self.folder, self.applicationId = master, None, f"test-{id(self)}"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    """As much of a session as the folder depends on."""

    def __init__(self, master, configured=None, default_fs="file:///"):
        self.sparkContext, self.conf = Context(master), self
        self.configured, self.default_fs = configured, default_fs
        self._jsc = self

    def hadoopConfiguration(self):
        return {"fs.defaultFS": self.default_fs}

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.configured or default


def test_shared_folder_comes_from_the_session():
    assert stages.shared_dir(Session("spark://somewhere:7077", "/shared")) == "/shared"
    assert stages.shared_dir(Session("local[4]", "/shared")) == "/shared"


def test_local_session_gets_its_own_folder_once():
    session = Session("local[4]")
    made = stages.shared_dir(session)
    assert re.fullmatch(re.escape(tempfile.gettempdir()) + "/run-[^/]+", made)
    assert stages.shared_dir(session) == made
    assert session.sparkContext.folder is None


@pytest.mark.parametrize("temporary", [None, "/srv/own"])
@pytest.mark.parametrize("folder", [None, "/tmp/x", "file:///tmp/x", "/tmp", "/var/tmp/x"])
def test_no_local_folder_on_a_cluster(folder, temporary, monkeypatch):
    if temporary:
        monkeypatch.setattr(tempfile, "tempdir", temporary)
    with pytest.raises(ValueError):
        stages.shared_dir(Session("spark://somewhere:7077", folder))


def test_the_temporary_folder_of_the_driver_is_local_too(monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", "/srv/own")
    with pytest.raises(ValueError):
        stages.shared_dir(Session("spark://somewhere:7077", "file:/srv/own/x"))


@pytest.mark.parametrize("folder", ["hdfs://names/tmp/x", "file:///mnt/all/x", "/tmpfs/x"])
def test_shared_folders_on_a_cluster(folder):
    assert stages.shared_dir(Session("spark://somewhere:7077", folder)) == folder


def test_a_path_without_scheme_lies_on_the_default_file_system():
    assert stages.shared_dir(Session("spark://somewhere:7077", "/tmp/x", "hdfs://names")) == "/tmp/x"
