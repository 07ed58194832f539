import os

from terrane import session


def test_tables_in_the_shared_folder(spark):
    df = spark.range(10).withColumnRenamed("id", "a")
    t = session.materialize(df)
    assert t._terrane_url.startswith(session.shared_dir(spark)) and t.dtypes == df.dtypes
    assert session.size_of(t) > 0 and "FileScan" in t._jdf.queryExecution().executedPlan().toString()
    u = session.materialize(df)
    assert session.together([t, u]).count() == 20
    session.release(t, None, df)
    assert not os.path.exists(t._terrane_url.removeprefix("file://")) and u.count() == 10
    session.release(u)


class Named:
    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return "hdfs://name/shared/" if key == "spark.checkpoint.dir" else default


def test_the_session_names_the_folder():
    assert session.shared_dir(Named()) == "hdfs://name/shared"


def test_no_local_checkpoints():
    root = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    for folder, _, files in os.walk(os.path.join(root, "terrane")):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert "localCheckpoint(" not in text and "crossJoin(" not in text, f
