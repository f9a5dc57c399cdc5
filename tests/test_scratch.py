from plumbline import scratch


def test_clean(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_made", [])
    assert scratch.written(spark.range(5), "some").count() == 5
    [at] = map(spark._jvm.org.apache.hadoop.fs.Path, scratch._made)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    scratch.path(spark, "never-written")
    assert fs.exists(at) and scratch.clean() == 1 and not fs.exists(at)
    assert scratch._made == [] and scratch.clean() == 0
