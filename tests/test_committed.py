"""The committing sink: whole or not at all, once, hidden by overwriting."""

import os

import pytest

from quern.sources import committed
from quern.sources.committed import PagesWriter, Staged, manifests


def rows(spark, ids, name="p"):
    return spark.createDataFrame([(f"{name}{k}", f"http://a.org/{k}", None if k == 3 else f"# é {k}\n") for k in ids], "name string, url string, content string")


def read(spark, path):
    return sorted(map(tuple, spark.read.format("quern_pages").load(path).collect()))


def written(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)


@pytest.mark.parametrize("files", ["parts", "pages"])
def test_append_repeat_and_overwrite(spark, tmp_path, files):
    committed.register(spark)
    path = f"file://{tmp_path}/out"
    save = lambda df, job, mode="append": df.write.format("quern_pages").mode(mode).option("job", job).option("files", files).save(path)
    assert read(spark, path) == []
    save(rows(spark, range(6)).repartition(3), "one")
    before = written(tmp_path)
    save(rows(spark, range(50)), "one")  # the same job again
    assert written(tmp_path) == before and len(read(spark, path)) == 6
    save(rows(spark, [8, 9]), "two")
    held = read(spark, path)
    assert [x[0] for x in held] == ["p0", "p1", "p2", "p3", "p4", "p5", "p8", "p9"] and held[4][2] == "# é 4\n" and (held[3][2] or "") == ""
    assert [m["pages"] for m in manifests(path)] == [6, 2] and not os.path.exists(f"{tmp_path}/out/_staging/one")
    save(rows(spark, [1]), "three", "overwrite")
    assert [x[0] for x in read(spark, path)] == ["p1"]


def test_a_task_that_dies_leaves_nothing_to_read(spark, tmp_path):
    committed.register(spark)
    path = f"file://{tmp_path}/out"
    bad = rows(spark, range(20)).union(rows(spark, [1], "no/")).repartition(4)
    with pytest.raises(Exception, match="cannot be called"):
        bad.write.format("quern_pages").mode("append").option("job", "one").save(path)
    assert read(spark, path) == [] and not any("staging" in f for f in written(tmp_path))


def test_a_driver_that_dies_before_the_manifest(spark, tmp_path):
    committed.register(spark)
    path = f"file://{tmp_path}/out"

    class Row:
        def __init__(self, name):
            self.name, self.url, self.content = name, "u", name

    dead = PagesWriter({"path": path, "job": "one"}, False)
    lost, kept = dead.write(iter([Row("lost")])), dead.write(iter([Row("a"), Row("b")]))
    assert isinstance(kept, Staged) and kept.pages == 2 and read(spark, path) == []  # staged, not committed
    os.makedirs(f"{tmp_path}/out/pages/one")
    os.rename(f"{tmp_path}/out/_staging/{lost.folder}", f"{tmp_path}/out/pages/one/000000")  # half moved
    assert read(spark, path) == []
    again = PagesWriter({"path": path, "job": "one"}, False)
    again.commit([again.write(iter([Row("a"), Row("b")])), None])
    assert [x[0] for x in read(spark, path)] == ["a", "b"] and not any("staging" in f or "lost" in f for f in written(tmp_path))


def test_columns_and_options_are_checked(spark, tmp_path):
    committed.register(spark)
    with pytest.raises(Exception, match="need columns"):
        spark.range(1).write.format("quern_pages").mode("append").save(f"file://{tmp_path}/o")
    with pytest.raises(ValueError):
        PagesWriter({"path": "x", "files": "zip"}, False)
