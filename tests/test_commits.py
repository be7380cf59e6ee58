"""Versions of several tables: what a manifest makes visible, and what a stop or a second writer leaves."""

import pytest

from tideline.operators import commits


def rows(spark, *values):
    return spark.createDataFrame([(v, str(v)) for v in values], "a long, b string")


def test_a_stop_before_the_manifest_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert commits.manifest(spark, root) is None and commits.versions(spark, root) == []
    assert commits.commit(spark, root, {"x": rows(spark, 1, 2), "y": rows(spark, 7)}) == 1
    staged = commits.stage(spark, root, {"x": rows(spark, 1, 2, 3), "y": rows(spark)})
    assert commits.read(spark, root, "x").count() == 2 and commits.read(spark, root, "y").count() == 1
    assert commits.publish(spark, root, staged, 2) == 2
    assert commits.read(spark, root, "x").count() == 3 and commits.read(spark, root, "y").count() == 0
    assert commits.read(spark, root, "x", 1).count() == 2


def test_a_manifest_that_is_cut_off_is_none(spark, tmp_path):
    root = f"file://{tmp_path}"
    commits.commit(spark, root, {"x": rows(spark, 1)})
    (tmp_path / "manifests" / "000000002.json").write_text('{"version": 2, "tab')
    assert commits.manifest(spark, root)["version"] == 1
    assert commits.commit(spark, root, {"x": rows(spark, 2)}) == 3  # the number is taken


def test_of_two_writers_one_gets_the_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    commits.commit(spark, root, {"x": rows(spark, 1)})
    staged = commits.stage(spark, root, {"x": rows(spark, 2)})
    commits.append(spark, root, {"x": rows(spark, 3)})
    with pytest.raises(commits.Conflict):
        commits.publish(spark, root, staged, 2)
    seen, real = [], commits.versions
    monkeypatch.setattr(commits, "versions", lambda *a: real(*a)[: -1 if not seen and not seen.append(1) else None])  # as it was before the other
    assert commits.append(spark, root, {"x": rows(spark, 4)}) == 3
    got = commits.read(spark, root, "x", added_in="v").collect()
    assert sorted((r.a, r.v) for r in got) == [(1, 1), (3, 2), (4, 3)]
    with pytest.raises(ValueError):
        commits.append(spark, root, {"x": spark.range(1)})


def test_digests_find_changed_rows_and_vacuum_what_nothing_names(spark, tmp_path):
    root = f"file://{tmp_path}"
    commits.commit(spark, root, {"x": rows(spark, *range(20)).repartition(3), "m": spark.sql("select map('a', 1) as m")})
    assert commits.broken(spark, root) == []
    assert commits.measure(rows(spark, *range(20)).repartition(5)) == commits.measure(rows(spark, *range(19, -1, -1)))
    commits.stage(spark, root, {"x": rows(spark, 1)})
    commits.commit(spark, root, {"x": rows(spark, 5)})
    gone = commits.vacuum(spark, root)
    assert len(gone) == 3 and commits.read(spark, root, "x").count() == 1 and commits.read(spark, root, "m").count() == 1
    folder = commits.manifest(spark, root)["tables"]["x"]["parts"][0]["folder"]
    rows(spark, 6).write.mode("overwrite").parquet(f"{root}/{folder}")
    assert commits.broken(spark, root) == [folder]
