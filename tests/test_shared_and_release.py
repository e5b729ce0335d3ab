"""Pinned versions of shared tables through updates, crashes and damaged files, and digests of tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from panelyard.operators import release
from panelyard.sources import shared


def put(spark, folder, name, values):
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=i), v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "date date, v int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/tmp-{name}")
    (part,) = (folder / f"tmp-{name}").glob("part-*.parquet")
    target = folder / f"{name}.parquet"
    target.write_bytes(part.read_bytes())


@pytest.fixture
def place(spark, tmp_path):
    drive, local = tmp_path / "drive", tmp_path / "local"
    drive.mkdir()
    put(spark, drive, "one", [1, 2, 3])
    put(spark, drive, "two", [10, None])
    version = shared.publish(spark, str(drive), ["one.parquet", "two.parquet"])
    return drive, str(local), version


def status(df):
    return {r["name"]: r["status"] for r in df.collect()}


def test_versions_arrive_change_and_stay_readable(spark, place):
    drive, local, first = place
    assert status(shared.sync(spark, str(drive), local)) == {"one.parquet": "copy", "two.parquet": "copy"} and shared.current(local) == first
    assert status(shared.sync(spark, str(drive), local)) == {"one.parquet": "up-to-date", "two.parquet": "up-to-date"}
    pinned = shared.load(spark, local, "one")
    put(spark, drive, "one", [7, 8, 9, 10])
    second = shared.publish(spark, str(drive), ["one.parquet"])
    assert status(shared.sync(spark, str(drive), local)) == {"one.parquet": "copy", "two.parquet": "remove"} and shared.current(local) == second != first
    assert shared.load(spark, local, "one").count() == 4 and pinned.count() == 3, "a plan keeps the version that it was made with"
    assert shared.load(spark, local, "two", version=first).count() == 2
    with pytest.raises(shared.SharedDataError, match="two.parquet is not"):
        shared.load(spark, local, "two")
    assert shared.prune(local, keep=2) == 0 and shared.prune(local, keep=1) == 2
    assert shared.load(spark, local, "one").count() == 4
    with pytest.raises(shared.SharedDataError):
        shared.entries(local, first)


def test_a_damaged_file_or_a_crash_leaves_the_version_before(spark, place, monkeypatch):
    drive, local, first = place
    shared.sync(spark, str(drive), local)
    put(spark, drive, "one", [5])
    shared.publish(spark, str(drive), ["one.parquet", "two.parquet"])
    good = (drive / "one.parquet").read_bytes()
    (drive / "one.parquet").write_bytes(good[:-3])
    with pytest.raises(shared.SharedDataError, match="one.parquet"):
        shared.sync(spark, str(drive), local)
    assert shared.current(local) == first and shared.load(spark, local, "one").count() == 3
    (drive / "one.parquet").write_bytes(good)

    def crash(*_):
        raise OSError("no power")

    with monkeypatch.context() as m:
        m.setattr(shared, "_switch", crash)
        with pytest.raises(OSError):
            shared.sync(spark, str(drive), local)
    assert shared.current(local) == first and shared.load(spark, local, "one").count() == 3
    shared.sync(spark, str(drive), local)
    assert shared.load(spark, local, "one").count() == 1


def test_without_a_folder_the_local_version_stays(spark, place, tmp_path):
    drive, local, first = place
    with pytest.raises(shared.SharedDataError):
        shared.sync(spark, None, local)
    shared.sync(spark, str(drive), local)
    assert status(shared.sync(spark, str(tmp_path / "nowhere"), local)) == {"one.parquet": "up-to-date", "two.parquet": "up-to-date"}
    assert shared.current(local) == first


def test_manifests_and_bounds(spark, place):
    drive, local, _ = place
    text = (drive / shared.MANIFEST).read_bytes()
    assert b"\r" not in text and shared.manifest_entries(text.decode()) == shared.manifest_entries(text.decode().replace("  ", " *").replace("\n", "\r\n"))
    with pytest.raises(shared.SharedDataError):
        shared.manifest_entries("nonsense line\n")
    shared.sync(spark, str(drive), local)
    got = shared.load(spark, local, "one", ["v"], "2020-01-02", "2020-01-02")
    assert got.dtypes == [("v", "bigint")] and [r["v"] for r in got.collect()] == [2]
    looks = spark.createDataFrame([("p", "opened", ["synthetic"])], "protocol string, event string, tags array<string>")
    spent = looks.unionAll(spark.createDataFrame([("p", "opened", ["real"])], looks.schema))
    live = lambda looks, start: shared.load_live(spark, local, "one", looks, start=start, holdout_end="2020-01-01")
    assert live(spent, "2020-01-02").count() == 2
    for bad in (lambda: live(looks, "2020-01-02"), lambda: live(spent, "2020-01-01"), lambda: live(spent, None)):
        with pytest.raises(PermissionError):
            bad()


def test_identity_ignores_layout_and_sees_every_cell(spark, tmp_path):
    rows = [(i % 50, f"n{i % 7}", None if i % 11 == 0 else i / 4) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    whole = release.identity(df)
    assert release.identity(df.repartition(7, "b").orderBy(F.desc("c")).select("c", "a", "b")) == whole
    changed = df.withColumn("c", F.when((F.col("a") == 3) & (F.col("c") == 0.75), F.lit(0.76)).otherwise(F.col("c")))
    assert release.identity(changed) != whole and release.identity(df.unionAll(df.limit(1))) != whole
    assert release.identity(df.limit(0)) != whole
    parts = release.differing_parts(df, changed).collect()
    assert 1 <= len(parts) <= 2
    assert {(r["row"], r["ours"], r["theirs"]) for r in release.differing_rows(df, changed).collect()} == {('["3","n3","0.75"]', 1, 0), ('["3","n3","0.76"]', 0, 1)}
    record = release.export(df, str(tmp_path / "out"))
    assert record["identity"] == whole and record["rows"] == 600 and release.verified(spark, str(tmp_path / "out")).count() == 600
    changed.write.mode("overwrite").parquet(str(tmp_path / "out" / "table"))
    with pytest.raises(ValueError, match="released"):
        release.verified(spark, str(tmp_path / "out"))
