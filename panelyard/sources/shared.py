"""Shared tables pinned by version: verified copies between folders, an atomic switch, and readers that keep their version.

A published folder has files and a manifest of their checksums. A local folder keeps copies under ``objects``, each named by
its own checksum, and under ``versions`` a manifest for each version, numbered in the order of their arrival. The last one is current.
Copies are made and checked on the executors, in blocks, and come to ``objects`` by a rename; a version's manifest follows
once all its files are there, also by a rename. So a crash anywhere leaves the version before readable, and a reader that has
pinned a version reads the same bytes whatever is published meanwhile.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators import authority
from panelyard.sources import files

MANIFEST = "manifest.sha256"
BLOCK = 1 << 20


class SharedDataError(RuntimeError):
    """The shared tables can't be brought up to date or read."""


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _exists(uri: str) -> bool:
    store, path = _at(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def _read(uri: str) -> str:
    store, path = _at(uri)
    with store.open_input_stream(path) as f:
        return f.read().decode()


def _write(uri: str, text: str) -> None:
    """All of it or nothing: under another name first."""
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    early = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(early) as f:
        f.write(text.encode())
    store.move(early, path)


def manifest_text(entries: dict[str, str]) -> str:
    """A line a file, checksum and name, in order of name, with plain line ends."""
    return "".join(f"{sha}  {name}\n" for name, sha in sorted(entries.items()))


def manifest_entries(text: str) -> dict[str, str]:
    """Name and checksum of each line; a star before a name says that it was read as bytes."""
    pairs = [line.split(maxsplit=1) for line in text.splitlines() if line.strip()]
    if any(len(p) != 2 or not re.fullmatch(r"[0-9a-f]{64}", p[0]) for p in pairs):
        raise SharedDataError("a line of the manifest is no checksum and name")
    return {name.strip().removeprefix("*"): sha for sha, name in pairs}


def _through(source: str, target: str | None) -> str:
    """Checksum of a file, which is copied on the way if there is a target; a block is held at a time."""
    store, path = _at(source)
    digest = hashlib.sha256()
    sink = None
    if target:
        out, to = _at(target)
        out.create_dir(to.rsplit("/", 1)[0], recursive=True)
        sink = out.open_output_stream(to)
    try:
        with store.open_input_stream(path) as f:
            while block := f.read(BLOCK):
                digest.update(block)
                if sink:
                    sink.write(block)
    finally:
        if sink:
            sink.close()
    return digest.hexdigest()


def _each(spark: SparkSession, names: Sequence[str], folder: str, staging: str | None) -> list[tuple[str, str, str]]:
    """(name, checksum, staged path) of files, a task each on the executors; what a lost task staged is never used."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                target = f"{staging}/{uuid.uuid4().hex}" if staging else None
                yield pa.RecordBatch.from_pylist([{"name": name, "sha": _through(f"{folder}/{name}", target), "staged": target or ""}])

    if not names:
        return []
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names))
    return [tuple(r) for r in rows.mapInArrow(run, "name string, sha string, staged string").collect()]


def publish(spark: SparkSession, folder: str, names: Sequence[str], *, manifest: str | None = None) -> str:
    """Write the manifest of files that lie in ``folder``, there or at ``manifest``; returns the version."""
    entries = {name: sha for name, sha, _ in _each(spark, names, folder, None)}
    _write(manifest or f"{folder}/{MANIFEST}", manifest_text(entries))
    return files.manifest_version(entries)


def _versions(local: str) -> list[str]:
    """Manifest files of a local folder, oldest first."""
    store, path = _at(f"{local}/versions")
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(i.base_name for i in found if re.fullmatch(r"\d{9}-[0-9a-f]{12}", i.base_name))


def current(local: str) -> str | None:
    """The version that readers get who pin none."""
    have = _versions(local)
    return have[-1].split("-")[1] if have else None


def entries(local: str, version: str | None = None) -> dict[str, str]:
    """The manifest of a version, by default the current one."""
    have = [v for v in _versions(local) if version is None or v.endswith("-" + version)]
    if not have:
        raise SharedDataError(f"no version {version} in {local}" if version else f"{local} has no shared data and no folder to take it from was found")
    return manifest_entries(_read(f"{local}/versions/{have[-1]}"))


def sync(spark: SparkSession, shared: str | None, local: str, *, manifest: str | None = None) -> DataFrame:
    """(name, status) after bringing ``local`` up to date with ``shared``: copy, up-to-date or remove. The manifest may lie elsewhere.

    Only files whose checksum isn't there yet are copied. A copy that doesn't have the manifest's checksum raises, and the
    version before stays current. Without a shared folder, or with one without a manifest, the local version is kept.
    """
    if shared is None or not _exists(manifest or f"{shared}/{MANIFEST}"):
        return _table(spark, {name: "up-to-date" for name in entries(local)})
    want = manifest_entries(_read(manifest or f"{shared}/{MANIFEST}"))
    before = entries(local) if _versions(local) else {}
    missing = sorted({sha: name for name, sha in want.items() if not _exists(f"{local}/objects/{sha}")}.items())
    staging = f"{local}/staging/{uuid.uuid4().hex}"
    try:
        made = _each(spark, [name for _, name in missing], shared, staging)
        wrong = [name for name, sha, _ in made if sha != want[name]]
        if wrong:
            raise SharedDataError(f"{sorted(wrong)} differ from the manifest; they may still be on their way")
        store, objects = _at(f"{local}/objects")
        store.create_dir(objects, recursive=True)
        for _, sha, staged in made:
            store.move(_at(staged)[1], f"{objects}/{sha}")
    finally:
        store, path = _at(staging)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)
    if want != before:
        _switch(local, want)
    status = {n: "up-to-date" if before.get(n) == want[n] else "copy" for n in want} | {n: "remove" for n in before if n not in want}
    return _table(spark, status)


def _switch(local: str, want: dict[str, str]) -> None:
    have = _versions(local)
    number = int(have[-1].split("-")[0]) + 1 if have else 1
    _write(f"{local}/versions/{number:09d}-{files.manifest_version(want)}", manifest_text(want))


def _table(spark: SparkSession, status: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(status.items()), "name string, status string")


def prune(local: str, *, keep: int = 2) -> int:
    """Forget all versions but the last ``keep`` and delete objects that none of these names; returns how many objects went."""
    have = _versions(local)
    store, versions = _at(f"{local}/versions")
    for v in have[: max(0, len(have) - max(1, keep))]:
        store.delete_file(f"{versions}/{v}")
    used = {sha for v in _versions(local) for sha in manifest_entries(_read(f"{local}/versions/{v}")).values()}
    _, objects = _at(f"{local}/objects")
    gone = [i for i in store.get_file_info(fs.FileSelector(objects, allow_not_found=True)) if i.base_name not in used]
    for i in gone:
        store.delete_file(i.path)
    return len(gone)


def plain_types(df: DataFrame) -> DataFrame:
    """Columns in the plain type of their kind: whole numbers as bigint, other numbers as double; the rest stays."""
    kind = lambda t: "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.FractionalType) else None
    return df.select(*[F.col(f"`{f.name}`").cast(kind(f.dataType)).alias(f.name) if kind(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def load(spark: SparkSession, local: str, name: str, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None, *, version: str | None = None, date_column: str = "date") -> DataFrame:
    """A shared table as one version has it, chosen columns between two dates, both of which reach the scan.

    A table is the file ``name.parquet``, or all files below a folder of that name. The paths are those of the version's objects,
    so the plan that comes back goes on reading that version after the next switch.
    """
    found = entries(local, version)
    parts = [f"{local}/objects/{sha}" for file, sha in sorted(found.items()) if file == f"{name}.parquet" or file.startswith(f"{name}.parquet/")]
    if not parts:
        raise SharedDataError(f"{name}.parquet is not in the shared data; there are {sorted(found)}")
    return plain_types(files.between(spark.read.parquet(*parts), columns, start, end, date_column=date_column))


def load_live(spark: SparkSession, local: str, name: str, looks: DataFrame, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None, *, holdout_end: str, version: str | None = None, date_column: str = "date") -> DataFrame:
    """Rows after a sealed holdout, once its single look is spent: the window has to begin behind the holdout's end."""
    if start is None:
        raise PermissionError("a live read needs a first day")
    authority.guard_window(start, end or "9999-12-31", after=holdout_end)
    if not authority.look_spent(looks).first()["spent"]:
        raise PermissionError("the holdout's look isn't spent: live rows stay closed")
    return load(spark, local, name, columns, start, end, version=version, date_column=date_column)
