"""Sinks: delivery CSV and JSON, and the write rules of packets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import filled
from .bundle import EvidenceError


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def make_dirs(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    a, fs_a = _path(spark, source)
    b, fs_b = _path(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, True, spark._jsc.hadoopConfiguration())


def move(spark: SparkSession, source: str, target: str) -> None:
    a, fs = _path(spark, source)
    b, _ = _path(spark, target)
    if not fs.rename(a, b):
        raise EvidenceError(f"can't move {source} to {target}")


def sha256(spark: SparkSession, pieces: list[bytes | str]) -> str:
    """The digest of bytes and of files (paths), one after another; files are streamed, never held."""
    jvm = spark._jvm
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    for piece in pieces:
        if isinstance(piece, bytes):
            digest.update(bytearray(piece))
        else:
            p, fs = _path(spark, piece)
            stream = jvm.java.security.DigestInputStream(fs.open(p), digest)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
    return bytes(digest.digest()).hex()


def _editable(spark: SparkSession, path: str) -> None:
    """Drops a local file's checksum file, which a later edit by hand would not match."""
    folder, _, name = path.rpartition("/")
    remove(spark, f"{folder}/.{name}.crc")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a temporary name, so that a reader sees the old file or the new one."""
    p, fs = _path(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)
    _editable(spark, path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a whole file unless there is one at ``path``; whether this call wrote it. Of any number of callers one does.

    The text is written beside it under a hidden name first. On a local file system a hard link gives it its name, elsewhere
    a rename, which HDFS refuses where the name is taken. A store whose rename replaces what is there can have one writer only.
    """
    folder, _, name = path.rpartition("/")
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    write_text(spark, tmp, text)
    p, fs = _path(spark, path)
    here, _ = _path(spark, tmp)
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(p) and fs.rename(here, p)
        files = spark._jvm.java.io.File
        spark._jvm.java.nio.file.Files.createLink(files(p.toUri().getPath()).toPath(), files(here.toUri().getPath()).toPath())
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        remove(spark, tmp)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; hidden names are left out, and a folder that isn't there holds nothing."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def _copy_task(target: str, pieces: list[str]):
    """For an executor that sees the files under their local names: appends them to a new file, which takes its name when it
    is whole, so that another attempt at the task does no harm."""

    def run(batches):
        import os
        import shutil
        import uuid

        for _ in batches:
            pass
        folder, name = os.path.split(target)
        tmp = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(tmp, "wb") as out:
            for piece in pieces:
                with open(piece, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        os.replace(tmp, target)
        yield from ()

    return run


def join_files(spark: SparkSession, pieces: list[str], target: str) -> None:
    """One file of the pieces' bytes in their order; the pieces go.

    Where the file system can join files (HDFS) no byte moves. Local files are copied by a task on an executor, and files of
    another store through the driver's JVM, a buffer at a time.
    """
    paths = [_path(spark, x)[0] for x in pieces]
    goal, fs = _path(spark, target)
    fs.delete(goal, True)
    if fs.getUri().getScheme() == "file":
        names = [p.toUri().getPath() for p in paths]
        spark.range(1, numPartitions=1).mapInArrow(_copy_task(goal.toUri().getPath(), names), "id long").write.format("noop").mode("overwrite").save()
    else:
        try:
            if len(paths) > 1:
                rest = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(paths) - 1)
                for k, p in enumerate(paths[1:]):
                    rest[k] = p
                fs.concat(paths[0], rest)
            move(spark, pieces[0], target)
        except UnsupportedOperationException:
            out = fs.create(goal, True)
            try:
                for p in paths:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(p), out, 1 << 20, False)
            finally:
                out.close()
    for x in pieces:
        remove(spark, x)
    _editable(spark, target)


def _part_files(spark: SparkSession, folder: str) -> list[str]:
    """The files that tasks wrote, by their tasks' order; empty ones are left out."""
    p, fs = _path(spark, folder)
    found = [s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getLen()]
    return sorted(s.getPath().toString() for s in found)


def write_csv(df: DataFrame, path: str, columns: list[str], sort: list | None = None) -> None:
    """One CSV file at ``path`` with these columns in this order (missing ones blank, others left out).

    Tasks write their ranges of the order side by side, without a header, and the files are joined behind one.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    out = df.orderBy(*sort) if sort else df
    out = out.select([filled(F.col(f"`{c}`")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    parts = f"{path}.parts"
    writer = out.write.mode("overwrite").option("header", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("emptyValue", "").option("nullValue", "").option("escape", '"').option("quote", '"').csv(parts)
    shown = ('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in columns)
    write_text(spark, f"{parts}/header", ",".join(shown) + "\n")
    join_files(spark, [f"{parts}/header", *_part_files(spark, parts)], path)
    remove(spark, parts)


def write_json_with_list(df: DataFrame, path: str, before: dict, name: str, after: dict, key: list[str], row: Callable[[dict], dict]) -> None:
    """A JSON object: ``before``, then ``name`` with an element for each row, then ``after``; as ``write_json`` writes it.

    Rows are ordered by ``key``, which is unique. Tasks turn them into elements and write their ranges side by side; the
    driver adds what stands before and after, and the last element, which no comma follows.
    """
    import textwrap

    from pyspark.sql import functions as F

    spark = df.sparkSession
    text = lambda value: textwrap.indent(json.dumps(value, ensure_ascii=False, indent=2), "    ")
    last = df.orderBy(*[F.desc(c) for c in key]).limit(1).collect()
    head = json.dumps(before, ensure_ascii=False, indent=2).removesuffix("}").rstrip()
    tail = "".join(f",\n  {line}" for line in json.dumps(after, ensure_ascii=False, indent=2)[4:-2].split(",\n  ") if after) + "\n}\n"
    head += "," * bool(before) + f'\n  {json.dumps(name, ensure_ascii=False)}: ['
    if not last:
        write_text(spark, path, head + "]" + tail)
        return

    def elements(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text(row(r)) for r in batch.to_pylist(maps_as_pydicts="strict")], pa.string())], ["text"])

    rest = df.where(~F.struct(*key).eqNullSafe(F.struct(*[F.lit(last[0][c]).alias(c) for c in key])))
    parts = f"{path}.parts"
    rest.orderBy(*key).mapInArrow(elements, "text string").write.mode("overwrite").option("lineSep", ",\n").text(parts)
    write_text(spark, f"{parts}/head", head + "\n")
    write_text(spark, f"{parts}/tail", text(row(last[0].asDict(recursive=True))) + "\n  ]" + tail)
    join_files(spark, [f"{parts}/head", *_part_files(spark, parts), f"{parts}/tail"], path)
    remove(spark, parts)


def ensure_writable(spark: SparkSession, paths: list[str], force: bool) -> None:
    if not force and (there := [p for p in paths if exists(spark, p)]):
        raise EvidenceError(f"already there: {', '.join(there)}")


def not_inputs(inputs: list[str], outputs: list[str]) -> None:
    """An output must not be one of the inputs."""
    if clash := set(inputs) & set(outputs):
        raise EvidenceError(f"would overwrite its input: {', '.join(sorted(clash))}")
