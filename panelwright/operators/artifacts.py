"""Model files: presence, digests, manifests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.text import is_sha256
#: Bytes that are hashed at a time.
PIECE = 1 << 20


def artifact_status(spark: SparkSession, root: str, artifacts: Mapping[str, str]) -> DataFrame:
    """``name``, ``path``, ``exists`` of each configured file; a driver-side listing."""
    rows = [(n, p, (Path(root) / p).is_file()) for n, p in artifacts.items()]
    return spark.createDataFrame(rows, "name string, path string, exists boolean")


def readiness(status: DataFrame) -> DataFrame:
    """One row: ``payload`` (JSON, keys sorted) and ``exit_code`` 0 or 2."""
    missing = F.sort_array(F.collect_list(F.when(~F.col("exists"), F.col("name"))))
    return status.agg(missing.alias("missing")).select(
        F.to_json(
            F.struct(
                F.when(F.size("missing") == 0, "ready").otherwise("not_ready").alias("inference_readiness"),
                F.lit("ok").alias("liveness"),
                F.col("missing").alias("missing_artifacts"),
            )
        ).alias("payload"),
        F.when(F.size("missing") == 0, 0).otherwise(2).alias("exit_code"),
    )


def _uri(root: str) -> str:
    return root if "://" in root or root.startswith("file:") else Path(os.path.realpath(root)).as_uri()


def _digest(system, path: str) -> str:
    """SHA-256 of a file of any size, in pieces."""
    sha = hashlib.sha256()
    with system.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            sha.update(piece)
    return sha.hexdigest()


def digests(spark: SparkSession, root: str, ways: int | None = None) -> DataFrame:
    """``path`` (relative to root) and ``actual`` SHA-256 of every file below ``root``, empty ones and odd names included.

    The folders right below ``root`` are listed by tasks, then the files are dealt out; each is read as a stream by the task that hashes it.
    """
    from pyarrow import fs

    base = _uri(root)
    system, folder = fs.FileSystem.from_uri(base)
    top = spark.createDataFrame([(i.base_name,) for i in system.get_file_info(fs.FileSelector(folder))], "path string")

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base)
        start = len(folder.rstrip("/")) + 1
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                at = system.get_file_info(f"{folder.rstrip('/')}/{name}")
                inside = system.get_file_info(fs.FileSelector(at.path, recursive=True)) if at.type == fs.FileType.Directory else [at]
                found += [i.path[start:] for i in inside if i.type == fs.FileType.File]
            yield pa.record_batch([pa.array(found, pa.string())], ["path"])

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base)
        for batch in batches:
            sums = [_digest(system, f"{folder.rstrip('/')}/{p}") for p in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sums, pa.string())], ["path", "actual"])

    files = top.mapInArrow(listed, "path string")
    return files.repartition(ways or spark.sparkContext.defaultParallelism).mapInArrow(hashed, "path string, actual string")


def files_of(entries: DataFrame, root: str, ways: int | None = None) -> DataFrame:
    """``path``, ``escapes`` and ``actual`` of every distinct path that entries name: links are resolved, and only files that stay below ``root`` are read.

    ``actual`` is null where there is no such file. ``root`` may be a folder or the address of one in any file system of ``pyarrow.fs``.
    """
    base = _uri(root)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            escapes, actual = [], []
            for path in batch.column(0).to_pylist():
                out = bool(local and not os.path.isabs(path) and "\0" not in path and not confined(folder, path))
                found = None
                if not out and not path.startswith("/") and "\0" not in path:
                    whole = f"{folder.rstrip('/')}/{path}"
                    if system.get_file_info(whole).type == fs.FileType.File:
                        found = _digest(system, whole)
                escapes.append(out)
                actual.append(found)
            yield pa.record_batch([batch.column(0), pa.array(escapes), pa.array(actual, pa.string())], ["path", "escapes", "actual"])

    # what leads outside by its text alone is never looked at
    inner = entries.select("path").where((F.col("path") != "") & path_error(F.col("path")).isNull()).distinct()
    return (inner.repartition(ways) if ways else inner).mapInArrow(run, "path string, escapes boolean, actual string")


def write_files(contents: DataFrame, root: str) -> None:
    """Writes ``content`` of every row to its ``path`` below ``root``; a task that is run again writes the same files."""
    base = _uri(root)

    def run(batches: Iterator) -> Iterator:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = f"{folder.rstrip('/')}/{path}"
                system.create_dir(whole.rpartition("/")[0], recursive=True)
                with system.open_output_stream(whole) as out:
                    out.write(content or b"")
            yield batch

    contents.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, content binary").write.format("noop").mode("overwrite").save()


def link_outside(root: str, name: str) -> None:
    """Makes ``name`` below a local ``root`` a link to the folder above it."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(_uri(root))
    if isinstance(system, fs.LocalFileSystem):
        os.symlink(os.path.dirname(folder.rstrip("/")), f"{folder.rstrip('/')}/{name}")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """Text of manifests (``manifest_id``, ``value``) to entries in order, or one row with ``manifest_error``.

    ``entry_error`` tells entries that are no objects; a path or digest that is no text is null.
    """
    parsed = manifests.withColumn("m", F.try_parse_json("value"))
    entries = parsed.select(
        "manifest_id", F.col("m").isNull().alias("broken"), F.try_variant_get("m", "$.artifacts", "array<variant>").alias("artifacts")
    )
    each = entries.select(
        "manifest_id",
        F.when(F.col("broken"), "invalid manifest: JSONDecodeError")
        .when(F.coalesce(F.size("artifacts"), F.lit(0)) <= 0, "manifest must contain a non-empty 'artifacts' list")
        .alias("manifest_error"),
        F.posexplode_outer("artifacts").alias("ord", "entry"),
    )

    def text(name: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get("entry", f"$.{name}", "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get("entry", f"$.{name}", "string")).alias(name)

    is_object = F.schema_of_variant("entry").startswith("OBJECT")
    wrong = F.when(F.col("ord").isNotNull() & ~F.coalesce(is_object, F.lit(False)), "artifact entry must be an object")
    return each.select("manifest_id", "manifest_error", "ord", wrong.alias("entry_error"), text("path"), text("sha256"))


def path_error(path: Column) -> Column:
    """Absolute paths, and paths whose ``..`` lead above the root. Symbolic links: see ``confined``."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    depths = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"),
            F.least(a["least"], a["at"] + F.when(x == "..", -1).otherwise(1)).alias("least"),
        ),
    )
    return F.when(path.startswith("/"), "artifact path must be relative to the manifest directory").when(
        depths["least"] < 0, "artifact path escapes the manifest directory"
    )


def confined(root: str, relative: str) -> bool:
    """True if the path, links resolved, stays below ``root``."""
    base = os.path.realpath(root)
    return not os.path.isabs(relative) and os.path.commonpath([base, os.path.realpath(os.path.join(base, relative))]) == base


def entry_errors(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``error``: each entry's first failing check; null if its file has the digest. ``files``: ``path``, ``actual``, and maybe ``escapes``.

    An ``entry_error`` of ``manifest_entries`` comes before all checks.
    """
    known = F.col("entry_error") if "entry_error" in entries.columns else F.lit(None).cast("string")
    joined = entries.join(files, "path", "left")
    escapes = F.col("escapes") if "escapes" in files.columns else F.lit(False)
    found = joined.withColumn(
        "error",
        F.when(known.isNotNull(), known)
        .when(F.coalesce(F.col("path"), F.lit("")) == "", "artifact entry is missing a valid 'path'")
        .when(~is_sha256(F.col("sha256")), "missing valid SHA-256 digest")
        .when(path_error(F.col("path")).isNotNull(), path_error(F.col("path")))
        .when(escapes, "artifact path escapes the manifest directory")
        .when(F.col("actual").isNull(), "artifact missing")
        .when(F.lower("actual") != F.lower("sha256"), "SHA-256 mismatch"),
    )
    return found.drop("escapes") if "escapes" in files.columns else found


def manifest_reports(checked: DataFrame, block: int = 1000) -> DataFrame:
    """``manifest_id``, ``ok`` and ``errors``: the lines of a manifest's faulty entries, in their order.

    ``checked`` has ``manifest_id``, ``ord``, ``path``, ``error`` and maybe ``manifest_error``, which then is the only line. Lines are
    gathered by blocks of entries first, then block by block, so a large manifest is put together by many tasks.
    """
    whole = F.col("manifest_error") if "manifest_error" in checked.columns else F.lit(None).cast("string")
    named = F.coalesce(F.col("path"), F.lit("")) != ""
    line = F.coalesce(whole, F.when(named, F.concat("path", F.lit(": "), "error")).otherwise(F.col("error")))
    lines = checked.select("manifest_id", F.coalesce(F.col("ord").cast("long"), F.lit(0)).alias("ord"), line.alias("line"))
    blocks = lines.groupBy("manifest_id", F.floor(F.col("ord") / block).alias("block")).agg(
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "line")))).alias("lines")
    )
    return (
        blocks.groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct("block", "lines"))).alias("blocks"))
        .select("manifest_id", F.flatten(F.transform("blocks", lambda b: b["lines"]["line"])).alias("errors"))
        .select("manifest_id", (F.size("errors") == 0).alias("ok"), "errors")
    )


def report_lines(reports: DataFrame) -> DataFrame:
    """``line`` and ``code`` (1) of every error, as ``report_sink`` takes them."""
    return reports.select(F.explode("errors").alias("e")).select(F.concat(F.lit("ERROR: "), "e").alias("line"), F.lit(1).alias("code"))
