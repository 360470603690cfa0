"""Scanning source trees, and their hashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that are never scanned.
DEFAULT_EXCLUDES = ("**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/node_modules/**", "**/.git/**")


def glob_to_regex(pattern: str) -> str:
    """A gitignore-like glob over slash-separated paths: ``*`` stays in a segment, ``**`` crosses, a bare name matches at any depth."""
    directory, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
    out = []
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|[^*?]+?(?=/\*\*|[*?]|$)", pattern.strip("/")):
        out.append({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    head = "^" if anchored else "^(?:.*/)?"
    return head + "".join(out) + ("/.*$" if directory else "(?:/.*)?$")


def gitignore_lines(text: str) -> list[str]:
    return [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]


def excluded(patterns: list[str]):
    """A Column function of a relative path: ignored, where a later ``!pattern`` takes a match back."""

    def test(relpath):
        out = F.lit(False)
        for p in patterns:
            hit = relpath.rlike(glob_to_regex(p.lstrip("!")))
            out = F.when(hit, F.lit(not p.startswith("!"))).otherwise(out)
        return out

    return test


def list_files(spark: SparkSession, root: str) -> list[str]:
    """Every file under ``root``, whatever its name, as the cluster's file system lists it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def read_paths(batches):
    """(path, content) of paths that Spark's own readers pass over; runs on the executors."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        contents = []
        for path in batch.column(0).to_pylist():
            files, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            with files.open_input_stream(inner) as stream:
                contents.append(stream.read())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["path", "content"])


def scan_service(spark: SparkSession, root: str, service: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """service, relpath, sha256, size, content of every ``*.py`` under ``root`` that nothing excludes.

    Spark reads all files but those whose names start with an underscore or a dot, which its
    readers take for hidden; the former (``__init__.py`` above all) are read by path.
    """
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root).select("path", "content")
    paths = list_files(spark, root)
    under = [(p,) for p in paths if re.search(r"/_[^/]*\.py$", p)]
    if under:
        seen = seen.unionByName(spark.createDataFrame(under, "path string").repartition(min(64, len(under))).mapInArrow(read_paths, "path string, content binary"))
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    tail = F.substring_index(F.col("path"), base, -1)
    own = [(p,) for p in paths if p.endswith(base + ".gitignore")]
    text = next((r.content for r in spark.createDataFrame(own, "path string").mapInArrow(read_paths, "path string, content binary").collect()), b"") if own else b""
    test = excluded([*DEFAULT_EXCLUDES, *excludes, *gitignore_lines(bytes(text).decode("utf-8", "replace"))])
    rows = seen.select(F.lit(service).alias("service"), tail.alias("relpath"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size"), "content")
    return rows.where(~test(F.col("relpath")))


def tree_hash(files: DataFrame) -> DataFrame:
    """service, tree_hash, files: SHA-256 of the sorted lines ``relpath:sha256``."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("relpath", "sha256"))), lambda f: F.concat(f["relpath"], F.lit(":"), f["sha256"]))
    return files.groupBy("service").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("tree_hash"), F.count(F.lit(1)).alias("files"))
