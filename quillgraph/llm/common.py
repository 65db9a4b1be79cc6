"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A word is a run of anything but the six ASCII white-space characters (Java and Python regex syntax).
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes in each part of a stored table.
STORED_BYTES = 64 << 20
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Deletes the tables that cut() and store() write inside it, at its end, but for those given to the function it yields."""
    _made.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        made = _made.pop()
        keep = {t._quillgraph_path for t in kept}
        discard(*[t for t in made if t._quillgraph_path not in keep])
        if _made:
            _made[-1].extend(t for t in made if t._quillgraph_path in keep)


def _note(table: DataFrame, path: str) -> DataFrame:
    table._quillgraph_path = path
    if _made:
        _made[-1].append(table)
    return table


def clean_driver(spark: SparkSession) -> None:
    """Collects the driver's garbage and returns memory that its JVM has freed outside the heap to the system.

    Its hundreds of threads allocate from many arenas of the C library, which keep what is freed, so that a long row of jobs
    adds up. A JVM without the command, or with another C library, only collects its garbage.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        call = next(m for m in call.getMethods() if m.getName() == "invoke")  # by its interface, as the class itself is closed to other modules
        given = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and returns them read again.

    It ends the lineage, so a lost executor costs no more than rereading files, and it keeps what
    several later plans use from being computed for each of them. Then the driver collects its garbage,
    which lets Spark delete shuffle files of plans that ended, and returns its free memory to the system.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    clean_driver(spark)
    return _note(spark.read.schema(df.schema).parquet(path), path)


def store(df: DataFrame, key: str, total: int) -> DataFrame:
    """Writes the rows to the shared folder, dealt by the hash of a column, so that later joins on it don't shuffle them; total: their bytes."""
    spark = df.sparkSession
    parts, name = max(2 * spark.sparkContext.defaultParallelism, -(-total // STORED_BYTES)), f"quillgraph_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").bucketBy(parts, key).option("path", path).saveAsTable(name)
    clean_driver(spark)
    out = _note(spark.table(name), path)
    out._quillgraph_parts = parts
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once everything made from them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._quillgraph_path)
        if hasattr(t, "_quillgraph_parts"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {path.getName()}")
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def for_python(spark: SparkSession, rows: int = 500) -> None:
    """Readies a session for the operators that run Python on executors.

    It limits Arrow batches, as single texts can be long, and sends this package along once, for
    clusters where it isn't installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    sc, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if not getattr(sc, "_quillgraph_sent", False) and package.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="quillgraph-"), f"{package.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(path)
        sc._quillgraph_sent = True


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Where there is no cased letter beyond ASCII, lower() does the same at less cost."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns a Python worker's free memory to the system. Workers live on from stage to stage, so what they keep adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def packed(docs: DataFrame, columns: list[str]) -> Column:
    """The given columns as one struct named _in, so that no name of theirs clashes with a helper column."""
    return F.struct(*[docs[c] for c in columns], F.lit(0).alias("_")).alias("_in")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("_in")[c].alias(c) for c in columns]
