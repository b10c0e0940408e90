"""Shared pieces of the training-data operators.

Intermediate tables and files go to the folder named by ``spark.checkpoint.dir``
(all executors share it), so that a lost executor never takes them along.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in measured bytes, that a join may broadcast; read at each call.
BROADCAST_BYTES = 64 << 20
#: Input bytes of a task where an operator sets the number of tasks itself.
TASK_BYTES = 128 << 20
#: Bytes of a batch that are turned into Python objects at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a local one is set only in local mode, where none is configured.

    On a cluster executors can't see the driver's folders, so that a missing
    setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, partition: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame, row_bytes: int) -> int:
    """Bytes of a written table in memory: ``row_bytes`` for each row, and the real lengths of strings and nested values."""
    wide = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            wide.append(F.octet_length(column))
        elif kind.startswith(("array", "map", "struct")):
            wide.append(F.octet_length(F.to_json(F.struct(column))))
    length = sum((F.coalesce(w.cast("long"), F.lit(0)) for w in wide), F.lit(0).cast("long"))
    rows, held = df.agg(F.count(F.lit(1)), F.sum(length)).first()
    return rows * row_bytes + (held or 0)


def bounded(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Mark a written table for broadcast if its measured size is within ``limit`` (``BROADCAST_BYTES`` if None).

    Beyond the limit the table is returned as it is and Catalyst shuffles.
    """
    return F.broadcast(df) if measured_bytes(df, row_bytes) <= (BROADCAST_BYTES if limit is None else limit) else df


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for a shuffle of ``df``: the session's number, or more where Catalyst's size of the input asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 60 else max(least, -(-size // task_bytes))  # Catalyst gives the largest long for an unknown size


def local_path(uri: str) -> str | None:
    """The path of a mounted (``file:``) location, None for other schemes."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_bytes(uri: str, payload: bytes) -> None:
    """Write one object whole: a retried task replaces it, readers never see half of it."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as out:
            out.write(payload)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(payload)
    os.replace(part, path)


def utf8(text: str) -> bytes:
    """UTF-8 of any str that Arrow hands over."""
    return text.encode("utf-8", "surrogatepass")


def get_bytes(uri: str) -> bytes:
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(inner) as data:
            return data.read()
    with open(path, "rb") as data:
        return data.read()


def arrow_type(kind: str) -> pa.DataType:
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]


def tidy() -> None:
    """Give free memory back: Spark reuses Python workers, and what one stage leaves in pools adds to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind each of them free memory is given back."""
    for batch in batches:
        yield batch
        del batch
        tidy()


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes, so that only a part at a time becomes Python objects."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def per_text(docs: DataFrame, schema: str, make: Callable[[list], tuple], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, *schema) of every document; ``make`` maps a list of texts to columns of ``schema``.

    doc_id passes through Arrow untouched, null or not.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for part in slices(batch):
                made = make(part.column(1).to_pylist())
                columns = [pa.array(c, type=arrow_type(k)) for c, (_, k) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *[n for n, _ in fields]])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")
