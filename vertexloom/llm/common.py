"""Shared plumbing: Arrow access, column handling, shared-folder tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.shipping import ship

#: Most text bytes that one vectorised step of a Python worker looks at.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor sees.

    Where the session names none, as in tests in one process, a temporary folder is
    set as the session's own; a cluster, also one of processes on one machine, must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = held or "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for begun in _open[-1:]:
        begun.append(path)
    return path


class Shared:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.count = spark, shared_dir(spark), 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``save`` that no later plan reads."""
        remove(self.spark, df._loom_path)


_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the shared folders that were begun within it: for jobs whose result is then written."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name += "_"
    return name


def extend(df: DataFrame, fn: Callable[[pa.Array], pa.Array], ret: str, col: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """Append the fields of the struct that the Arrow function ``fn`` returns.

    A column of ``df`` whose name equals a result field is replaced.  ``keep``
    limits which columns of ``df`` stay.
    """
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    fields = [f.name for f in StructType.fromDDL(ret[len("struct<") : -1])] if ret.startswith("struct<") else []
    taken = {f.lower() for f in fields}
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    out = fresh(df, "__out")

    def run(array: pa.Array) -> pa.Array:
        return fn(array)

    udf = F.arrow_udf(run, ret)
    return df.select(*[df[c] for c in stay], udf(col).alias(out)).select(*stay, *[F.col(out)[f].alias(f) for f in fields])


def text_of(df: DataFrame, name: str) -> Column:
    """The text column as string, null read as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins (n + 1 offsets)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of ``texts`` of about ``most`` bytes each, and of at least one text."""
    _, offsets = flat(texts)
    at, n = 0, len(texts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def struct(**arrays) -> pa.StructArray:
    return pa.StructArray.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays.values()], list(arrays))


def crc_mod(df: DataFrame, id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(df[id_col].cast("string").cast("binary")) % mod


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_file(path: str) -> str:
    """``path`` if it names a file, else the place of the public vocabulary of that name."""
    return path if os.path.exists(path) else public_path(path)
