"""Helpers shared by the operators: shared folders, row keys, words."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE = 1 << 20  # bytes of text that a Python worker works on at once, if no single text is longer


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; see :func:`caretrail.session.shared_base`."""
    from caretrail.session import shared_base  # the driver has it; executors get this subpackage alone

    return shared_base(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that later steps don't depend on its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: smaller than a checkpoint when rows are wide."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. Pure ASCII, the common case, takes the byte-wise built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """The words of a text: what runs of ``separators`` (a regex class) leave between them."""
    return F.array_remove(F.split(ascii_lower(text), f"{separators}+"), "")


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two never-null join keys of a row. Rows with equal id and text are equal for every operator."""
    return F.coalesce(doc_id, F.lit(-1)).alias("_k"), F.xxhash64(doc_id, text).alias("_h")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, in case they can't import it from a path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_caretrail_llm", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="caretrail-")).resolve() / "caretrail_llm.zip"  # Spark sends it from here
    with zipfile.ZipFile(archive, "w") as z:
        for source in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._caretrail_llm = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batch, texts) -> Iterator:
    """An Arrow batch or array in slices of about ``PIECE`` bytes of its ``texts``, in order; an empty one as it is.

    What Python makes of texts takes many times their size, and a worker keeps much of that for its later tasks.
    """
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // PIECE)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(texts)]):
        yield batch.slice(start, end - start)


def map_texts(df: DataFrame, keep: tuple[str, ...], text: str, make: Callable[[], Callable], fields: str) -> DataFrame:
    """``keep`` columns as they are and ``fields``, which are computed piece by piece from the texts.

    ``make`` is called once for each partition; what it returns takes a list of texts (or None) and returns one Arrow
    array for each field.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.select(*keep).schema.fields, *T.StructType.fromDDL(fields).fields])

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for piece in pieces(batch, batch.columns[-1]):
                columns = piece.columns
                yield pa.RecordBatch.from_arrays([*columns[:-1], *work(columns[-1].to_pylist())], schema.names)

    return df.select(*keep, df[text].cast("string").alias("_text")).mapInArrow(run, schema)
