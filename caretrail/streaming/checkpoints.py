"""Checkpoint folders, each with an id of its own.

A stream numbers its batches from 0 in each checkpoint. The id kept in the folder tells batch 0 of a new checkpoint from
batch 0 of an old one, and stays with the folder through restarts.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession

from caretrail.session import shared_folder

ID_FILE = "stream-id"


def checkpoint_folder(spark: SparkSession, root: str, name: str, given: str | None = None) -> str:
    """``given``, or a shared folder of this stream into this root: streams into two roots don't share one."""
    return given or shared_folder(spark, f"{name}-{hashlib.sha256(root.encode()).hexdigest()[:12]}-checkpoint")


def stream_id(spark: SparkSession, folder: str) -> str:
    """The id in the folder, which is made with the first stream that uses it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{ID_FILE}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        stream = fs.open(at)
        known = bytes(stream.readAllBytes()).decode().strip()
        stream.close()
        if known:
            return known
    made = uuid.uuid4().hex[:12]
    out = fs.create(at, True)
    out.write(bytearray(made.encode()))
    out.close()
    return made
