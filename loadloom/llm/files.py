"""Files that tasks write to and read from the shared folder.

Every attempt of a task writes under a name of its own and returns that name as a row; the
rows of the attempts that Spark accepted are written as a Parquet manifest. Readers open only what a
manifest names, so repeated, speculative and lost attempts leave no trace in a result.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame


def _at(path: str):
    if path.startswith("file:/") and not path.startswith("file://"):  # as Hadoop writes local paths
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def create(folder: str, stem: str, suffix: str):
    """(path, stream) of a new file below the folder."""
    path = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, local = _at(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    return path, system.open_output_stream(local, compression=None)


def open_input(path: str):
    system, local = _at(path)
    return system.open_input_file(local)


def dealt(units: DataFrame, *order: str) -> DataFrame:
    """Units of reading, a few hundred bytes each, over many tasks: an explicit number of partitions, which adaptive
    execution does not merge, at most four for every core."""
    most = 4 * units.sparkSession.sparkContext.defaultParallelism
    return units.repartitionByRange(max(1, min(most, units.count())), *order)
