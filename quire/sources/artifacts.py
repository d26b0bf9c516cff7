"""Artefacts in a folder: listing, and reading or deleting one by a name that cannot leave the folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, timestamp in ms) of the regular files at the top of a folder; none if it is missing or empty."""
    try:
        found = spark.read.format("binaryFile").load(folder)
    except Exception as e:  # a missing folder lists nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "name string, size bigint, timestamp bigint")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("timestamp"))


def artifact_path(folder: str, name: str) -> str:
    """Path of an artefact. ValueError: blank; PermissionError: absolute, .. or outside; FileNotFoundError: absent."""
    if not name.strip():
        raise ValueError("no name")
    if os.path.isabs(name) or ".." in name.replace("\\", "/").split("/"):
        raise PermissionError(name)
    path = os.path.join(folder, name)
    if not os.path.lexists(path):
        raise FileNotFoundError(name)
    real = os.path.realpath(path)
    if os.path.commonpath([real, os.path.realpath(folder)]) != os.path.realpath(folder) or not os.path.isfile(real):
        raise PermissionError(name)
    return real


def read_artifact(folder: str, name: str) -> bytes:
    with open(artifact_path(folder, name), "rb") as f:
        return f.read()


def delete_artifact(folder: str, name: str) -> None:
    os.remove(artifact_path(folder, name))
