"""Object storage through Hadoop's file systems, so that any scheme Spark reads works."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import ArtifactMissing, BackendUnsupported
from .layout import checked


class ObjectStore(Protocol):
    def put(self, key: str, data: bytes) -> None: ...
    def get(self, key: str) -> bytes: ...
    def exists(self, key: str) -> bool: ...
    def list(self, prefix: str) -> list[str]: ...
    def delete(self, key: str) -> None: ...
    def path(self, key: str) -> str: ...


class HadoopStore:
    """Small objects by key under a root; tables go through Spark at path(key)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm

    def path(self, key: str) -> str:
        return f"{self.root}/{checked(key)}"

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, key: str, data: bytes) -> None:
        """Written beside its place first, then renamed over it, so readers see the old object or the new one.

        File systems without an overwriting rename lack the old one for a moment.
        """
        fs, target = self._at(self.path(key))
        part = self.jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(data))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        try:
            options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            options[0] = hadoop.Options.Rename.OVERWRITE
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, options)
        except Py4JJavaError as e:
            if "UnsupportedFileSystem" not in str(e.java_exception):
                raise OSError(f"can't rename to {key}") from e
            fs.delete(target, False)
            if not fs.rename(part, target):
                raise OSError(f"can't rename to {key}") from e

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise ArtifactMissing(key)
        row = self.spark.read.format("binaryFile").load(self.path(key)).select("content").first()
        return bytes(row.content)

    def exists(self, key: str) -> bool:
        fs, p = self._at(self.path(key))
        return fs.exists(p)

    def list(self, prefix: str = "") -> list[str]:
        """Keys under a prefix, sorted."""
        fs, p = self._at(f"{self.root}/{checked(prefix, True)}")
        if not fs.exists(p):
            return []
        base = fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(self.root)).toString().rstrip("/")
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            found.append(files.next().getPath().toString()[len(base) + 1 :])
        return sorted(x for x in found if not x.rsplit("/", 1)[-1].startswith((".", "_")))

    def sizes(self, prefix: str = "") -> DataFrame:
        """(path, length) of the files under a prefix; contents aren't read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return files.load(f"{self.root}/{checked(prefix, True)}").select("path", "length").orderBy("path")

    def delete(self, key: str) -> None:
        fs, p = self._at(self.path(key))
        fs.delete(p, True)

    def put_json(self, key: str, value: object) -> None:
        self.put(key, json.dumps(value, indent=2, sort_keys=True).encode())

    def get_json(self, key: str) -> dict:
        return json.loads(self.get(key))


def scratch(spark: SparkSession) -> HadoopStore:
    """A store in a new folder below spark.checkpoint.dir; where that is unset, a temporary one, on a single machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="corvix-")
    return HadoopStore(spark, f"{shared.rstrip('/')}/corvix-stored/{uuid.uuid4().hex}")


class UnsupportedStore:
    """Stands for a backend that isn't configured: every operation is an error. s3a:// roots work with HadoopStore."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __getattr__(self, operation: str):
        def refuse(*_: object) -> None:
            raise BackendUnsupported(f"{self.name} doesn't support {operation}")

        return refuse
