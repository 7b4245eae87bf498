"""Small files on any file system that Spark reaches: read, write whole, create once, list, delete."""

from __future__ import annotations

from pyspark.sql import SparkSession

from findery.errors import Persistence


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> bytes | None:
        path = self._path(name)
        try:
            if not self._fs.exists(path):
                return None
            stream = self._fs.open(path)
            try:
                return bytes(stream.readAllBytes())
            finally:
                stream.close()
        except Exception as e:
            raise Persistence(f"reading {name}: {e}") from e

    def create(self, name: str, data: bytes) -> bool:
        """Writes a new file; False if there is one, which stays as it is.

        The whole file appears at once: it is written under another name and
        renamed, which fails where the target exists.
        """
        import uuid

        target, part = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.part")
        try:
            stream = self._fs.create(part, False)
            try:
                stream.write(bytearray(data))
                stream.hflush()
            finally:
                stream.close()
            options = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            array = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            array[0] = options
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
            try:
                context.rename(part, target, array)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    self._fs.delete(part, False)
                    return False
                raise
            return True
        except Exception as e:
            raise Persistence(f"writing {name}: {e}") from e

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        try:
            if not self._fs.exists(path):
                return []
            return sorted(s.getPath().getName() for s in self._fs.listStatus(path))
        except Exception as e:
            raise Persistence(f"listing {name}: {e}") from e

    def stamps(self, name: str) -> tuple[tuple[str, int, int], ...]:
        """Name, length and time of every file of a folder: as long as they are the same, so are the files."""
        path = self._path(name)
        try:
            found = self._fs.listStatus(path) if self._fs.exists(path) else ()
            return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))
        except Exception as e:
            raise Persistence(f"listing {name}: {e}") from e

    def delete(self, name: str) -> None:
        try:
            self._fs.delete(self._path(name), True)
        except Exception as e:
            raise Persistence(f"deleting {name}: {e}") from e
