"""Files of a data folder, local or remote, through Hadoop's file systems."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """What a data folder needs of a file system. Paths are relative to `root`, which may have any scheme Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/") or "/"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def url(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def _path(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(self.url(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def list(self, path: str) -> list[tuple[str, float]]:
        """Names in a folder, with the time of their last change; nothing if there is no such folder."""
        if not self.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(path))]

    def newest(self, path: str) -> float:
        """When the youngest file under a folder was changed last."""
        found, files = 0.0, self._fs.listFiles(self._path(path), True)
        while files.hasNext():
            found = max(found, files.next().getModificationTime() / 1000)
        return found

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file as a whole; False, and nothing is changed, if there is one of that name.

        The content goes to a name of its own and is published by one step that fails if the name is taken: a hard
        link on local disks, a rename without overwriting on HDFS and Azure, a conditional put on S3. So of several
        writers one succeeds, a reader sees all of the content or no file, and a writer that stops on the way leaves
        a part that nothing reads.
        """
        target = self._path(path)
        self._fs.mkdirs(target.getParent())
        if self._fs.getScheme() == "s3a":
            return self._put(target, text)
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        try:
            self._write(part, text)
            self._publish(part, target)
        except Exception as error:
            if _taken(error):
                return False
            raise
        finally:
            self._fs.delete(part, False)
        return True

    def _write(self, path: Any, text: str) -> None:
        stream = self._fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _publish(self, part: Any, target: Any) -> None:
        if self._fs.getScheme() == "file":
            link = self._jvm.java.nio.file.Files.createLink
            link(self._fs.pathToFile(target).toPath(), self._fs.pathToFile(part).toPath())
            return
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(part, target, none)

    def _put(self, target: Any, text: str) -> bool:
        try:
            stream = self._fs.createFile(target).overwrite(False).must("fs.option.create.conditional.overwrite", True).build()
            stream.write(bytearray(text.encode()))
            stream.close()
        except Exception as error:
            if _taken(error) or "RemoteFileChanged" in str(error):
                return False
            raise
        return True

    def replace(self, path: str, text: str) -> None:
        """Write a file as a whole, in place of one of that name."""
        target, part = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.part")
        self._fs.mkdirs(target.getParent())
        self._write(part, text)
        if not self._fs.rename(part, target):
            self._fs.delete(target, False)
            self._fs.rename(part, target)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _taken(error: Exception) -> bool:
    return "AlreadyExists" in str(error)
