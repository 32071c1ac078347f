"""Small files of a store, through Hadoop's file systems: read, listed, and created by one writer only."""

from __future__ import annotations

import os
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Text files below a folder. Local folders and those of any Hadoop file system are the same to the caller."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        place = self._path("")
        self.fs = place.getFileSystem(self.conf)
        self.local = place.toUri().getPath() if self.fs.getUri().getScheme() == "file" else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        """The text of a file, or None where there is none."""
        if self.local:
            try:
                with open(f"{self.local}/{name}") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """What lies directly in a folder, without temporary files."""
        if self.local:
            try:
                found = os.listdir(f"{self.local}/{folder}")
            except FileNotFoundError:
                found = []
        elif self.fs.exists(self._path(folder)):
            found = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]
        else:
            found = []
        return sorted(n for n in found if not n.startswith("."))

    def create(self, name: str, text: str) -> bool:
        """Make a file with all of its text at once; False if there is one of that name already.

        Of several writers exactly one succeeds: a local file is linked to its name, elsewhere it is renamed without
        overwriting, which HDFS and its like do as one step.
        """
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid4().hex}"
        self.put(draft, text)
        try:
            if self.local:
                os.link(f"{self.local}/{draft}", f"{self.local}/{name}")
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                how = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
                how[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(draft), self._path(name), how)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in str(problem.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self.delete(draft)

    def put(self, name: str, text: str) -> None:
        """Write a file that nobody else writes, or whose latest text is as good as any."""
        if self.local:
            path = f"{self.local}/{name}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}~{uuid4().hex}", "w") as f:
                f.write(text)
            os.replace(f.name, path)
            return
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def age_ms(self, name: str, now_ms: int) -> int:
        """How long ago a file or folder was last changed."""
        return now_ms - self.fs.getFileStatus(self._path(name)).getModificationTime()
