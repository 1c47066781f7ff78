"""A small state that several writers change, kept as numbered files: optimistic concurrency by exclusive creation.

Each file holds the whole state. A writer reads the one with the greatest number, makes the next state and creates the next
file, which only one writer can; the others read again and make their change anew. So no change is lost and the order of
changes is one for all. The files are few and short: what they tell are names and folders, never rows.

Files are reached through Hadoop's file systems on the driver (so not from a Spark Connect session). Exclusive creation is
a hard link on a local or mounted file system and a rename without overwrite elsewhere, which HDFS does in one step; a store
of objects whose rename is a copy is not fit for several writers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Files:
    """Files and folders under a root, by relative paths."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def uri(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def list(self, folder: str) -> list[str]:
        """Names in a folder, sorted, without hidden ones; none if there is no such folder."""
        try:
            found = self._fs.listStatus(self._path(folder))
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return []
            raise
        return sorted(name for x in found if not (name := x.getPath().getName()).startswith((".", "_")))

    def read(self, path: str) -> str | None:
        """The text of a file, None if it is not there."""
        try:
            stream = self._fs.open(self._path(path))
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def create_new(self, path: str, text: str) -> bool:
        """Create a file with its text at once; False, and nothing done, if there is one of that name."""
        new = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        self.write(new, text)
        try:
            if self._local:
                os.link(self._path(new).toUri().getPath(), self._path(path).toUri().getPath())
                return True
            return self._fs.rename(self._path(new), self._path(path))
        except FileExistsError:
            return False
        finally:
            self.delete(new)

    def replace(self, path: str, text: str) -> None:
        """Write a file in place of the one of that name, at once: readers see the old text or the new."""
        new = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}".lstrip("/")
        self.write(new, text)
        # FileSystem.rename would not replace a file that is there.
        at = self._path(new).toUri()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at if at.getScheme() else self._fs.getUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(self._path(new), self._path(path), array)

    def set_time(self, path: str, millis: int) -> None:
        """Set a file's time of modification."""
        self._fs.setTimes(self._path(path), millis, -1)


class Log:
    """The states of one folder; the last ``keep`` files are kept."""

    def __init__(self, files: Files, folder: str, keep: int = 32) -> None:
        self.files, self.folder, self.keep = files, folder, keep

    def _numbers(self) -> list[int]:
        return [int(x) for x in self.files.list(self.folder) if x.isdigit()]

    def _at(self, number: int) -> str:
        return f"{self.folder}/{number:012d}"

    def _last(self) -> tuple[int, dict]:
        while numbers := self._numbers():
            text = self.files.read(self._at(numbers[-1]))
            if text is not None:  # else it was cleared meanwhile, and there is a later one
                return numbers[-1], json.loads(text)
        return 0, {"by": [], "state": None}

    def state(self) -> dict | None:
        """The state, None before the first."""
        return self._last()[1]["state"]

    def update(self, change: Callable[[dict | None], dict | None]) -> dict | None:
        """Make ``change`` of the last state the next one. A change to None does nothing; an error leaves the state as it is.

        ``change`` is called again if another writer was faster, so it must do nothing but compute.
        """
        while True:
            number, last = self._last()
            new = change(last["state"])
            if new is None:
                return last["state"]
            mine = uuid.uuid4().hex
            entry = {"by": [*last["by"], mine][-4 * self.keep :], "state": new}
            if not self.files.create_new(self._at(number + 1), json.dumps(entry)):
                continue
            numbers = self._numbers()
            # The number may have been free because later writers had cleared it; then the last state does not come from this one.
            if numbers[-1] > number + 1 and mine not in self._last()[1]["by"]:
                self.files.delete(self._at(number + 1))
                continue
            for old in numbers[: -self.keep]:
                self.files.delete(self._at(old))
            return new
