"""Small files in a shared folder that appear whole, and of which only the first under a name exists.

What has to be exclusive (publishing a run, a generation, a state of a job, a lease) is the creation of one numbered
file: whoever takes the number has it, everybody else is told so. No lock is left behind by a writer that dies.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession


class SharedFolder:
    """A folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        """The full path of a name."""
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        at = self._path(self.at(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def remove(self, name: str) -> None:
        """Remove a file, or a folder with all that is in it."""
        self._fs.delete(self._path(self.at(name)), True)

    def create(self, name: str, content: dict) -> bool:
        """Make a whole file of JSON appear under a name; False if the name is taken.

        On local disks by a hard link, elsewhere by a rename, which HDFS refuses for a name that exists.
        """
        target, staged = self._path(self.at(name)), self._path(self.at(f".new/{uuid.uuid4().hex}.json"))
        out = self._fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        self._fs.mkdirs(target.getParent())
        try:
            if self._fs.getScheme() == "file":
                os.link(staged.toUri().getPath(), target.toUri().getPath())
                return True
            return not self._fs.exists(target) and self._fs.rename(staged, target)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(staged, False)

    def records(self, folder: str) -> list[dict]:
        """The numbered records of a folder, in order. They are few and small: one a run, a generation, a state."""
        found = [n for n in self.names(folder) if n.endswith(".json")]
        if not found:
            return []
        rows = self.spark.read.text([self.at(f"{folder}/{n}") for n in found], wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda c: c["sequence"])

    def append(self, folder: str, record: dict, after: int) -> bool:
        """Add a record as the one after the record numbered ``after``; False if somebody else was faster."""
        return self.create(f"{folder}/{after + 1:012d}.json", {**record, "sequence": after + 1})


class Lease:
    """A reservation of a name for a time. It ends when it is released or when the time is over, whoever died."""

    def __init__(self, spark: SparkSession, root: str, milliseconds: int = 5_000, clock=time.time):
        self.folder, self.milliseconds, self.clock = SharedFolder(spark, root), milliseconds, clock

    def _last(self, name: str) -> dict:
        records = self.folder.records(name)
        return records[-1] if records else {"sequence": 0, "token": None, "until": 0}

    def acquire(self, name: str) -> str | None:
        """A token if the name is free, else None."""
        last, now = self._last(name), int(self.clock() * 1000)
        if last["token"] is not None and now < last["until"]:
            return None
        token = uuid.uuid4().hex
        return token if self.folder.append(name, {"token": token, "until": now + self.milliseconds}, last["sequence"]) else None

    def release(self, name: str, token: str) -> bool:
        """Give a name back; False for a token that holds it no more, which changes nothing."""
        last = self._last(name)
        return last["token"] == token and self.folder.append(name, {"token": None, "until": 0}, last["sequence"])
