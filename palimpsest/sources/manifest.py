"""Numbered manifests in a folder: each is written whole, renamed, and only then are older ones deleted."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """A folder's newest state.

    A manifest of the next number is written under a temporary name and renamed; the
    newest that can be read counts and older ones go afterwards, so a crash at any point leaves
    the state as it was or as it is now.  Two writers cannot both take a number.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def make_folder(self) -> None:
        self._fs.mkdirs(self._file(self.path))

    def exists(self) -> bool:
        return self._fs.exists(self._file(self.path))

    def names(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._file(self.path))]
        return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def last_number(self) -> int:
        """The highest number taken, by a broken manifest too."""
        names = self.names()
        return int(names[-1][9:-5]) if names else 0

    def read(self) -> dict | None:
        for name in reversed(self.names()):
            stream = self._fs.open(self._file(f"{self.path}/{name}"))
            try:
                return json.loads(bytes(stream.readAllBytes()))
            except ValueError:  # not written whole
                continue
            finally:
                stream.close()
        return None

    def write(self, state: dict, number: int) -> None:
        name = f"manifest-{number:012d}"
        text = self._file(f"{self.path}/{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(text, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(text, self._file(f"{self.path}/{name}.json")):
            raise RuntimeError(f"{name} exists: another writer has committed")
        for old in self.names():
            if old < f"{name}.json":
                self._fs.delete(self._file(f"{self.path}/{old}"), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._file(f"{self.path}/{name}"), True)
