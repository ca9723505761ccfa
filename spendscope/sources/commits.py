"""Batches that count once: written aside, then published by one small file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Commit:
    """Published batches ``first`` to ``last``, where their data lie and what is known of them."""

    first: str
    last: str
    path: str = field(compare=False)
    facts: dict = field(compare=False)
    names: tuple[str, ...] = field(compare=False)


class Commits:
    """The published batches of one folder that all executors reach.

    A batch is written to a folder that no other attempt uses, and counts from the moment its marker
    has its final name. An attempt that breaks off leaves a folder that nobody reads; a batch that is
    published is not written again, so retries and replays change nothing. Names must ascend from commit to
    commit, as padded numbers do; one driver at a time writes to a folder.

    ``merge`` writes the data of several batches as one and publishes that in their place. Readers see
    the one or the others, never both.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # What this object has seen published. Only one driver writes; readers take a new object for a new look.
        self._known: dict[tuple[str, str], Commit] | None = None

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _published(self) -> dict[tuple[str, str], Commit]:
        if self._known is None:
            top, names = self._path(f"{self.folder}/published"), []
            if self._files.exists(top):
                names = [s.getPath().getName() for s in self._files.listStatus(top)]
            spans = sorted(tuple(n.removesuffix(".json").split("..")) for n in names if n.endswith(".json"))
            self._known = {span: self._read(*span) for span in spans}
        return self._known

    def _marker(self, first: str, last: str):
        return self._path(f"{self.folder}/published/{first}..{last}.json")

    def _read(self, first: str, last: str) -> Commit:
        stream = self._files.open(self._marker(first, last))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Commit(first, last, f"{self.folder}/{said['data']}", said["facts"], tuple(said["names"]))

    def live(self) -> list[Commit]:
        """The commits that together hold every published batch once, in order."""
        whole: list[Commit] = []
        # by first name, wider spans first: what ends before the last one taken lies within it
        for span in sorted(sorted(self._published(), key=lambda s: s[1], reverse=True), key=lambda s: s[0]):
            if not whole or span[1] > whole[-1].last:
                whole.append(self._published()[span])
        return whole

    def holds(self, name: str) -> bool:
        return any(name in c.names for (first, last), c in self._published().items() if first <= name <= last)

    def _publish(self, names: list[str], data: str, facts: dict) -> Commit:
        first, last = names[0], names[-1]
        aside = self._path(f"{self.folder}/published/{first}..{last}.{uuid.uuid4().hex}")
        stream = self._files.create(aside)
        try:
            stream.write(json.dumps({"data": data, "facts": facts, "names": names}).encode())
        finally:
            stream.close()
        if not self._files.rename(aside, self._marker(first, last)):
            raise OSError(f"cannot publish {first}..{last} in {self.folder}")
        commit = Commit(first, last, f"{self.folder}/{data}", facts, tuple(names))
        self._published()[first, last] = commit
        return commit

    def put(self, name: str, write: Callable[[str], dict]) -> Commit | None:
        """Have ``write`` fill a new folder and publish it with the facts that it returns; None if ``name`` is there.

        A new name that is not above all others is an error: no batch may slip in behind what was merged.
        """
        if self.holds(name):
            return None
        newest = max((last for _, last in self._published()), default="")
        if name <= newest:
            raise ValueError(f"batch {name} comes after {newest}, which is published")
        data = f"data/batch={name}-{uuid.uuid4().hex}"
        return self._publish([name], data, write(f"{self.folder}/{data}"))

    def merge(self, write: Callable[[list[Commit], str], dict], weight: str = "rows", at_least: int = 8) -> Commit | None:
        """Rewrite the youngest commits as one, once ``at_least`` have come that weigh no more than what follows them.

        A commit is taken along while it weighs no more than all younger ones together, so each row is rewritten
        some log(n) times and some log(n) + ``at_least`` commits are live.
        """
        live = self.live()
        taken, together = 0, 0
        for commit in reversed(live):
            if taken and commit.facts[weight] > together:
                break
            together += commit.facts[weight]
            taken += 1
        if taken < at_least:
            return None
        old = live[-taken:]
        data = f"data/batch={old[0].first}-{old[-1].last}-{uuid.uuid4().hex}"
        names = [name for commit in old for name in commit.names]
        merged = self._publish(names, data, write(old, f"{self.folder}/{data}"))
        for commit in old:
            self._files.delete(self._marker(commit.first, commit.last), False)
            self._published().pop((commit.first, commit.last))
        return merged

    def sweep(self) -> int:
        """Delete the folders of attempts that were not published and of merged batches; not while others read or write."""
        used = {c.path.rsplit("/", 1)[1] for c in self.live()}
        top = self._path(f"{self.folder}/data")
        if not self._files.exists(top):
            return 0
        spare = [s.getPath() for s in self._files.listStatus(top) if s.getPath().getName() not in used]
        for path in spare:
            self._files.delete(path, True)
        return len(spare)
