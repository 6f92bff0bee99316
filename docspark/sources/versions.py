"""Tables whose papers change as a whole: a manifest of commits, written last.

An attempt writes its rows to folders of its own and the papers that it replaces or deletes to another; then one small file, created only if no one else has, makes it commit n.  Readers take the
committed attempts only, and of each paper the rows of its last commit.  So a write that fails half-way changes nothing, a replay gives the same rows, all tables of a commit change together, and of two writers one is
told to try again.  Files are never changed in place.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Papers in these states are being worked on, and their session cannot go.
ACTIVE = ("queued", "extracting", "chunking", "embedding")


class Conflict(RuntimeError):
    """Another writer committed first; nothing was changed."""


class Refused(ValueError):
    """A rule forbids the change; nothing was changed."""


class Versions:
    """``tables``: name and DDL of each table; all have the key column.  ``few``: there are about as many keys as commits, each with many rows."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], *, key: str = "paper_id", few: bool = False) -> None:
        self.spark, self.folder, self.tables, self.key, self.few = spark, folder.rstrip("/"), tables, key, few
        kind = next(f.dataType.simpleString() for f in spark.createDataFrame([], next(iter(tables.values()))).schema.fields if f.name == key)
        self._papers = f"{key} {kind}, _commit long, _deleted boolean"

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """number, attempt and tables of each commit, in order; one small file each."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        lines = self.spark.read.text([f"{self.folder}/commits/{n}" for n in names if n.isdigit()]).collect() if names else []
        return sorted((json.loads(r["value"]) for r in lines), key=lambda c: c["number"])

    def last(self) -> int:
        """The number of the last commit, 0 if there is none."""
        return max((c["number"] for c in self.commits()), default=0)

    def write(self, rows: dict[str, DataFrame], *, papers: DataFrame | None = None, deleted: bool = False, after: int | None = None) -> int:
        """Replaces the papers that the rows hold, and those of ``papers``, in all tables; with ``deleted`` they go.  Returns the number of the commit.

        ``after``: the last commit that the rows take into account; another one since then is a conflict.
        """
        number, attempt = self.last() + 1, uuid.uuid4().hex
        if after is not None and number != after + 1:
            raise Conflict(f"commit {number - 1} came after {after}")
        stamped = lambda df: df.withColumn("_commit", F.lit(number).cast("long"))
        for name, df in rows.items():
            stamped(df.select([F.col(c) for c in self.spark.createDataFrame([], self.tables[name]).columns])).write.parquet(f"{self.folder}/{name}/{attempt}")
        named = [self._stored(name, [attempt]).select(self.key) for name in rows] + ([papers.select(self.key)] if papers is not None else [])
        keys = named[0]
        for more in named[1:]:
            keys = keys.unionByName(more)
        stamped(keys.distinct()).withColumn("_deleted", F.lit(deleted)).write.parquet(f"{self.folder}/papers_of/{attempt}")
        self._commit(number, {"number": number, "attempt": attempt, "tables": sorted(rows), "deleted": deleted})
        return number

    def _commit(self, number: int, record: dict) -> None:
        path, fs = self._path("commits", f"{number:012}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"commit {number} exists already") from e
            raise
        out.write(bytearray(json.dumps(record).encode()))
        out.close()

    def _stored(self, name: str, attempts: list[str]) -> DataFrame:
        schema = self._papers if name == "papers_of" else f"{self.tables[name]}, _commit long"
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/{a}" for a in attempts])

    def live(self) -> DataFrame:
        """key, _commit of every paper that is there."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], self._papers).select(self.key, "_commit")
        changes = self._stored("papers_of", [c["attempt"] for c in done])
        last = changes.groupBy(self.key).agg(F.max_by("_deleted", "_commit").alias("_deleted"), F.max("_commit").alias("_commit"))
        return last.where("not _deleted").select(self.key, "_commit")

    def read(self, name: str) -> DataFrame:
        """The rows of a table as of now."""
        done = self.commits()
        attempts = [c["attempt"] for c in done if name in c["tables"]]
        if not attempts:
            return self.spark.createDataFrame([], self.tables[name])
        # Nothing has replaced the rows of the last commit, so only older ones are looked up.
        whole = attempts[-1:] if done[-1]["attempt"] == attempts[-1] and done[-1].get("deleted") is False else []
        parts = [self._stored(name, whole).where(F.col(self.key).isNotNull())] if whole else []
        if older := attempts[: len(attempts) - len(whole)]:
            live = self.live()
            parts.append(self._stored(name, older).join(F.broadcast(live) if self.few else live, [self.key, "_commit"], "left_semi"))
        return reduce(DataFrame.unionByName, parts).drop("_commit")

    def delete(self, papers: DataFrame) -> int:
        """The papers go from all tables at once; papers that are not there make no difference."""
        return self.write({}, papers=papers, deleted=True)

    def delete_session(self, session_id: str, *, table: str = "papers") -> int:
        """All papers of a session go, unless one is still being worked on."""
        of = self.read(table).where(F.col("session_id") == session_id)
        if not of.where(F.lower("status").isin(*ACTIVE)).isEmpty():
            raise Refused(f"session {session_id} has papers that are being worked on")
        return self.delete(of)

    def vacuum(self) -> int:
        """Removes what no commit names, or what no live paper stands in; returns how many attempts went.  Not while others write."""
        used = {r["_commit"] for r in self.live().select("_commit").distinct().collect()}  # one number a commit
        named, gone = {c["attempt"]: c["number"] for c in self.commits()}, set()
        for name in (*self.tables, "papers_of"):
            path, fs = self._path(name)
            for attempt in fs.listStatus(path) if fs.exists(path) else ():
                number = named.get(attempt.getPath().getName())
                if number is None:
                    fs.delete(attempt.getPath(), True)
                elif name == "papers_of" or number in used:
                    continue  # the papers of a commit say which older rows are replaced
                else:  # the folder stays, as readers name it
                    for f in fs.listStatus(attempt.getPath()):
                        fs.delete(f.getPath(), True)
                gone.add(attempt.getPath().getName())
        return len(gone)
