"""A keyed table as a log of changes: every commit appends its own rows, and a read merges.

    data/<uuid>        Parquet rows of a commit or of several merged ones: key, values, ``_seq``, ``_gone``
    log/<seq>          a commit: which data it added; a cleared table's commit stands for all before it
    merged/<lo>-<hi>   commits lo to hi as one run of data

Adding k rows writes k rows. A read takes the runs that no longer run covers and keeps of each key the row of the highest
commit; deleted keys are rows of their own (``_gone``) until a merge reaches the first commit. FAN adjacent runs of about one
size are merged, so a row is written again once for each power of FAN by which the table outgrows its run. Writers never wait for
each other: a commit's number is taken by creating its file, which fails where the file exists, and the loser
takes the next one. Merging changes no commit and can run beside writers and readers. Numbers are as exclusive as the file
system's creation of a file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Adjacent runs that a merge takes together, none FAN times as large as another or as LEAST bytes.
FAN, LEAST = 8, 1 << 20
#: Milliseconds after which a record without content counts as that of a writer that died.
DEAD = 600_000
SEQ, GONE = "_seq", "_gone"


@dataclass(frozen=True, order=True)
class Run:
    lo: int
    hi: int
    data: str | None = None
    size: int = 0
    merged: bool = False

    @property
    def length(self) -> int:
        return self.hi - self.lo + 1


class ChangeLog:
    """``schema``: of the table; ``key``: its key columns, which hold no nulls."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: Sequence[str] = ("id",), fan: int = FAN) -> None:
        self.spark, self.path, self.key, self.fan = spark, path.rstrip("/"), list(key), fan
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema.fields), T.StructField(SEQ, T.LongType()), T.StructField(GONE, T.BooleanType())])
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at) if not f.getPath().getName().startswith(".")] if self._fs.exists(at) else []

    def _record(self, name: str) -> dict | None:
        """A record, or None of one that is still being written or gone."""
        try:
            stream = self._fs.open(self._at(name))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None

    def _create(self, name: str, record: dict) -> bool:
        """Write a record where none is; whether it is ours that stands there."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._at(name)):
                return False
            raise e
        stream.write(json.dumps(record).encode())
        stream.close()
        return self._record(name) == record

    # runs

    def _commits(self) -> list[Run]:
        """Commits, up to one whose record is not readable yet."""
        out = []
        for name in sorted(n for n in self._names("log") if n.isdigit()):
            record = self._record(f"log/{name}")
            if record:
                out.append(Run(0 if record["cleared"] else int(name), int(name), record["data"], record["size"]))
            elif not self._older(f"log/{name}", DEAD):
                break
        return out

    def _older(self, name: str, ms: float) -> bool:
        return not self._fs.exists(self._at(name)) or self._fs.getFileStatus(self._at(name)).getModificationTime() <= self._jvm.java.lang.System.currentTimeMillis() - ms

    def _merged(self) -> list[Run]:
        found = [(n, self._record(f"merged/{n}")) for n in self._names("merged")]
        return [Run(*map(int, n.split("-")), r["data"], r["size"], True) for n, r in found if r is not None]

    def runs(self) -> list[Run]:
        """The runs that make up the table, in order; none lies within another."""
        out: list[Run] = []
        # of runs that begin together the longest, and after it what it does not cover; a clearing covers what is before it
        merged = {(r.lo, r.hi): r for r in self._commits()} | {(r.lo, r.hi): r for r in self._merged()}
        for run in sorted(merged.values(), key=lambda r: (r.lo, -r.hi)):
            if not out or run.hi > out[-1].hi:
                out.append(run)
        return out

    def _rows(self, runs: Sequence[Run]) -> DataFrame:
        """Rows and deletions of ``runs``. Those of a commit take its number here."""
        out = None
        merged = [f"{self.path}/data/{r.data}" for r in runs if r.data and r.merged]
        reader = self.spark.read.schema(self.stored)
        for rows in [*([reader.parquet(*merged)] if merged else []), *(reader.parquet(f"{self.path}/data/{r.data}").withColumn(SEQ, F.lit(r.hi).cast("long")) for r in runs if r.data and not r.merged)]:
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.stored) if out is None else out

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of the last commit. Aggregated before the shuffle."""
        picked = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.stored.names), SEQ).alias("_row"))
        return picked.select("_row.*")

    def _merge(self, runs: Sequence[Run]) -> DataFrame:
        """Rows and deletions of ``runs``. The first and longest run holds a key once: it meets the changed keys of the
        others and is not sorted or aggregated itself; where those are few, Spark sends them to its tasks."""
        first, later = runs[0], runs[1:]
        if not later:
            return self._rows([first])
        changes = self._latest(self._rows(later))
        return self._rows([first]).join(changes.select(*self.key), self.key, "left_anti").select(*self.stored.names).unionByName(changes)

    def read(self) -> DataFrame:
        """The table as of now; later commits do not change what is returned."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._merge(runs).where(f"NOT {GONE}").select(*self.schema.names)

    def changes(self, after: int) -> DataFrame:
        """Rows and deletions, each with its ``_seq``, of the commits behind ``after`` (-1: all): what a follower needs that
        has seen ``after``. Commits that were merged with earlier ones appear as what became of them."""
        runs = [r for r in self.runs() if r.hi > after]
        return self._merge(runs).where(F.col(SEQ) > after) if runs else self.spark.createDataFrame([], self.stored)

    # writing

    def _data(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def _size(self, data: str | None) -> int:
        return self._fs.getContentSummary(self._at(f"data/{data}")).getLength() if data else 0

    def _commit(self, rows: DataFrame | None, cleared: bool = False) -> int:
        # the rows are written before their number is known: a number is then taken without a gap
        data = self._data(rows) if rows is not None else None
        record = {"data": data, "cleared": cleared, "size": self._size(data), "by": uuid.uuid4().hex}
        known = [int(n) for n in self._names("log") if n.isdigit()] + [int(n.split("-")[1]) for n in self._names("merged")]
        seq = max(known, default=-1) + 1
        while not self._create(f"log/{seq:020d}", record):
            seq += 1
        return seq

    def _once(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        """One row for each key: the last in ``order``, else one that is the same in every run."""
        names = self.schema.names
        last = F.struct(*order) if order else F.xxhash64(*[F.to_json(F.struct(c)) for c in names])
        picked = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key)).groupBy(*self.key)
        return picked.agg(F.max_by(F.struct(*names), last).alias("_row")).select("_row.*")

    def put(self, rows: DataFrame, order: Sequence[str] = (), unique: bool = False) -> int:
        """Upsert; the commit's number. ``unique``: keys do not repeat in ``rows``, which are then written as they come.
        ``rows`` are evaluated once."""
        kept = rows.select(*self.schema.names) if unique else self._once(rows, order)
        return self._commit(self._numbered(kept, gone=False))

    def delete(self, keys: DataFrame) -> int:
        """Delete; keys that are not there do no harm."""
        rest = [f for f in self.schema.fields if f.name not in self.key]
        gone = keys.select(*self.key).distinct().select(*self.key, *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
        return self._commit(self._numbered(gone.select(*self.schema.names), gone=True))

    def clear(self) -> int:
        return self._commit(None, cleared=True)

    def _numbered(self, rows: DataFrame, gone: bool) -> DataFrame:
        return rows.withColumns({SEQ: F.lit(None).cast("long"), GONE: F.lit(gone)})

    # merging

    def due(self) -> list[Run]:
        """The latest FAN adjacent runs of about one size; empty if there are none."""
        runs = self.runs()
        for i in range(len(runs) - self.fan, -1, -1):
            sizes = [max(r.size, LEAST) for r in runs[i : i + self.fan]]
            if max(sizes) < self.fan * min(sizes):
                return runs[i : i + self.fan]
        return []

    def merge(self, runs: Sequence[Run] | None = None) -> bool:
        """Make one run of ``runs`` (those due by default). False if there was nothing to do or another was first."""
        runs = list(self.due() if runs is None else runs)
        if len(runs) < 2:
            return False
        merged = self._merge(runs)
        if runs[0].lo == 0:  # nothing is before: a deletion has nothing left to delete
            merged = merged.where(f"NOT {GONE}")
        data = self._data(merged)
        return self._create(f"merged/{runs[0].lo:020d}-{runs[-1].hi:020d}", {"data": data, "size": self._size(data), "by": uuid.uuid4().hex})

    def compact(self) -> bool:
        """Make one run of all."""
        return self.merge(self.runs())

    def merge_in_background(self) -> Future:
        """Merge what is due, again and again until nothing is, beside readers and writers."""
        pool = ThreadPoolExecutor(1)

        def work() -> int:
            n = 0
            while self.merge():
                n += 1
            return n

        out = pool.submit(work)
        pool.shutdown(wait=False)
        return out

    def vacuum(self, seconds: float = 3600) -> int:
        """Delete records and data that longer runs cover or no record names, if older than ``seconds``: a read that began
        before may still need younger ones. The number of deleted data folders."""
        live, n = self.runs(), 0
        used = {r.data for r in live}
        covered = lambda lo, hi: any(r.lo <= lo and hi <= r.hi and r.length > hi - lo + 1 for r in live)
        # the last commit's record stays: the next number follows from it
        commits = sorted(int(x) for x in self._names("log") if x.isdigit())
        old = lambda name: self._older(name, seconds * 1000)
        for seq in commits[:-1]:
            if covered(seq, seq) and old(f"log/{seq:020d}"):
                self._fs.delete(self._at(f"log/{seq:020d}"), False)
        for name in self._names("merged"):
            if covered(*map(int, name.split("-"))) and old(f"merged/{name}"):
                self._fs.delete(self._at(f"merged/{name}"), False)
        named = used | {r.data for r in (*self._commits(), *self._merged())}
        for data in self._names("data"):
            if data not in named and old(f"data/{data}"):
                self._fs.delete(self._at(f"data/{data}"), True)
                n += 1
        return n
