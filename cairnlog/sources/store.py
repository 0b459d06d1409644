"""A levelled store of changes on parquet with atomic commits.

A table is a folder of parquet, sorted by key, one row a key, never changed after it is written. A version is a small
JSON manifest (with a checksum) that lists the tables of each level; level 0 is newest last, deeper levels hold tables
of disjoint key ranges. A commit publishes the next manifest under a name that must not exist yet, by one atomic step,
so of two writers one fails. Readers keep the version they opened. Folders that no manifest lists are left from failed
writes. After a failed commit a store takes no more writes: it is opened anew.

Changes may come late: seq decides, not the order of batches. Only where a delete was dropped that may be newer than a
late change of a key that the store no longer knows, the answer is lost, and then the write fails.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.operators.versions import DELETE, PUT

SCHEMA = "seq long, op int, k string, v string"
LEVELS = 7


@dataclass
class Table:
    name: str
    lo: str
    hi: str
    rows: int
    size: int
    seq: int  # its newest change
    first: int = 0  # its oldest change


@dataclass
class Manifest:
    version: int = 0
    applied: int = 0  # the newest change
    forgotten: int = 0  # the newest delete that compaction dropped
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each numbered source
    levels: list[list[Table]] = field(default_factory=lambda: [[] for _ in range(LEVELS)])
    cursors: list[str] = field(default_factory=lambda: [""] * LEVELS)  # where each level was compacted last

    def encode(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})

    @classmethod
    def decode(cls, text: str) -> Manifest:
        outer = json.loads(text)
        if zlib.crc32(outer["body"].encode()) != outer["crc"]:
            raise ValueError("the manifest's checksum is wrong")
        body = json.loads(outer["body"])
        levels = [[Table(**t) for t in level] for level in body.pop("levels")]
        return cls(levels=levels, **body)


def flush_of(table: Table) -> str:
    """The folder of one write, which holds tables of disjoint key ranges."""
    return table.name.split("/")[0]


class Store:
    """put, delete, get, multi_get, snapshot, compaction and clean-up over one folder."""

    def __init__(self, spark: SparkSession, path: str, l0_trigger: int = 4, l1_bytes: int = 16 << 20, multiplier: int = 10, table_rows: int = 1_000_000):
        self.spark, self.path = spark, path.rstrip("/")
        self.l0_trigger, self.l1_bytes, self.multiplier, self.table_rows = l0_trigger, l1_bytes, multiplier, table_rows
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifests"))
        self.manifest = self._newest()
        self.closed, self.failed = False, None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _newest(self) -> Manifest:
        found = [int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(self._path("manifests")) if s.getPath().getName().endswith(".json")]
        if not found:
            return Manifest()
        stream = self.fs.open(self._path(f"manifests/{max(found):012d}.json"))
        try:
            return Manifest.decode(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, new: Manifest) -> None:
        """Publishes the next version; fails if another writer was first, and for good."""
        new.version = self.manifest.version + 1
        temporary, final = self._path(f"manifests/{uuid.uuid4().hex}.tmp"), self._path(f"manifests/{new.version:012d}.json")
        out = self.fs.create(temporary, False)
        out.write(bytearray(new.encode().encode()))
        out.close()
        if not self._publish(temporary, final):
            self.fs.delete(temporary, False)
            self.failed = f"version {new.version} was committed by another writer"
            raise RuntimeError(self.failed)
        self.manifest = new

    def _publish(self, temporary, final) -> bool:
        """Gives a whole file its name unless the name is taken. A local rename would replace a file, so local files are
        linked; other file systems refuse to rename onto a file."""
        if self.fs.getUri().getScheme() != "file":
            return not self.fs.exists(final) and self.fs.rename(temporary, final)
        place = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(place(final), place(temporary))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        self.fs.delete(temporary, False)
        return True

    def _copy(self) -> Manifest:
        return Manifest.decode(self.manifest.encode())

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    def _writable(self) -> None:
        self._open()
        if self.failed:
            raise RuntimeError(f"the store takes no more writes: {self.failed}")

    def _write(self, rows: DataFrame, files: int | None = None) -> list[Table]:
        """Writes rows (one a key) as tables of disjoint key ranges; gives those that hold rows, by key."""
        name = uuid.uuid4().hex
        dealt = rows.repartitionByRange(files, "k") if files else rows.repartitionByRange("k")  # then Spark fits the number to the bytes
        dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "k").write.partitionBy("part").parquet(f"{self.path}/tables/{name}")
        if not self.fs.exists(self._path(f"tables/{name}")) or not any(s.getPath().getName().startswith("part=") for s in self.fs.listStatus(self._path(f"tables/{name}"))):
            self.fs.delete(self._path(f"tables/{name}"), True)
            return []
        size = F.sum(F.octet_length("k") + F.octet_length("v"))
        stats = self.spark.read.parquet(f"{self.path}/tables/{name}").groupBy("part").agg(
            F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("rows"), size.alias("size"), F.max("seq").alias("seq"), F.min("seq").alias("first")
        )
        return [Table(f"{name}/part={r.part}", r.lo, r.hi, r.rows, r.size, r.seq, r.first) for r in stats.orderBy("lo").collect()]  # one row a table

    def _read(self, tables: list[Table]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/tables/{t.name}" for t in tables])

    def write(self, changes: DataFrame, source: str | None = None, number: int = 0) -> None:
        """Commits a batch of changes (seq, op, k, v) as one flush into level 0, deletes kept.

        A batch whose source and number were committed before changes nothing, and neither does one that holds no change
        newer than what the store has of its keys. Late changes count by their seq; see the top for the one case that fails."""
        self._writable()
        if source is not None and number <= self.manifest.batches.get(source, -1):
            return
        rows = changes.groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("w")).select("w.seq", "w.op", "k", "w.v")
        made = self._write(rows)
        if made and min(t.first for t in made) <= self.manifest.applied and not self._news(made):
            self.fs.delete(self._path(f"tables/{flush_of(made[0])}"), True)
            made = []
        if made or source is not None:
            new = self._copy()
            new.levels[0] += made
            new.applied = max([new.applied, *(t.seq for t in made)])
            if source is not None:
                new.batches[source] = number
            self._commit(new)

    def _news(self, made: list[Table]) -> bool:
        """Whether written tables hold a change that is newer than the store's own of its key. Raises, and deletes the
        tables, if a late change cannot be placed."""
        rows = self._read(made).select("k", "seq")
        meets = [t for t in self.tables() if any(t.lo <= m.hi and t.hi >= m.lo for m in made)]
        known = self._read(meets).join(rows.select("k"), "k", "left_semi").groupBy("k").agg(F.max("seq").alias("own"))
        j = rows.join(known, "k", "left")
        unplaced = F.col("own").isNull() & (F.col("seq") <= self.manifest.forgotten)
        told = j.agg(F.count(F.when(unplaced, 1)).alias("unplaced"), F.count(F.when(F.col("own").isNull() | (F.col("seq") > F.col("own")), 1)).alias("news")).first()
        if told.unplaced:
            self.fs.delete(self._path(f"tables/{flush_of(made[0])}"), True)
            raise ValueError(f"{told.unplaced} late changes are of keys whose deletes may have been dropped")
        return told.news > 0

    def _rows(self, items: list[tuple[str, str]], op: int) -> DataFrame:
        at = self.manifest.applied
        return self.spark.createDataFrame([(at + 1 + i, op, k, v) for i, (k, v) in enumerate(items)], SCHEMA)

    def put(self, key: str, value: str) -> None:
        self.write(self._rows([(key, value)], PUT))

    def delete(self, key: str) -> None:
        """Succeeds for an absent key too."""
        self.write(self._rows([(key, "")], DELETE))

    def tables(self) -> list[Table]:
        return [t for level in self.manifest.levels for t in level]

    def snapshot(self) -> DataFrame:
        """(k, v): the live image of the opened version. The newest change of a key wins, whatever table holds it."""
        self._open()
        return self._live(self._read(self.tables()))

    def _live(self, rows: DataFrame) -> DataFrame:
        won = rows.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("w"))
        return won.where(F.col("w.op") == PUT).select("k", "w.v")

    def get(self, key: str) -> str | None:
        """Only tables whose range holds the key are read, and the key filter reaches their scans."""
        self._open()
        hit = self._live(self._read([t for t in self.tables() if t.lo <= key <= t.hi]).where(F.col("k") == key)).first()
        return hit.v if hit else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(k, v) of each distinct key of `keys` (k); v is null where it is absent."""
        self._open()
        wanted = keys.select("k").distinct()
        return wanted.join(self._live(self._read(self.tables()).join(wanted, "k", "left_semi")), "k", "left")

    def due(self) -> int | None:
        """The level to compact: 0 at its trigger, else the shallowest over its limit."""
        levels = self.manifest.levels
        if len({flush_of(t) for t in levels[0]}) >= self.l0_trigger:
            return 0
        for level in range(1, LEVELS - 1):
            if sum(t.size for t in levels[level]) > self.l1_bytes * self.multiplier ** (level - 1):
                return level
        return None

    def compact(self, level: int) -> None:
        """Merges all of level 0, or one table of a deeper level in turn, into the next level. A table that meets no
        other moves as it is, deletes included; deletes are dropped only if no deeper table meets the range."""
        self._writable()
        new = self._copy()
        upper = list(new.levels[level])
        if level:
            beyond = [t for t in upper if t.hi > new.cursors[level]]
            upper = [min(beyond or upper, key=lambda t: t.hi)]
            new.cursors[level] = upper[0].hi
        lo, hi = min(t.lo for t in upper), max(t.hi for t in upper)
        meets = lambda t: t.lo <= hi and t.hi >= lo
        lower = [t for t in new.levels[level + 1] if meets(t)]
        lo, hi = min([lo, *(t.lo for t in lower)]), max([hi, *(t.hi for t in lower)])
        names = {t.name for t in (*upper, *lower)}
        if len(upper) == 1 and not lower:
            made = upper
        else:
            won = self._read(upper + lower).groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("w")).select("w.seq", "w.op", "k", "w.v")
            if not any(meets(t) for deep in new.levels[level + 2 :] for t in deep):
                new.forgotten = max(new.forgotten, *(t.seq for t in (*upper, *lower)))  # no dropped delete is newer
                won = won.where(F.col("op") == PUT)
            made = self._write(won, -(-sum(t.rows for t in (*upper, *lower)) // self.table_rows))
        new.levels[level] = [t for t in new.levels[level] if t.name not in names]
        new.levels[level + 1] = sorted([*(t for t in new.levels[level + 1] if t.name not in names), *made], key=lambda t: t.lo)
        self._commit(new)

    def maintain(self) -> int:
        """Compacts until nothing is due; the number of compactions."""
        done = 0
        while (level := self.due()) is not None:
            self.compact(level)
            done += 1
        return done

    def orphans(self) -> list[str]:
        """Table folders that the opened version does not list."""
        live, root = {flush_of(t) for t in self.tables()}, self._path("tables")
        if not self.fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root) if s.getPath().getName() not in live)

    def clean(self) -> int:
        """Removes orphans and older manifests. Only for a moment when no reader holds an older version."""
        gone = self.orphans()
        for name in gone:
            self.fs.delete(self._path(f"tables/{name}"), True)
        for s in self.fs.listStatus(self._path("manifests")):
            if s.getPath().getName() != f"{self.manifest.version:012d}.json":
                self.fs.delete(s.getPath(), False)
        return len(gone)

    def close(self) -> None:
        self.closed = True
