"""Snapshot tables: a directory per version and numbered pointers to them.

A change writes new versions of the tables that it touches and then a pointer
with the next number, by renaming a whole file; the largest number is current.
No pointer is replaced, so readers see all of a change or nothing, and a crash
leaves the state before. Of two changes at once the later one fails where a
rename doesn't replace, as on HDFS and local disks; an object store needs one
writer at a time. All paths go through Hadoop's file systems.

A table may be stored in parts by the values of a column (groups by level, say):
each part has versions of its own, so a change of one leaves the files of the
others as they are. Readers see the parts as one table.

Versions that no pointer names are collected: after a time of grace for those
who still read them, or at once if they hold rows that must be gone.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a version that isn't current any more may still be read.
GRACE = 3600.0
#: Stands between a table's name and the part in the pointer and in folder names.
PART = "+"
_PART_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path("")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def init(self) -> Store:
        """Creates the root; an existing one stays as it is."""
        self._fs.mkdirs(self._path(""))
        if not self._numbers():
            self._point({}, 1)
        return self

    def _numbers(self) -> list[int]:
        """Numbers of the pointers, in order."""
        found = self._fs.globStatus(self._path("CURRENT-*")) or []
        return sorted(int(f.getPath().getName()[8:]) for f in found)

    def _point(self, versions: dict[str, str], number: int) -> None:
        temporary, pointer = self._path(f"_pointer-{uuid.uuid4().hex}"), self._path(f"CURRENT-{number:012}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        if self._fs.exists(pointer) or not self._fs.rename(temporary, pointer):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"{self.root} was changed meanwhile")

    def _current(self) -> tuple[int, dict[str, str]]:
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"{self.root} isn't a corpus")
        rows = self.spark.read.text(f"{self.root}/CURRENT-{numbers[-1]:012}").collect()
        return numbers[-1], json.loads("".join(r.value for r in rows))

    def versions(self) -> dict[str, str]:
        """Directory of each table in the current snapshot."""
        return self._current()[1]

    def read(self, name: str) -> DataFrame:
        """A table, with all its parts."""
        return self._read({n: path for n, path in self.versions().items() if n.split(PART)[0] == name})[name]

    def tables(self) -> dict[str, DataFrame]:
        return self._read(self.versions())

    def _read(self, versions: dict[str, str]) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for name, path in versions.items():
            table, rows = name.split(PART)[0], self.spark.read.parquet(f"{self.root}/{path}")
            out[table] = out[table].unionByName(rows, allowMissingColumns=True) if table in out else rows
        return out

    def replace_parts(self, name: str, column: str, parts: dict[str, DataFrame]) -> None:
        """Replaces all rows with these values of ``column``; the files of other parts stay as they are.

        The rows given for a value must have that value. Rows that were
        committed without parts are kept apart from those replaced, which
        rewrites them once. Values are few and name folders, so only letters,
        digits and ``_.-`` may stand in them.
        """
        for value, rows in parts.items():
            if not _PART_NAME.fullmatch(value):
                raise ValueError(f"{value!r} can't name a part")
            if not rows.where(~F.col(column).eqNullSafe(value)).isEmpty():
                raise ValueError(f"rows of another {column} than {value!r}")
        changed = {f"{name}{PART}{value}": rows for value, rows in parts.items()}
        if name in (versions := self.versions()):
            whole = self._read({name: versions[name]})[name]
            mine = F.coalesce(F.col(column).isin(*parts), F.lit(False))
            if not whole.where(mine).isEmpty():
                changed[name] = whole.where(~mine)
        self._commit(changed)

    def commit(self, tables: dict[str, DataFrame], purge: bool = False, drop: list[str] | tuple[str, ...] = ()) -> None:
        """Writes new versions of the tables, then points to them, and no longer to those of ``drop``.

        A table that is given whole takes the place of its parts. ``purge``
        then removes every version that isn't current, without a time of grace.
        """
        parts = [n for n in self.versions() if PART in n and n.split(PART)[0] in {*tables, *drop}]
        self._commit(tables, [*drop, *parts])
        if purge:
            self.collect(grace=float("-inf"))

    def _commit(self, tables: dict[str, DataFrame], drop: list[str] | tuple[str, ...] = ()) -> None:
        number, old = self._current()
        new = {name: path for name, path in old.items() if name not in drop}
        for name, df in tables.items():
            new[name] = f"{name}/v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{new[name]}")
        self._point(new, number + 1)
        for before in self._numbers()[:-2]:  # the last but one stays for readers that just listed it
            self._fs.delete(self._path(f"CURRENT-{before:012}"), False)

    def unnamed(self) -> dict[str, float]:
        """Versions that the current pointer doesn't name, with the time (POSIX seconds) at which they were written."""
        live = set(self.versions().values())
        found = {f"{s.getPath().getParent().getName()}/{s.getPath().getName()}": s.getModificationTime() / 1000 for s in self._fs.globStatus(self._path("*/v-*")) or []}
        return {path: at for path, at in found.items() if path not in live}

    def _drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def collect(self, grace: float = GRACE, now: float | None = None) -> list[str]:
        """Removes versions that aren't current and older than ``grace`` seconds; their paths.

        What a crash left half written is such a version.
        """
        at = time.time() if now is None else now
        old = [path for path, written in self.unnamed().items() if at - written >= grace]
        for path in old:
            self._drop(path)
        return old

    def purge(self, doomed: dict[str, DataFrame]) -> list[str]:
        """Removes at once every version that isn't current and may hold a doomed row; their paths.

        ``doomed`` has, by the name of a key column, a table of its values. A
        version without any of these columns may hold anything, as may one
        that can't be read. Earlier pointers go first, so no new reader starts
        on what is removed.
        """
        for before in self._numbers()[:-1]:
            self._fs.delete(self._path(f"CURRENT-{before:012}"), False)
        gone = [path for path in self.unnamed() if self._may_hold(path, doomed)]
        for path in gone:
            self._drop(path)
        return gone

    def _may_hold(self, path: str, doomed: dict[str, DataFrame]) -> bool:
        try:
            version = self.spark.read.parquet(f"{self.root}/{path}")
        except (PySparkException, Py4JJavaError):  # without files, or with half a file: a write that was broken off
            return True
        keys = [k for k in doomed if k in version.columns]
        return not keys or any(not version.join(doomed[k].select(k), k, "left_semi").isEmpty() for k in keys)

    def note(self, kind: str, text: str) -> None:
        """Keeps a text (a path, say) under a kind; the same text once."""
        path = self._path(f"notes/{kind}-{hashlib.sha256(text.encode()).hexdigest()[:16]}")
        if not self._fs.exists(path):
            out = self._fs.create(path, True)
            out.write(bytearray(text.encode()))
            out.close()

    def noted(self, kind: str) -> list[str]:
        found = self._fs.globStatus(self._path(f"notes/{kind}-*")) or []
        return sorted("\n".join(r.value for r in self.spark.read.text(f.getPath().toString()).collect()) for f in found)
