"""A table and its description under two fixed names, exchanged together.

Renames cannot replace two paths at once, so a writer first leaves an intent: what there was before, and the digests of what
is to come. Whoever writes next, or calls ``recover``, finds it after a crash and either finishes, if both new parts are
in place and fit each other, or puts the old ones back. Readers refuse as long as an intent or a leftover is there, so they
see the old pair or the new one, never one of each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.contracts import ContractError
from . import publish


class PairError(ContractError):
    """The pair is interrupted, incomplete or its parts do not fit each other."""


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self._system, _, self._jvm = publish._fs(spark, root)
        self._spark, self.root = spark, root

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def there(self, name: str) -> bool:
        return self._system.exists(self.path(name))

    def move(self, old: str, new: str) -> None:
        if not self._system.rename(self.path(old), self.path(new)):
            raise PairError(f"{old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        self._system.delete(self.path(name), True)

    def read(self, name: str) -> dict:
        return publish.read_json(self._spark, f"{self.root}/{name}")

    def write(self, name: str, said: dict) -> None:
        publish.write_json(self._spark, f"{self.root}/{name}", said)


ROWS, ABOUT, INTENT = "rows.parquet", "about.json", "INTENT.json"
_BACKUPS = {ROWS: "rows.before", ABOUT: "about.before"}


def _fits(spark: SparkSession, files: _Files) -> bool:
    """Both parts are there, and the description is that of the rows."""
    if not (files.there(ROWS) and files.there(ABOUT)):
        return False
    said = files.read(ABOUT)
    return [said["rows"], *said["checksum"]] == publish.checksum(spark.read.parquet(f"{files.root}/{ROWS}"))


def recover(spark: SparkSession, root: str) -> str:
    """Settle an interrupted exchange: ``clean`` (there was none), ``finished`` or ``rolled back``."""
    files = _Files(spark, root)
    backups = [b for b in _BACKUPS.values() if files.there(b)]
    if not files.there(INTENT):
        if backups:
            raise PairError(f"{backups} are left in {root} without an intent")
        return "clean"
    intent = files.read(INTENT)
    # the new pair is in place if what is there fits and is what the intent announces
    new = _fits(spark, files) and files.read(ABOUT)["name"] == intent["name"]
    if not new:
        for name, backup in _BACKUPS.items():
            if files.there(backup):
                files.delete(name)
                files.move(backup, name)
            elif not intent["had"][name]:
                files.delete(name)
    for leftover in (*_BACKUPS.values(), intent["stage"]):
        files.delete(leftover)
    files.delete(INTENT)
    return "finished" if new else "rolled back"


def exchange(df: DataFrame, root: str, about: dict, sort: list[str] | None = None) -> None:
    """Replace the pair by ``df`` and a description that holds ``about``, the number of rows and their checksum."""
    spark = df.sparkSession
    files = _Files(spark, root)
    recover(spark, root)
    name = uuid.uuid4().hex
    staged = f".stage-{name}"
    generation = publish.stage(df, f"{root}/{staged}", sort)
    found = publish.checksum(spark.read.schema(df.schema).parquet(f"{root}/{staged}/{generation}"))
    files.write(f"{staged}/{ABOUT}", {"about": about, "name": name, "rows": found[0], "checksum": found[1:]})
    files.write(INTENT, {"name": name, "stage": staged, "had": {n: files.there(n) for n in _BACKUPS}})
    for n, backup in _BACKUPS.items():
        if files.there(n):
            files.move(n, backup)
    files.move(f"{staged}/{generation}", ROWS)
    files.move(f"{staged}/{ABOUT}", ABOUT)
    recover(spark, root)


def read(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    """Rows and description of a whole pair."""
    files = _Files(spark, root)
    left = [n for n in (INTENT, *_BACKUPS.values()) if files.there(n)]
    if left:
        raise PairError(f"the pair in {root} is interrupted ({left}); recover it first")
    if not _fits(spark, files):
        raise PairError(f"the parts of the pair in {root} do not fit each other, or one is missing")
    return spark.read.parquet(f"{root}/{ROWS}"), files.read(ABOUT)["about"]
