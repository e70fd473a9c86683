"""Tables in folders by month, and versions of several tables at once.

A version is one file that names, for each table, its schema and its folders, one for
each value of the table's folder column. A change writes the folders that it touches
anew and then a version that names these and all others as they were. Readers keep the
version that they have begun with. Of two changes that start from one version the
first to commit wins; the other raises ``Conflict`` and has to start again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .operators import mutate

#: Folder of a table without a folder column.
WHOLE = ""

#: Folder value of nulls and empty texts.
NONE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class Change:
    """New rows of a table. ``touched`` are the folder values that ``rows`` replaces:
    None replaces the whole table; a touched value without rows loses its folder."""

    rows: DataFrame
    by: str | None = None
    touched: tuple | None = None


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: name -> {"schema": JSON, "by": column or None, "folders": {value: path}}
    tables: dict = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _file(root: str, number: int) -> str:
    return f"{root}/_versions/{number:012d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, oldest first."""
    store, at = _path(spark, f"{root}/_versions")
    if not store.exists(at):
        return []
    names = (s.getPath().getName() for s in store.listStatus(at))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, by default the newest; version 0 has no tables."""
    if number is None:
        number = max(numbers(spark, root), default=0)
    if number == 0:
        return Version()
    return Version(number, json.loads(spark.read.text(_file(root, number)).first()[0]))


def read(spark: SparkSession, root: str, name: str, at: Version | None = None, only: tuple | None = None) -> DataFrame:
    """A table as of a version; with ``only``, the rows of these folders alone."""
    entry = (at or version(spark, root)).tables[name]
    schema = StructType.fromJson(entry["schema"])
    paths = [p for v, p in entry["folders"].items() if only is None or v in only]
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("basePath", f"{root}/{name}").parquet(*paths).drop("in_write") if entry["by"] else reader.parquet(*paths)


def _write(df: DataFrame, path: str, by: str | None) -> None:
    if by:  # few files a folder, and a large folder from many tasks
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)


def _value(v) -> str:
    """A folder value as its folder is named, before characters are escaped."""
    return NONE if v is None or v == "" else str(v)


def _values(rows: DataFrame, by: str) -> tuple[str, ...]:
    return tuple(sorted({_value(r[0]) for r in rows.select(by).distinct().collect()}))  # as many as folders


def _like(rows: DataFrame, old: DataFrame) -> DataFrame:
    """The columns of ``old`` first; ones that it lacks follow, and are null in folders that stay."""
    return rows.select(*old.columns, *(c for c in rows.columns if c not in old.columns))


def _folders(spark: SparkSession, path: str, by: str) -> dict[str, str]:
    """Folder values and paths of a write: one a month, not a row."""
    store, at = _path(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
    return {unquote(n.split("=", 1)[1]): f"{path}/{n}" for n in names if n.startswith(f"{by}=")}


def commit(spark: SparkSession, root: str, changes: dict[str, Change], base: Version) -> Version:
    """Write ``changes`` and make them, all at once, the version after ``base``."""
    tables = dict(base.tables)
    for name, change in changes.items():
        path = f"{root}/{name}/in_write={uuid.uuid4().hex}"
        _write(change.rows, path, change.by)
        new = _folders(spark, path, change.by) if change.by else {WHOLE: path}
        kept = {}
        if change.touched is not None:
            kept = {v: p for v, p in base.tables[name]["folders"].items() if v not in change.touched}
            if strays := sorted(new.keys() & kept.keys()):
                raise ValueError(f"{name}: rows of folders that the change does not touch: {strays}")
        tables[name] = {"schema": change.rows.schema.jsonValue(), "by": change.by, "folders": kept | new}
    number = base.number + 1
    store, final = _path(spark, _file(root, number))
    _, temp = _path(spark, f"{root}/_versions/_{uuid.uuid4().hex}")
    out = store.create(temp, False)
    out.write(bytearray((json.dumps(tables) + "\n").encode()))
    out.close()
    if store.exists(final) or not store.rename(temp, final):
        store.delete(temp, False)
        raise Conflict(f"version {number} was committed meanwhile")
    return Version(number, tables)


def touched(spark: SparkSession, root: str, name: str, keys: DataFrame, on: str, at: Version) -> tuple:
    """The folder values that hold ``keys``: two columns of the table are read."""
    by = at.tables[name]["by"]
    found = read(spark, root, name, at).select(on, by).join(keys.select(on).distinct(), on, "left_semi")
    return _values(found, by)


def change(spark: SparkSession, root: str, name: str, keys: DataFrame, on: str, to: Callable[[DataFrame], DataFrame]) -> Version:
    """Apply ``to`` to the folders that hold ``keys`` and to nothing else.

    Keys that no row has change nothing; then the version stays what it is.
    """
    base = version(spark, root)
    months = touched(spark, root, name, keys, on, base)
    if not months:
        return base
    old = read(spark, root, name, base, months)
    return commit(spark, root, {name: Change(_like(to(old), old), base.tables[name]["by"], months)}, base)


def append(spark: SparkSession, root: str, name: str, rows: DataFrame) -> Version:
    """Add rows: the folders that get some are written anew, all others stay."""
    base = version(spark, root)
    by = base.tables[name]["by"]
    months = _values(rows, by)
    if not months:
        return base
    old = read(spark, root, name, base, months)
    return commit(spark, root, {name: Change(old.unionByName(rows.select(old.columns)), by, months)}, base)


def revert(spark: SparkSession, root: str, number: int) -> Version:
    """Make the tables what they were in an earlier version, as a new version."""
    return commit(spark, root, {}, Version(version(spark, root).number, version(spark, root, number).tables))


def expire(spark: SparkSession, root: str, keep: int) -> None:
    """Delete all versions but the newest ``keep``, and the folders that only they name."""
    all_ = numbers(spark, root)
    old, kept = all_[:-keep], all_[-keep:]
    named = lambda n: {p for t in version(spark, root, n).tables.values() for p in t["folders"].values()}
    live = set().union(*(named(n) for n in kept)) if kept else set()
    dead = set().union(*(named(n) for n in old)) - live if old else set()
    for n in old:
        store, at = _path(spark, _file(root, n))
        store.delete(at, False)
    for p in dead:
        store, at = _path(spark, p)
        store.delete(at, True)


# --- changes of the ledger's tables ---


def resolve(spark: SparkSession, root: str, decisions: DataFrame) -> Version:
    """Decisions on suspected duplicates (id, resolution), in the months of their rows."""
    return change(spark, root, "ledger", decisions, "id", lambda part: mutate.resolve_candidates(part, decisions))


def set_category(spark: SparkSession, root: str, changes: DataFrame) -> Version:
    """A user's categories (id, new_category): the months of the rows in ``ledger``,
    and ``rules`` and, where the store has it, ``merchants`` as a whole, in one version."""
    base = version(spark, root)
    months = touched(spark, root, "ledger", changes, "id", base)
    if not months:
        return base
    old = read(spark, root, "ledger", base, months)
    merchants = read(spark, root, "merchants", base) if "merchants" in base.tables else None
    ledger, rules, merchants = mutate.set_category(old, changes, read(spark, root, "rules", base), merchants)
    new = {"ledger": Change(_like(ledger, old), base.tables["ledger"]["by"], months), "rules": Change(rules)}
    return commit(spark, root, new | ({"merchants": Change(merchants)} if merchants is not None else {}), base)


def remove_statements(spark: SparkSession, root: str, statements: DataFrame) -> Version:
    """Take the rows of statements (statement_id) out of ``ledger`` and the statements
    out of ``statements``, in one version; see ``mutate.undo_plan`` for what may go."""
    base = version(spark, root)
    gone = statements.select("statement_id").distinct()
    months = touched(spark, root, "ledger", gone, "statement_id", base)
    left = lambda df: df.join(gone, "statement_id", "left_anti").select(df.columns)
    new = {"statements": Change(left(read(spark, root, "statements", base)))}
    if months:
        new["ledger"] = Change(left(read(spark, root, "ledger", base, months)), base.tables["ledger"]["by"], months)
    return commit(spark, root, new, base)
