"""Macros kept by owner: a change log folded to a table, and a stored table that is replaced safely.

A macro has an id, a tag, an action, an icon, and is a favourite or not; an owner has at most one favourite of each
normalized tag. What a change does depends on the macros as they are then, so a log is folded in order: it is dealt by
owner and sorted, and a task holds the macros of one owner at a time, never the log.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# The changes that a log may hold.
ADD, EDIT, TOGGLE, DELETE, RESET = "add", "edit", "toggle", "delete", "reset"
TABLE = "owner long, pos int, id string, tag string, act string, icon string, favourite boolean"


def normal_key(tag: str) -> str:
    """A tag without marks, in small letters."""
    tag = re.sub(r"[-_&/\\+]", " ", tag.lower())
    return re.sub(r"\s+", " ", re.sub(r"[.,#!$%\^*;:{}=`~()?\"']", "", tag)).strip()


class Dock:
    """One owner's macros, in order."""

    def __init__(self, defaults: tuple[tuple, ...] = ()) -> None:
        self.defaults, self.macros = defaults, {}
        self.change(RESET, None, "", "", "", False)

    def change(self, op: str, id_: str | None, tag: str, act: str, icon: str, favourite: bool) -> None:
        """One change; one of a macro that is not there, and an addition or edit without tag or action, change nothing."""
        tag, act = (tag or "").strip(), (act or "").strip()
        if op == RESET:
            self.macros = {row[0]: list(row[1:]) for row in self.defaults}
        elif op == DELETE:
            self.macros.pop(id_, None)
        elif op == TOGGLE and id_ in self.macros:
            own = self.macros[id_]
            self.favour(own[0], not own[3])
            own[3] = not own[3]
        elif op in (ADD, EDIT) and tag and act and (op == ADD) == (id_ not in self.macros):
            self.favour(tag, favourite)
            self.macros[id_] = [tag, act, icon, bool(favourite)]

    def favour(self, tag: str, favourite: bool) -> None:
        """Before a macro of the tag becomes a favourite, no other one of the tag is."""
        if favourite:
            for other in self.macros.values():
                if normal_key(other[0]) == normal_key(tag):
                    other[3] = False


def folded(log: DataFrame, defaults: tuple[tuple, ...] = ()) -> DataFrame:
    """The table after a log of (owner, seq, op, id, tag, act, icon, favourite). Owners without macros have no rows;
    an unknown op changes nothing; of equal seq the order is that of op and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TABLE.split(", ")]
        owner, dock = None, None

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(owner, i, id_, *macro) for i, (id_, macro) in enumerate(dock.macros.items())], columns=names)

        for batch in batches:
            for row in batch.itertuples(index=False):
                if dock is None or row.owner != owner:
                    if dock is not None and dock.macros:
                        yield rows()
                    owner, dock = row.owner, Dock(defaults)
                dock.change(row.op, row.id, row.tag, row.act, row.icon, row.favourite)
        if dock is not None and dock.macros:
            yield rows()

    placed = log.where("owner is not null").select("owner", "seq", "op", "id", "tag", "act", "icon", "favourite").repartition("owner").sortWithinPartitions("owner", "seq", "op", "id")
    return placed.mapInPandas(run, TABLE)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a stored table; what a lost job left has no success mark and is none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n) and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def replace(table: DataFrame, path: str) -> None:
    """Stores a table in place of the one at the path: as its next version, which readers see when it is whole. The
    table may have been read from the path; the version before stays for those who read it, older ones go."""
    spark = table.sparkSession
    known = _versions(spark, path)
    table.write.mode("overwrite").parquet(f"{path}/v={max(known, default=0) + 1}")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for old in known[:-1]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}"), True)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; empty where there is none."""
    known = _versions(spark, path)
    return spark.read.schema(TABLE).parquet(f"{path}/v={known[-1]}") if known else spark.createDataFrame([], TABLE)


# Tasks get this small module with the function, so no package has to be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
