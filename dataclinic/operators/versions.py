"""Bounded undo stack of table versions (C9), in memory or as a change log in shared storage.

``VersionedTable``: a version is just a DataFrame reference (lineage is free).  Long repair chains
grow the plan, so every ``checkpoint_every`` applies the current version is cut
with a reliable checkpoint in the shared ``spark.checkpoint.dir``.

``ChangeLog``: a base table and, for each version, the rows whose number of copies changed.  It is read by merging;
undo writes a manifest.  It outlives the session: any later one opens the same folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import normalize_missing
from ..session import cut_lineage
from .integrity import row_hash

MAX_SNAPSHOTS = 3


@dataclass
class VersionedTable:
    current: DataFrame
    max_snapshots: int = MAX_SNAPSHOTS
    checkpoint_every: int = 5
    history: list = field(default_factory=list)
    applied: int = 0

    def apply(self, fn, *args, **kwargs) -> DataFrame:
        """Snapshot, then replace the current version by ``fn(current, ...)``."""
        self.history.append(self.current)
        if len(self.history) > self.max_snapshots:
            self.history.pop(0)
        nxt = fn(self.current, *args, **kwargs)
        self.applied += 1
        if self.checkpoint_every and self.applied % self.checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        self.current = nxt
        return nxt

    def undo(self) -> bool:
        """Restore the previous version; False when nothing is left."""
        if not self.history:
            return False
        self.current = self.history.pop()
        return True

    def reset(self, df: DataFrame) -> None:
        self.current = df
        self.history = []
        self.applied = 0

    @property
    def snapshots(self) -> int:
        return len(self.history)


HASH = ["__h1", "__h2"]
#: Copies of one row that are unfolded at a time.
COPIES = 1 << 16


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({h: row_hash(df.columns, i + 1) for i, h in enumerate(HASH)})


class ChangeLog:
    """A table in a shared folder: ``base``, one folder of changed rows per version, and numbered manifests.

    Rows are a multiset (128-bit hash of the whole row, NULLs marked; NaN is NULL from the start).  A version stores each
    row value whose number of copies changed, with the numbers before and after, so an apply costs storage in proportion
    to what it changed.  A version that changes the columns or their types is a new base.  The current version is what the
    newest manifest names; at most ``max_snapshots`` earlier ones can be restored.  Two writers cannot both write the
    same manifest: the second fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._newest()

    @classmethod
    def create(cls, df: DataFrame, path: str, max_snapshots: int = MAX_SNAPSHOTS) -> "ChangeLog":
        log = cls.__new__(cls)
        log.spark, log.path = df.sparkSession, path.rstrip("/")
        log.manifest = {"seq": 0, "max": max_snapshots, "current": [log._base(df)], "earlier": []}
        log._commit()
        return log

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "ChangeLog":
        return cls(spark, path)

    # -- storage
    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _newest(self) -> dict:
        fs, p = self._fs("manifest")
        names = sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(names[-1], wholetext=True).first()[0])

    def _commit(self) -> None:
        self.manifest["seq"] += 1
        fs, p = self._fs(f"manifest/{self.manifest['seq']:08d}.json")
        out = fs.create(p, False)  # fails where another writer was first
        try:
            out.write(bytearray(json.dumps(self.manifest).encode()))
        finally:
            out.close()

    def _base(self, df: DataFrame) -> dict:
        name = f"base-{uuid.uuid4().hex[:12]}"
        _hashed(normalize_missing(df)).write.mode("error").parquet(f"{self.path}/{name}")
        return {"base": name, "schema": df.schema.json()}

    def _columns(self, chain) -> list[str]:
        return [f.name for f in T.StructType.fromJson(json.loads(chain[0]["schema"])).fields]

    # -- reading
    def read(self) -> DataFrame:
        """The current version: the base rows that no change names, and the copies of the changed rows."""
        chain = self.manifest["current"]
        base = self.spark.read.parquet(f"{self.path}/{chain[0]['base']}")
        cols = self._columns(chain)
        if len(chain) == 1:
            return base.select(*cols)
        logs = None
        for k, v in enumerate(chain[1:]):
            one = self._log(v).withColumn("__k", F.lit(k))
            logs = one if logs is None else logs.unionByName(one)
        row = F.struct("__after", *[F.col(f"`{c}`") for c in cols])
        last = logs.groupBy(*HASH).agg(F.max_by(row, "__k").alias("r"))
        kept = base.join(last.select(*HASH), HASH, "left_anti").select(*cols)
        many = last.where("r.__after > 0").select("r.*")
        blocks = F.sequence(F.lit(0), F.floor((F.col("__after") - 1) / COPIES).cast("int"))
        many = many.withColumn("__b", F.explode(blocks))
        left = F.least(F.col("__after") - F.col("__b") * COPIES, F.lit(COPIES)).cast("int")
        many = many.withColumn("__c", F.explode(F.sequence(F.lit(1), left)))
        return kept.unionByName(many.select(*cols))

    def _log(self, version: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version['log']}")

    def changes(self) -> DataFrame | None:
        """What the last apply changed: rows with ``__before`` and ``__after`` copies; None where it is a new base."""
        last = self.manifest["current"][-1]
        return self._log(last) if "log" in last else None

    @property
    def snapshots(self) -> int:
        return len(self.manifest["earlier"])

    # -- writing
    def apply(self, fn, *args, **kwargs) -> None:
        """Replaces the current version by ``fn(current, ...)``."""
        now = self.read()
        new = normalize_missing(fn(now, *args, **kwargs))
        chain = self.manifest["current"]
        if [(f.name, f.dataType) for f in new.schema.fields] != [(f.name, f.dataType) for f in now.schema.fields]:
            nxt = [self._base(new)]
        else:
            name = f"log-{uuid.uuid4().hex[:12]}"
            cols = now.columns
            side = lambda d, b, a: _hashed(d).select(*HASH, F.lit(b).alias("b"), F.lit(a).alias("a"),
                                                    F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
            both = side(now, 1, 0).unionByName(side(new, 0, 1)).groupBy(*HASH).agg(
                F.sum("b").alias("__before"), F.sum("a").alias("__after"), F.first("row").alias("row"))
            both.where("__before <> __after").select(*HASH, "__before", "__after", "row.*").write.mode("error").parquet(
                f"{self.path}/{name}")
            nxt = [*chain, {"log": name}]
        earlier = [*self.manifest["earlier"], chain][-self.manifest["max"]:] if self.manifest["max"] else []
        self.manifest = {**self.manifest, "current": nxt, "earlier": earlier}
        self._commit()

    def undo(self) -> bool:
        """Makes the version before the last apply the current one; False when nothing is left."""
        if not self.manifest["earlier"]:
            return False
        *rest, back = self.manifest["earlier"]
        self.manifest = {**self.manifest, "current": back, "earlier": rest}
        self._commit()
        return True

    def compact(self) -> None:
        """Writes the current version as a base of its own, so reading merges nothing; undo still works."""
        self.manifest = {**self.manifest, "current": [self._base(self.read())]}
        self._commit()
