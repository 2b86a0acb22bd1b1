"""Aggregates that follow changes of their rows, and change feeds that are taken once however often they come."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.incremental import change_id
from tidemill.sources.scratch import stored
from tidemill.sources.snapshots import SnapshotTable


def take_changes(events: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Files normalised change events under their change ids in the table at the path, and returns those that it didn't have.

    The table is the ledger of what has been taken, so events and ledger are one commit; a feed that comes again, in
    another run and later than any watermark, gives no rows.
    """
    rows = events.withColumn("change_id", change_id())
    t = SnapshotTable(events.sparkSession, path, ["change_id"], buckets=buckets)
    return t.committed(t.insert_new(rows))


class AggregateView:
    """Groups of rows with n (rows) and aggregates {name: (count | sum | avg | min | max, column)}, kept in a table at a path.

    A refresh reads the table's groups that changes touch, adds what inserts and subtracts what deletes bring.
    A group loses its least or greatest value with a delete of that value: such groups alone are computed
    anew, from the rows as they are after the changes. Groups without rows go. Sums of doubles differ from a
    rebuild's in their last digits; of integers and decimals they don't.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], aggregates: Mapping[str, tuple[str, str]], buckets: int = 64) -> None:
        self.by, self.aggregates = by, dict(aggregates)
        if odd := {k for k, _ in self.aggregates.values()} - {"count", "sum", "avg", "min", "max"}:
            raise ValueError(f"aggregates that can't be maintained: {', '.join(sorted(odd))}")
        self.columns = list(dict.fromkeys(c for _, c in self.aggregates.values()))
        self.ends = [c for c in self.columns if any(k in ("min", "max") and x == c for k, x in self.aggregates.values())]
        self.table = SnapshotTable(spark, path, by, buckets=buckets)

    def _parts(self, sign: Column) -> list[Column]:
        out = [F.sum(sign).alias("n")]
        for i, c in enumerate(self.columns):
            out.append(F.sum(F.when(F.col(c).isNotNull(), sign).otherwise(0)).alias(f"n{i}"))
            if any(k in ("sum", "avg") and x == c for k, x in self.aggregates.values()):
                out.append(F.sum(F.col(c) * sign).alias(f"s{i}"))
            if c in self.ends:
                out += [f(F.when(test, F.col(c))).alias(f"{name}{i}{side}") for name, f in (("lo", F.min), ("hi", F.max)) for side, test in (("", sign > 0), ("_gone", sign < 0))]
        return out

    def _state(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*self.by).agg(*self._parts(F.lit(1)))
        return out.drop(*[c for c in out.columns if c.endswith("_gone")])

    def rebuild(self, rows: DataFrame) -> None:
        """All groups from all rows."""
        self.table.replace_all(self._state(rows))

    def refresh(self, inserts: DataFrame, deletes: DataFrame, rows: DataFrame) -> int:
        """Brings the groups that the changes touch up to date, in one commit; rows are those after the changes. Returns how many groups were computed anew."""
        names = [*self.by, *self.columns]
        changes = inserts.select(*names, F.lit(1).alias("__sign")).unionByName(deletes.select(*names, F.lit(-1).alias("__sign")))
        delta = stored(changes.groupBy(*self.by).agg(*self._parts(F.col("__sign"))), "changes-by-group")
        known = self.table.read(units=self.table.units_of(delta)) if self.table.exists() else None
        d = delta.select(*[F.col(c).alias(c if c in self.by else f"d_{c}") for c in delta.columns])
        if known is None:
            met = d.withColumns({c: F.lit(None).cast(k) for c, k in dict(self._state(rows).dtypes).items() if c not in self.by})
        else:
            old = known.select(*[F.col(c).alias(f"o_{c}" if c in self.by else c) for c in known.columns])
            same = F.lit(True)
            for c in self.by:
                same &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
            met = d.join(old, same, "left").drop(*[f"o_{c}" for c in self.by])
        plus = lambda c: F.coalesce(F.col(c) + F.col(f"d_{c}"), F.col(c), F.col(f"d_{c}"))
        kind = dict(self._state(rows).dtypes)
        new = {c: plus(c).cast(kind[c]) for c in kind if c == "n" or c[0] in "ns" and c[1:].isdigit()}
        lost = F.lit(False)
        for i, c in enumerate(self.columns):
            if c in self.ends:
                new |= {f"lo{i}": F.least(f"lo{i}", f"d_lo{i}"), f"hi{i}": F.greatest(f"hi{i}", f"d_hi{i}")}
                # A value that was inserted and deleted in one go may stand for the end as well.
                lost |= F.coalesce((F.col(f"d_lo{i}_gone") <= F.least(f"lo{i}", f"d_lo{i}")) | (F.col(f"d_hi{i}_gone") >= F.greatest(f"hi{i}", f"d_hi{i}")), F.lit(False))
        made = stored(met.select(*self.by, lost.alias("__lost"), *[v.alias(c) for c, v in new.items()]), "groups-after")
        again = made.where("__lost and n > 0").select(*[F.col(c).alias(f"a_{c}") for c in self.by])
        same = F.lit(True)
        for c in self.by:
            same &= F.col(c).eqNullSafe(F.col(f"a_{c}"))
        fresh = self._state(rows.join(again, same, "left_semi")).withColumn("__gone", F.lit(False))
        rest = made.where("not (__lost and n > 0)").withColumn("__gone", F.col("n") <= 0).drop("__lost")
        self.table.upsert(rest.unionByName(fresh), deleted="__gone")
        return again.count()

    def read(self) -> DataFrame:
        """by, n and the aggregates of each group."""
        out = {}
        for name, (kind, c) in self.aggregates.items():
            i = self.columns.index(c)
            n = F.col(f"n{i}")
            out[name] = {"count": n, "sum": F.when(n > 0, F.col(f"s{i}")) if kind == "sum" else None, "avg": F.when(n > 0, F.col(f"s{i}").cast("double") / n) if kind == "avg" else None}.get(kind)
            if kind in ("min", "max"):
                out[name] = F.when(n > 0, F.col(f"{'lo' if kind == 'min' else 'hi'}{i}"))
        return self.table.read().select(*self.by, "n", *[c.alias(n) for n, c in out.items()])
