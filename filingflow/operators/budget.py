"""Selection of material under size budgets. Picks that depend on all picks before are state that streams over sorted partitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.packing import with_state


def prefix_budget(df: DataFrame, key: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each key in order until their sizes exceed the budget; the first always stays."""
    w = Window.partitionBy(key).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", total).withColumn("_n", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


class _Budget:
    """What is left of a key's budget, days that have ended, and the batch that is being filled."""

    def __init__(self, left: int):
        self.left, self.ended, self.batch, self.used = left, set(), 0, 0

    def takes(self, n: int | None) -> bool:
        ok = n is not None and n <= self.left
        self.left -= n if ok else 0
        return ok

    def takes_of(self, n: int | None, day) -> bool:
        if day in self.ended:
            return False
        if not (ok := self.takes(n)):
            self.ended.add(day)
        return ok

    def packs(self, n: int | None, most: int) -> int:
        n = n or 0
        if self.used and self.used + n > most:
            self.batch, self.used = self.batch + 1, 0
        self.used += n
        return self.batch


def greedy_budget(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order that still fit; rows that don't are skipped and smaller ones after them may follow. A row without size never fits."""
    picked = with_state(df, [key], [F.asc(c) for c in order], [size], lambda: _Budget(budget), lambda s, n: s.takes(n), "_ok", pa.bool_())
    return picked.where("_ok").drop("_ok")


def round_robin_budget(df: DataFrame, key: str, day: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Newest days first, one row a day in each round; a day ends with its first row that doesn't fit. That is the order of (place in the
    day, day falling), in which one pass decides."""
    turn = F.row_number().over(Window.partitionBy(key, day).orderBy(*order))
    picked = with_state(df.withColumn("_turn", turn), [key], [F.asc("_turn"), F.desc(day)], [size, day], lambda: _Budget(budget), lambda s, n, d: s.takes_of(n, d), "_ok", pa.bool_())
    return picked.where("_ok").drop("_ok", "_turn")


def lead_text(lines: DataFrame, id_col: str, findings: str, opening: int = 1100, k: int = 5) -> DataFrame:
    """Lines of the opening within so many bytes, and the first k finding lines after it."""
    w = Window.partitionBy(id_col).orderBy("line")
    l = lines.withColumn("bytes", F.sum(F.octet_length("content")).over(w)).withColumn("opens", F.col("bytes") <= opening)  # noqa: E741
    found = l.where(~F.col("opens") & F.col("content").rlike(findings)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
    return l.where("opens").unionByName(found).select(id_col, "line", "opens", "content")


def pack_batches(df: DataFrame, key: str, order: list[str], size: str, most: int) -> DataFrame:
    """Batches of rows in order, of at most so many bytes; a row that is larger is a batch of its own, one without size takes none."""
    return with_state(df, [key], [F.asc(c) for c in order], [size], lambda: _Budget(0), lambda s, n: s.packs(n, most), "batch", pa.int64())


def order_by_source(df: DataFrame, kind: str, ranks: dict[str, int], date: str) -> DataFrame:
    """Official sources, then older ones, then the forum; by date inside."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(kind)), F.lit(99))
    return df.withColumn("place", rank).orderBy("place", date)


def listing(days: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """One line a day that wasn't read: posts, accounts and findings."""
    rest = days.join(read, [key, "day"], "left_anti")
    return rest.select(key, "day", F.concat_ws(" · ", F.col("day").cast("string"), F.concat(F.col("posts"), F.lit(" posts")), F.concat(F.col("accounts"), F.lit(" accounts")), F.concat(F.col("findings"), F.lit(" findings"))).alias("line"))
