"""Distributed global order statistics.

A plain ``row_number() over (order by x)`` or an exact ``percentile`` over a
whole table funnels every row (or every distinct value) through one task.
Two ways around it:

*Selection* finds the values (or value-and-id pairs) at given ranks without sorting
anything.  A histogram of the column is counted, the buckets that hold the
wanted ranks are narrowed to the least and largest value seen in them, and only
these are counted again, until a bucket has one value or few enough to fetch.
Each step is one aggregation with map-side combine over a narrow written table;
what reaches the driver is bounded by the buckets.  Quantiles, bins, top shares
and scores are then one comparison per row.

*Global ranks*, where every row's own number is wanted:

1. range-partition on the sort key and sort inside each partition (one
   shuffle; the composite key with a unique id splits a hot value over many
   partitions);
2. number rows inside each partition;
3. store the partition id and in-partition position as columns and
   materialise them (Parquet under ``spark.checkpoint.dir``), so a
   re-computation after an executor loss cannot re-sample the range bounds
   and renumber rows inconsistently;
4. add per-partition offsets from a table with one row per partition
   (bounded by the partition count, so broadcasting it is safe).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import ensure_checkpoint_dir, materialize

#: Buckets of a histogram, and rows of a bucket from which its values are fetched.
BUCKETS, FETCH = 1024, 1 << 15

_PID, _LOCAL, _OFF = "_ord_pid", "_ord_local", "_ord_off"


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions: the session's shuffle partitions (not the cores seen at this moment, which are few
    under dynamic allocation)."""
    if num_partitions:
        return num_partitions
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, shuffle)


def _offsets(staged: DataFrame, size_col: str) -> DataFrame:
    """One row per partition: exclusive prefix sum of ``size_col`` and the total."""
    per_part = staged.groupBy(_PID).agg(F.sum(size_col).alias("_ord_n"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    return per_part.select(
        _PID,
        F.coalesce(F.sum("_ord_n").over(before), F.lit(0)).cast("long").alias(_OFF),
        F.sum("_ord_n").over(everything).cast("long").alias("_ord_total"),
    )


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "rank",
                      total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based row number in ``order`` over the whole DataFrame.

    ``order`` must be a total order (end it with a unique key) for the
    numbering to be deterministic.  ``total`` optionally adds the row count.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = _cols(order)
    staged = materialize(
        df.repartitionByRange(_partitions(df, num_partitions), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_LOCAL, F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "rank")
    sized = staged.withColumn("_ord_one", F.lit(1).cast("long"))
    offsets = _offsets(sized, "_ord_one")
    out = staged.join(F.broadcast(offsets), _PID, "inner")
    out = out.withColumn(name, F.col(_OFF) + F.col(_LOCAL) + 1)
    if total:
        out = out.withColumn(total, F.col("_ord_total"))
    return out.drop(_PID, _LOCAL, _OFF, "_ord_total")


# ---------------------------------------------------------------- selection

@dataclass
class _Interval:
    """Values of one column from ``low`` to ``high``: ``below`` rows are smaller, ``rows`` are inside."""
    column: str
    low: float
    high: float
    below: int
    rows: int
    ranks: list[int]
    scaled: bool = False


@dataclass(frozen=True)
class Found:
    """The value at a rank: it is the ``within``-th (from 1) of ``equal`` rows that have it."""
    value: float
    within: int
    equal: int


@dataclass
class Selection:
    """Values at ranks of several numeric columns of ``table``, which is read in every step and should be
    narrow and written.  ``columns`` are all long or all double; NULLs have no rank."""
    table: DataFrame
    columns: dict[str, Column]
    buckets: int = BUCKETS
    fetch: int = FETCH
    n: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = list(self.columns)
        aggs = [f(self.columns[c]).alias(f"{k}{i}") for i, c in enumerate(names)
                for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]
        row = self.table.agg(*aggs).first()
        self.n = {c: row[f"n{i}"] for i, c in enumerate(names)}
        self._range = {c: (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(names)}
        for c, (low, high) in self._range.items():
            if isinstance(low, float) and not (math.isfinite(low) and math.isfinite(high)):
                raise ValueError(f"{c} has infinite values, which have no interpolated quantiles")

    def at(self, ranks: dict[str, Sequence[int]]) -> dict[tuple[str, int], Found]:
        """(column, rank) -> the value there; ranks from 1 to the column's number of values."""
        todo = [_Interval(c, *self._range[c], 0, self.n[c], sorted(set(r))) for c, r in ranks.items() if r and self.n[c]]
        found: dict[tuple[str, int], Found] = {}
        while todo:
            for x in todo:
                if x.low == x.high:
                    found.update({(x.column, r): Found(x.low, r - x.below, x.rows) for r in x.ranks})
            todo = [x for x in todo if x.low != x.high]
            if todo:
                todo = [y for x, counts in zip(todo, self._counted(todo)) for y in self._narrowed(x, counts)]
        return found

    def _bucket(self, x: _Interval) -> Column:
        """A whole number that does not fall where the value grows: the value itself where few rows are
        left, else a bucket; the first ones are spread by logarithm, so that a long tail does not
        take the whole range."""
        value, low, high = self.columns[x.column], F.lit(x.low), F.lit(x.high)
        if isinstance(x.low, int) and x.high - x.low < 1 << 62:
            part = (value - low).cast("double") / F.lit(float(x.high - x.low))
        elif x.scaled:
            part = (value.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
        else:
            def spread(v: Column) -> Column:
                return F.signum(v.cast("double")) * F.log1p(F.abs(v.cast("double")))
            part = F.coalesce(F.try_divide(spread(value) - spread(low), spread(high) - spread(low)), F.lit(0.0))
        return F.least(F.greatest(F.floor(part * self.buckets), F.lit(0)), F.lit(self.buckets - 1)).cast("long")

    def _counted(self, todo: list[_Interval]) -> list[list[tuple]]:
        """(rows, least, largest value) of the buckets of each interval, in order; one job for all of them."""
        labels = []
        for i, x in enumerate(todo):
            value = self.columns[x.column]
            few = x.rows <= self.fetch
            bucket = F.lit(None).cast("long") if few else self._bucket(x)
            labels.append(F.when(value.between(F.lit(x.low), F.lit(x.high)), F.struct(
                F.lit(i).alias("i"), bucket.alias("b"), F.when(F.lit(few), value).alias("own"), value.alias("v"))))
        rows = (self.table.select(F.explode(F.array_compact(F.array(*labels))).alias("x")).groupBy("x.i", "x.b", "x.own")
                .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).toArrow().to_pylist())
        out: list[list[tuple]] = [[] for _ in todo]
        for r in rows:
            out[r["i"]].append((r["low"], r["high"], r["n"]))
        return [sorted(x) for x in out]

    @staticmethod
    def _narrowed(x: _Interval, counts: list[tuple]) -> list[_Interval]:
        out, below = [], x.below
        for low, high, n in counts:
            ranks = [r for r in x.ranks if below < r <= below + n]
            if ranks:
                out.append(_Interval(x.column, low, high, below, n, ranks, scaled=True))
            below += n
        return out


@dataclass(frozen=True)
class Pair:
    """The (value, id) at a rank; ``key`` is None where all rows with the value are up to the rank."""
    value: float
    key: int | None

    def before(self, value: Column, key: Column) -> Column:
        """Whether a row comes after the pair in ascending (value, id) order."""
        beyond = value > F.lit(self.value)
        return beyond if self.key is None else beyond | ((value == F.lit(self.value)) & (key > F.lit(self.key)))


def pairs_at(table: DataFrame, value: Column, key: Column, ranks: Callable[[int], Sequence[int]],
             ) -> tuple[dict[int, Pair], int]:
    """The (value, id) pairs at ranks of ``table`` in ascending order, ties by the unique ``key``, and the
    number of rows with a value; ``ranks`` gets that number."""
    chosen = Selection(table, {"v": value})
    n = chosen.n["v"]
    wanted = [r for r in ranks(n) if 1 <= r <= n]
    out: dict[int, Pair] = {}
    ties: dict[float, dict[int, int]] = {}
    for (_, rank), x in chosen.at({"v": wanted}).items():
        if x.within == x.equal:
            out[rank] = Pair(x.value, None)
        else:
            ties.setdefault(x.value, {})[x.within] = rank
    for v, within in ties.items():
        same = Selection(table.where(value == F.lit(v)), {"k": key})
        for (_, k), x in same.at({"k": list(within)}).items():
            out[within[k]] = Pair(v, x.value)
    return out, n


def _kind(df: DataFrame, columns: Sequence[str]) -> str:
    whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in columns)
    return "long" if whole else "double"


def _number(df: DataFrame, column: str, kind: str) -> Column:
    """The column as a long, or as a double whose NaN are NULL (missing, as in pandas)."""
    value = F.col(column).cast(kind)
    return value if kind == "long" else F.when(~F.isnan(value), value)


def _narrow(df: DataFrame, value: str, key: str, name: str) -> tuple[DataFrame, Column, Column]:
    """(value, id) of a table, written; values are longs or doubles."""
    number = _number(df, value, _kind(df, [value]))
    table = materialize(df.select(number.alias("v"), F.col(key).alias("k")).where("v is not null"), name)
    return table, F.col("v"), F.col("k")


def rank_bins(df: DataFrame, value: str, key: str, out: str, q: int = 4) -> DataFrame:
    """``out``: pandas ``qcut(rank(method='first'), q, labels=1..q)`` of ``value``, ties in ``key`` order.

    Label k + 1 begins after rank floor(k (n - 1) / q) + 1, so the q - 1 pairs at
    these ranks are selected and every row is compared with them."""
    table, v, k = _narrow(df, value, key, "rank-bins")

    def ranks(n: int) -> list[int]:
        return [i * (n - 1) // q + 1 for i in range(1, q)]

    cuts, n = pairs_at(table, v, k, ranks)
    own, label = F.col(value).cast(table.schema["v"].dataType), F.lit(1)
    for rank in ranks(n) if n else ():
        label = label + F.when(cuts[rank].before(own, F.col(key)), 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), label).cast("int"))


def top_mask(df: DataFrame, value: str, key: str, size: Callable[[int], int], out: str) -> tuple[DataFrame, int]:
    """``out``: whether a row is among the first ``size(n)`` by ``value`` descending, ties in ``key`` order; n counts
    the rows with a value, which alone can be."""
    table, v, k = _narrow(df, value, key, "top-mask")
    cuts, n = pairs_at(table, -v, k, lambda n: [size(n)])
    own = -F.col(value).cast(table.schema["v"].dataType)
    inside = ~next(iter(cuts.values())).before(own, F.col(key)) if cuts else F.lit(False)
    return df.withColumn(out, F.coalesce(inside & F.col(value).isNotNull(), F.lit(False))), n


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                   written: bool = False) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several numeric columns (NULLs ignored), as numbers.

    Same definition as pandas ``quantile`` / DuckDB ``quantile_cont``:
    h = (n-1)p, q = v[floor h] + (h - floor h) (v[floor h + 1] - v[floor h]).
    The columns are read once and written (unless ``df`` is ``written`` already);
    all columns share the steps of the selection.  A column without values gives None."""
    kind = _kind(df, columns)
    table = df.select(*[_number(df, c, kind).alias(f"v{i}") for i, c in enumerate(columns)])
    table = table if written else materialize(table, "quantiles")
    chosen = Selection(table, {c: F.col(f"v{i}") for i, c in enumerate(columns)})
    places = {c: [(int((chosen.n[c] - 1) * p // 1), math.modf((chosen.n[c] - 1) * p)[0]) for p in probs] for c in columns}
    found = chosen.at({c: [r for low, _ in places[c] for r in (low + 1, min(low + 2, chosen.n[c]))]
                       for c in columns if chosen.n[c]})
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n = chosen.n[c]
        out[c] = []
        for low, part in places[c] if n else [(None, None)] * len(probs):
            if low is None:
                out[c].append(None)
            else:
                a, b = float(found[c, low + 1].value), float(found[c, min(low + 2, n)].value)
                out[c].append(a + part * (b - a))
    return out


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """:func:`quantile_table` of one column as a 1-row DataFrame; an empty input gives a row of NULLs.
    ``num_partitions`` is accepted from older callers; a selection deals nothing by value."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    values = quantile_table(df, [column], probs)[column]
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in zip(names, values)])


def approx_quantiles(df: DataFrame, column: str, probs: Sequence[float], names: Sequence[str] | None = None,
                     accuracy: int = 10_000) -> DataFrame:
    """Quantiles from a mergeable sketch of bounded size, in one pass: the value of a row whose rank is at most
    n / ``accuracy`` away from the wanted one (no interpolation)."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    sketch = F.percentile_approx(F.col(column).cast("double"), F.array(*[F.lit(float(p)) for p in probs]), accuracy)
    return df.agg(sketch.alias("q")).select(*[F.col("q")[i].alias(c) for i, c in enumerate(names)])


def quartile_of_rank(rank: Column, n: Column, q: int = 4) -> Column:
    """pandas ``qcut(rank(method='first'), q, labels=1..q)``.

    The edges are the interpolated quantiles of 1..n, so the label of rank r is
    1 + #{k in 1..q-1 : q (r-1) > k (n-1)} (integer arithmetic, exact).
    ``ntile(q)`` differs from this for about half of all n.
    """
    label = F.lit(1)
    for k in range(1, q):
        label = label + F.when(F.lit(q) * (rank - 1) > F.lit(k) * (n - 1), 1).otherwise(0)
    return label.cast("int")
