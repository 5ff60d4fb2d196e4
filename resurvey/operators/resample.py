"""Bootstrap intervals.

Shared design: replicates are computed next to the data of one stratum, vectorised, and only
replicate statistics leave the task.  All strata use the same portable draws.  A stratum small
enough for one task is resampled there; a larger one is cut into blocks of its ordered values, and
a task replays the draws for a span of blocks and keeps those that fall into it (mean and median:
spans of millions of values, so that nearly all strata draw once).  Sums are formed block by block from the number of hits of each value, in the same order on both paths, so a result does not
depend on the path.  The seed is always an argument.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resurvey.functions import draws
from resurvey.functions.order import join_groups, number_rows, running_total, split_hot
from resurvey.operators import regen
from resurvey.operators.agree import MISSING, pair_cells, specific_agreement
from resurvey.session import written

CHUNK_VALUES = 4_000_000  # numbers held at once by a vectorised step


def _fields(df: DataFrame, cols: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in cols]


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by the stratum keys with a fixed partition count.

    The strata are small in bytes and heavy in work, so adaptive coalescing, which goes by
    bytes, would run them in a few tasks.  The grouping that follows keeps this partitioning.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def _rep_chunks(reps: int, width: int) -> Iterator[np.ndarray]:
    step = max(1, CHUNK_VALUES // max(1, width))
    for start in range(0, reps, step):
        yield np.arange(start, min(reps, start + step))


# ---- G1 -------------------------------------------------------------------------


def psa_interval(
    df: DataFrame, c1: str, c2: str, levels: Sequence, reps: int, seed: int, missing: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """G1. Specific agreement with its 5 and 95 bootstrap percentiles.

    Pairs are never resampled: a replicate is one multinomial draw over the contingency cells
    (at most (levels + 1)^2 of them), found cell by cell from portable binomial numbers, so the cost
    is the root of the number of pairs.
    No interval below five uses of the category.
    """
    by = list(by)
    names = [str(x) for x in levels] + ([MISSING] if missing else [])
    cells = pair_cells(df, c1, c2, levels, missing, by)
    block = 100
    one = F.lit(1).alias("_one")
    table = (
        cells.groupBy(*by, *([] if by else [one]))
        .agg(F.array_sort(F.collect_list(F.struct("rating1", "rating2", "pairs"))).alias("cells"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // block))))
        .withColumn("stratum", draws.stratum_number(*[F.col(c) for c in by]) if by else F.lit(0).cast("long"))
        .repartition(*by, "block")
        .select(*by, "cells", "block", "stratum")
    )
    out = T.StructType([*_fields(table, by), T.StructField("category", T.StringType()), T.StructField("_psa", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {name: i for i, name in enumerate(names)}
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = np.array([place[c["rating1"]] for c in row["cells"]])
                b = np.array([place[c["rating2"]] for c in row["cells"]])
                pairs = np.array([c["pairs"] for c in row["cells"]], dtype=np.int64)
                size = min(block, reps - row["block"] * block)
                got = draws.multinomial(pairs, row["block"] * block + np.arange(size), int(row["stratum"]), seed)
                num = np.zeros((size, len(names)))
                den = np.zeros((size, len(names)))
                for j in range(len(pairs)):
                    den[:, a[j]] += got[:, j]
                    den[:, b[j]] += got[:, j]
                    if a[j] == b[j]:
                        num[:, a[j]] += 2 * got[:, j]
                psa = np.rint(100 * np.divide(num, den, out=np.zeros_like(num), where=den > 0))
                part = pd.DataFrame({"category": np.tile(names, size), "_psa": psa.ravel()})
                for c in by:
                    part[c] = row[c]
                yield part[[*by, "category", "_psa"]]

    limits = (
        table.mapInPandas(run, out)
        .groupBy(*by, "category")
        .agg(F.percentile("_psa", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    )
    enough = F.col("denom") >= 5
    return (
        specific_agreement(df, c1, c2, levels, missing, by)
        .join(limits, by + ["category"], "left")
        .withColumn("psa_lo", F.when(enough, F.col("_q")[0]))
        .withColumn("psa_hi", F.when(enough, F.col("_q")[1]))
        .drop("_q")
    )


# ---- G2 -------------------------------------------------------------------------

INTERVAL_PROBS = {"lo95": 0.025, "lo68": 0.16, "hi68": 0.84, "hi95": 0.975}
INTERVAL_COLUMNS = [f"{s}_{q}" for s in ("mean", "median") for q in INTERVAL_PROBS]
# Draws that one row of work replays, draws of one replicate that are hashed at once, and hits counted at once.
WORK_DRAWS, DRAWS_AT_ONCE, HITS_AT_ONCE = 1 << 28, 1 << 21, 1 << 17


def _middle_ranks(n: int) -> tuple[int, int]:
    """Ranks (from 1) whose mean is the median of n values."""
    return (n + 1) // 2, n // 2 + 1


def _block_hits(reps: np.ndarray, n: int, stratum: int, seed: int, low: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """How often each of the places low .. low + size - 1 of n is drawn, for some replicates after the other.

    Replicates come in groups so small that their hits stay in the cache, or are one where places are many.
    """
    ranges = range(0, n, DRAWS_AT_ONCE)
    drawn = draws.Draws(0, n, stratum, seed) if len(ranges) == 1 else None
    step = max(1, HITS_AT_ONCE // n if drawn else CHUNK_VALUES // size)
    room = np.empty(step * min(n, DRAWS_AT_ONCE), np.uint64)
    for at in range(0, len(reps), step):
        rep = reps[at : at + step]
        hits = np.zeros((len(rep), size), np.int64)
        for start in ranges:
            mine = drawn or draws.Draws(start, min(DRAWS_AT_ONCE, n - start), stratum, seed)
            places = mine.indices(rep, n, room)
            if low or size < n:
                places -= low
            for row, place in zip(hits, places, strict=True):
                row += np.bincount(place if size == n else place[place.view(np.uint64) < size], minlength=size)
        yield rep, hits


def _hit_sums(hits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the drawn values per replicate; the order of the additions depends on nothing but the block."""
    return (hits * values).sum(axis=1)


def _at_ranks(hits: np.ndarray, values: np.ndarray, ranks: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per replicate, the drawn values with those ranks (from 1) among the values; NaN for rank 0."""
    out = [np.full(len(hits), np.nan) for _ in ranks]
    for j, row in enumerate(hits):
        if any(rank[j] for rank in ranks):
            upto = np.cumsum(row)
            for found, rank in zip(out, ranks, strict=True):
                if rank[j]:
                    found[j] = values[np.searchsorted(upto, rank[j])]
    return out


def _limits(stats: Sequence[np.ndarray], probs: Sequence[float]) -> list[float]:
    return [x for s in stats for x in np.quantile(s, probs)]


def _rep_rows(df: DataFrame, reps: int, draws_each: Column) -> DataFrame:
    """``df`` with a row for each run of replicates (``rep0``, ``n_reps``) of about ``WORK_DRAWS`` draws."""
    step = F.greatest(F.lit(1), F.least(F.lit(reps), F.floor(F.lit(WORK_DRAWS) / draws_each))).cast("int")
    df = df.withColumn("_step", step).withColumn("rep0", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.col("_step"))))
    return df.withColumn("n_reps", F.least(F.col("_step"), F.lit(reps) - F.col("rep0"))).drop("_step")


def mean_median_interval(
    df: DataFrame, keys: Sequence[str], y: str, reps: int, seed: int, direct_rows: int = 10_000, block_rows: int = 65_536,
    task_rows: int = CHUNK_VALUES,
) -> DataFrame:
    """G2. Bootstrap percentiles 2.5, 16, 84, 97.5 of mean and median per group; NULL when n <= 1.

    Groups up to ``direct_rows`` values are resampled in one task each.  In larger groups equal
    values are merged and the ordered values cut into blocks of ``block_rows``, the unit of sums.  A
    task gathers the blocks of a span of about ``task_rows`` values and replays a run of replicates over
    them, so a group of one span draws every number once, whatever its blocks.  Of larger groups a
    first replay, in ranges of draws, counts the hits of every span, which tells the spans that hold
    the middle ranks of a replicate.  All paths give the same limits to the last bit.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(y).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    small, large = split_hot(data, keys, direct_rows)
    stratum = draws.stratum_number(*[F.col(k) for k in keys])
    kf = _fields(data, keys)
    probs = list(INTERVAL_PROBS.values())

    grouped = _spread(small, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("_y")).alias("values")).withColumn("stratum", stratum)
    out = T.StructType([*kf, *[T.StructField(c, T.DoubleType()) for c in INTERVAL_COLUMNS]])

    def one_group(v: np.ndarray, number: int) -> list[float]:
        n = len(v)
        means, medians = [], []
        for rep, hits in _block_hits(np.arange(reps), n, number, seed, 0, n):
            total = np.zeros(len(rep))
            for start in range(0, n, block_rows):
                total += _hit_sums(hits[:, start : start + block_rows], v[start : start + block_rows])
            low, high = _at_ranks(hits, v, [np.full(len(rep), r) for r in _middle_ranks(n)])
            means.append(total / n)
            medians.append((low + high) / 2)
        return _limits([np.concatenate(means), np.concatenate(medians)], probs)

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                one_group(np.asarray(values, dtype=float), int(number)) if len(values) > 1 else [None] * len(INTERVAL_COLUMNS)
                for values, number in zip(pdf["values"], pdf["stratum"], strict=True)
            ]
            stats = pd.DataFrame(rows, columns=INTERVAL_COLUMNS, dtype=float)
            yield pd.concat([pdf[keys].reset_index(drop=True), stats], axis=1)

    fine = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in INTERVAL_COLUMNS]
    near = grouped.mapInPandas(direct, out).select(*keys, *fine)
    if large is None:
        return near

    # (value, count) rows, cut at block borders in value order
    freq = large.groupBy(*keys, "_y", "_n").agg(F.count(F.lit(1)).alias("_f"))
    upto = running_total(freq, keys, "_y", "_f", "_upto")
    size = F.lit(block_rows).cast("long")
    pieces = upto.withColumn(
        "_block", F.explode(F.sequence(F.expr(f"(_upto - _f) div {block_rows}"), F.expr(f"(_upto - 1) div {block_rows}")))
    ).withColumn(
        "_piece",
        F.least("_upto", (F.col("_block") + 1) * size) - F.greatest(F.col("_upto") - F.col("_f"), F.col("_block") * size),
    )
    blocks = pieces.groupBy(*keys, "_n", "_block").agg(F.array_sort(F.collect_list(F.struct("_y", "_piece"))).alias("table"))
    per_span = max(1, task_rows // block_rows)
    span_rows = per_span * block_rows
    blocks = blocks.select(
        *keys, "_n", F.expr(f"_block div {per_span}").alias("_span"), "_block", F.col("table._y").alias("y"), F.col("table._piece").alias("f")
    )

    # first replay, where a group has several spans: hits per span, in ranges of draws
    sizes = large.where(F.col("_n") > span_rows).groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_c")).drop("_c").withColumn("_stratum", stratum)
    per_row = F.least(F.col("_n"), F.lit(WORK_DRAWS))
    work = _rep_rows(sizes, reps, per_row).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(WORK_DRAWS).cast("long"))))
    hit_fields = [T.StructField(c, T.LongType()) for c in ("_n", "rep", "_span", "hits")]

    def count_hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                n, number, rep0, n_reps, first = (int(row[c]) for c in ("_n", "_stratum", "rep0", "n_reps", "_from"))
                rep, n_spans = np.arange(rep0, rep0 + n_reps), -(-n // span_rows)
                found = np.zeros((n_reps, n_spans), np.int64)
                last = min(n, first + WORK_DRAWS)
                for start in range(first, last, DRAWS_AT_ONCE):
                    drawn = draws.Draws(start, min(DRAWS_AT_ONCE, last - start), number, seed)
                    for one, counts in zip(rep, found, strict=True):
                        counts += np.bincount(drawn.indices(one[None], n)[0] // span_rows, minlength=n_spans)
                res = pd.DataFrame({"_n": n, "rep": np.repeat(rep, n_spans), "_span": np.tile(np.arange(n_spans), n_reps), "hits": found.ravel()})
                for k in keys:
                    res[k] = [row[k]] * len(res)
                yield res[[*keys, "_n", "rep", "_span", "hits"]]

    counted = _spread(work, [*keys, "rep0", "_from"]).mapInPandas(count_hits, T.StructType([*kf, *hit_fields]))
    counted = counted.groupBy(*keys, "_n", "rep", "_span").agg(F.sum("hits").alias("hits"))
    order = Window.partitionBy(*keys, "rep").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("hits").over(order), F.lit(0)))
    inside = []
    for name, rank in (("low", F.expr("(_n + 1) div 2")), ("high", F.expr("_n div 2 + 1"))):
        local = rank - F.col("_before")
        inside.append(F.when((local >= 1) & (local <= F.col("hits")), local).otherwise(0).alias(name))
    wanted = counted.select(*keys, "_span", "rep", *inside).where("low > 0 OR high > 0")
    # the first block of a span carries the ranks
    wanted = wanted.groupBy(*keys, (F.col("_span") * per_span).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("rep", "low", "high"))).alias("ranks")
    )

    # second replay: every span keeps its own draws; its blocks meet in a task one after the other
    tasks = _rep_rows(join_groups(blocks, wanted, [*keys, "_block"], "left").withColumn("_stratum", stratum), reps, F.col("_n"))
    task = [*keys, "_span", "rep0"]
    tasks = _spread(tasks, task).sortWithinPartitions(*task, "_block")
    part_fields = [T.StructField(c, T.LongType()) for c in ("_n", "rep", "_span")]
    part_fields += [T.StructField("parts", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.DoubleType()) for c in ("low", "high")]]

    def one_span(row: dict, values: list[np.ndarray], listed: list | None) -> Iterator[pa.RecordBatch]:
        n, span = row["_n"], row["_span"]
        v = np.concatenate(values)
        all_reps = np.arange(row["rep0"], row["rep0"] + row["n_reps"])
        ranks = np.zeros((2, reps), np.int64)
        if n <= span_rows:
            ranks[:] = np.array(_middle_ranks(n))[:, None]
        for x in listed or ():
            ranks[:, x["rep"]] = x["low"], x["high"]
        ends = np.cumsum([len(x) for x in values])
        for rep, hits in _block_hits(all_reps, n, row["_stratum"], seed, span * span_rows, len(v)):
            sums = np.stack([_hit_sums(hits[:, b - len(x) : b], x) for x, b in zip(values, ends, strict=True)], axis=1)
            picked = _at_ranks(hits, v, [r[rep] for r in ranks])
            parts = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1]).astype(np.int32), sums.ravel())
            own = [pa.array([row[c]] * len(rep), t) for c, t in [*[(k, row["types"][k]) for k in keys], ("_n", pa.int64())]]
            columns = [*own, pa.array(rep), pa.array([span] * len(rep), pa.int64()), parts, *[pa.array(x) for x in picked]]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "_n", "rep", "_span", "parts", "low", "high"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*task, "_n", "n_reps", "_stratum"]
        own, values, listed = None, [], None
        for batch in batches:
            y, f = (batch.column(c) for c in ("y", "f"))
            for i, row in enumerate(batch.select(names).to_pylist()):
                same = own is not None and all(row[c] == own[c] or row[c] != row[c] and own[c] != own[c] for c in task)
                if not same:
                    if own is not None:
                        yield from one_span(own, values, listed)
                    own, values, listed = row | {"types": {k: batch.schema.field(k).type for k in keys}}, [], batch.column("ranks")[i].as_py()
                values.append(np.repeat(y[i].values.to_numpy(), f[i].values.to_numpy()))
        if own is not None:
            yield from one_span(own, values, listed)

    nan_null = lambda c: F.when(~F.isnan(c), F.col(c))
    parts = tasks.select(*task, "_n", "n_reps", "_stratum", "y", "f", "ranks").mapInArrow(replay, T.StructType([*kf, *part_fields]))
    total = F.aggregate(F.flatten(F.array_sort(F.collect_list(F.struct("_span", "parts")))["parts"]), F.lit(0.0), lambda a, x: a + x)
    replicates = parts.groupBy(*keys, "_n", "rep").agg(
        (total / F.col("_n")).alias("mean"), ((F.max(nan_null("low")) + F.max(nan_null("high"))) / 2).alias("median")
    )
    return near.unionByName(_from_replicates(replicates, keys, ["mean", "median"], probs, out))


def _in_order(block: str, part: str) -> Column:
    """Sum of the parts in the order of their blocks."""
    listed = F.array_sort(F.collect_list(F.struct(block, part)))
    return F.aggregate(listed, F.lit(0.0), lambda a, x: a + x[part])


def _from_replicates(replicates: DataFrame, keys: Sequence[str], stats: Sequence[str], probs: Sequence[float], out: T.StructType) -> DataFrame:
    """The percentiles over the replicates, by the function that the direct path uses."""
    listed = replicates.groupBy(*keys).agg(*[F.array_sort(F.collect_list(s)).alias(s) for s in stats])
    names = [f.name for f in out.fields if f.name not in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_limits([np.asarray(x, float) for x in row], probs) for row in zip(*[pdf[s] for s in stats], strict=True)]
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return listed.mapInPandas(run, out)


# ---- G3 -------------------------------------------------------------------------


class _Units:
    """Value tables of units behind one another; a box is found by its number among a unit's ordered boxes."""

    def __init__(self, tables: Sequence[Sequence]):
        sizes = np.array([len(t) for t in tables])
        self.values = np.array([x["v"] for t in tables for x in t], float)
        self.upto = np.cumsum(np.array([x["f"] for t in tables for x in t], np.int64))
        ends = self.upto[np.cumsum(sizes) - 1]
        self.boxes = np.diff(ends, prepend=0)  # boxes of a unit
        self.before = ends - self.boxes

    def hits(self, reps: np.ndarray, units: int, low: int, boxes: int, stratum: int, seed: int) -> np.ndarray:
        """How often each value of the units low, low + 1, ... is drawn, per replicate.

        A replicate draws as many units as there are, and ``boxes`` boxes in each of them.
        """
        out = np.zeros((len(reps), len(self.values)), np.int64)
        step = max(1, DRAWS_AT_ONCE // (len(reps) * boxes))
        for start in range(0, units, step):
            slots = np.arange(start, min(units, start + step))
            unit = draws.portable_indices(reps, slots, stratum, seed, units) - low
            row, slot = np.nonzero((unit >= 0) & (unit < len(self.boxes)))
            mine = unit[row, slot]
            position = (slots[slot] * boxes)[:, None] + np.arange(boxes)
            state = draws.portable_states(reps[row][:, None], position, stratum, seed + 1)
            box = self.before[mine][:, None] + state * self.boxes[mine][:, None] // draws.MODULUS
            at = np.searchsorted(self.upto, box, side="right")
            out += np.bincount((at + (row * len(self.values))[:, None]).ravel(), minlength=out.size).reshape(out.shape)
        return out


def cluster_bootstrap(
    df: DataFrame, area: Sequence[str], unit: str, y: str, boxes: int, reps: int, seed: int,
    direct_units: int = 5_000, block_units: int = 5_000,
) -> DataFrame:
    """G3. Mean box count per area with 5, 50 and 95 percentiles from resampled units and boxes.

    A replicate draws as many units as the area has, and ``boxes`` boxes within every drawn unit.
    Rows are box counts; equal counts of a unit are merged, so a unit is a short table of values
    with cumulative counts however many boxes it has.  Units are numbered in the order of a hash of
    their name.  An area of more than ``direct_units`` units is cut into blocks of ``block_units``
    that replay its draws; both paths give the same limits to the last bit.
    """
    area = list(area)
    per_value = df.groupBy(*area, unit, y).agg(F.count(F.lit(1)).alias("_f"))
    per_unit = per_value.groupBy(*area, unit).agg(
        F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("v"), F.col("_f").alias("f")))).alias("table")
    ).withColumn("_mark", F.md5(F.col(unit).cast("string")))
    small, large = split_hot(per_unit, area, direct_units)
    stratum = draws.stratum_number(*[F.col(k) for k in area])
    af = _fields(df, area)
    stats = ["p05", "p50", "p95"]
    probs = [0.05, 0.5, 0.95]
    grouped = (
        _spread(small, area)
        .groupBy(*area)
        .agg(F.array_sort(F.collect_list(F.struct("_mark", F.col(unit).alias("u"), F.col("table").alias("t")))).alias("units"))
        .withColumn("stratum", stratum)
    )
    out = T.StructType([*af, T.StructField("units", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in stats]])

    def one_area(tables: list, number: int) -> list[float]:
        n = len(tables)
        total = np.zeros(reps)
        for start in range(0, n, block_units):
            block = _Units(tables[start : start + block_units])
            for rep in _rep_chunks(reps, max(len(block.values), n * boxes)):
                total[rep] += _hit_sums(block.hits(rep, n, start, boxes, number, seed), block.values)
        return [n, *_limits([total / (n * boxes)], probs)]

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one_area([u["t"] for u in units], int(number)) for units, number in zip(pdf["units"], pdf["stratum"], strict=True)]
            res = pd.DataFrame(rows, columns=["units", *stats])
            yield pd.concat([pdf[area].reset_index(drop=True), res], axis=1)

    near = grouped.mapInPandas(direct, out)
    if large is None:
        return near

    bucket = F.conv(F.substring("_mark", 1, 3), 16, 10).cast("int")
    numbered = number_rows(large, area, bucket, ["_mark", unit], "_no").withColumn("_block", F.expr(f"(_no - 1) div {block_units}"))
    blocks = numbered.groupBy(*area, "_n", "_block").agg(F.array_sort(F.collect_list(F.struct("_no", F.col("table").alias("t")))).alias("units"))
    tasks = _rep_rows(blocks.withColumn("_stratum", stratum), reps, F.col("_n") * boxes)
    part_schema = T.StructType([*af, *[T.StructField(c, T.LongType()) for c in ("_n", "rep", "_block")], T.StructField("part", T.DoubleType())])

    def one_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                n, number, block, rep0, n_reps = (int(row[c]) for c in ("_n", "_stratum", "_block", "rep0", "n_reps"))
                units = _Units([u["t"] for u in row["units"]])
                for rep in np.array_split(np.arange(rep0, rep0 + n_reps), -(-n_reps * len(units.values) // CHUNK_VALUES)):
                    part = _hit_sums(units.hits(rep, n, block * block_units, boxes, number, seed), units.values)
                    res = pd.DataFrame({"_n": n, "rep": rep, "_block": block, "part": part})
                    for k in area:
                        res[k] = [row[k]] * len(res)
                    yield res[[*area, "_n", "rep", "_block", "part"]]

    parts = _spread(tasks, [*area, "_block", "rep0"]).mapInPandas(one_block, part_schema)
    replicates = parts.groupBy(*area, F.col("_n").alias("units"), "rep").agg((_in_order("_block", "part") / (F.first("_n") * boxes)).alias("mean"))
    return near.unionByName(_from_replicates(replicates, [*area, "units"], ["mean"], probs, out))


# ---- G4, G5 ---------------------------------------------------------------------


def _stratum_rows(corners: DataFrame, trees: DataFrame, strata: Sequence[str], event: str, values: Sequence[str]) -> DataFrame:
    """Corner and tree rows of every stratum as one table with a fixed pseudo-random row order."""

    def rows(df: DataFrame, kind: str, position: str, cols: dict) -> DataFrame:
        return df.select(
            *strata,
            F.lit(kind).alias("kind"),
            "target",
            F.md5(F.concat_ws("|", F.col(event).cast("string"), F.col(position).cast("string"))).alias("mark"),
            F.col(event).alias("event"),
            *[c.cast("double").alias(name) for name, c in cols.items()],
        )

    corner = rows(corners, "s", "corner", {**{v: F.col(v) for v in values}, "trees": F.lit(0)})
    tree = rows(trees, "t", "module", {**{v: F.lit(0) for v in values}, "trees": F.col("trees")})
    return corner.unionByName(tree)


def _sub_stratum(strata: Sequence[str]):
    """Stratum number of the (strata, target, kind) sample a row belongs to."""
    side = F.when(F.col("target"), "T").otherwise("F")
    return draws.stratum_number(*[F.col(c) for c in strata], side, F.col("kind"))


def _index_join(rows: DataFrame, strata: Sequence[str], reps: int, seed: int, k: dict[str, int]) -> DataFrame:
    """Drawn rows of large strata: numbered rows joined with the draw indices, one row per draw.

    Only strata above the direct limit come here, so the draws are fewer than the rows.
    """
    keys = [*strata, "target", "kind"]
    bucket = F.conv(F.substring("mark", 1, 3), 16, 10).cast("int")
    numbered = number_rows(rows, keys, bucket, ["mark", "event"], "_no")
    wanted = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_sub", _sub_stratum(strata))
        .withColumn("_k", F.when(F.col("kind") == "s", k["s"]).otherwise(k["t"]))
        .withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long") - 1)))
        .withColumn("_no", 1 + draws.portable_index(F.col("rep"), F.col("_i"), F.col("_sub"), seed, F.col("_size")))
        .select(*keys, "rep", "_no")
    )
    return numbered.join(wanted, [*keys, "_no"])


class _Stratum:
    """Rows of one stratum as arrays, ordered by (kind, target, mark, event); samples all replicates at once."""

    def __init__(self, kind, target, event, values: dict[str, np.ndarray], numbers: dict, reps: int, seed: int, k: dict[str, int]):
        self.kind, self.target, self.values = kind, target, values
        self.events, self.event = np.unique(event, return_inverse=True)
        self.numbers, self.reps, self.seed, self.k = numbers, reps, seed, k

    def sums(self, kind: str, target: bool, values: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(times drawn, sums per value), each of shape (reps, events)."""
        mine = np.flatnonzero((self.kind == kind) & (self.target == target))
        shape = (self.reps, len(self.events))
        if not len(mine):
            return np.zeros(shape), {v: np.zeros(shape) for v in values}
        rep = np.arange(self.reps)
        drawn = mine[draws.portable_indices(rep, np.arange(self.k[kind]), self.numbers[kind, target], self.seed, len(mine))]
        cell = (rep[:, None] * len(self.events) + self.event[drawn]).ravel()
        count = lambda w=None: np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape)
        return count(), {v: count(self.values[v][drawn].ravel()) for v in values}


def _quantiles(values: np.ndarray, probs: Sequence[float]) -> list[float]:
    """``np.quantile`` to the last bit, without its cost per call, which exceeds that of a thousand values."""
    v = np.sort(values)
    if np.isnan(v[-1]):
        return [np.nan] * len(probs)
    out = []
    for p in probs:
        at = (len(v) - 1) * p
        below = int(at)
        low, high, part = v[below], v[min(below + 1, len(v) - 1)], at - below
        out.append(low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part))
    return out


def _event_stats(value: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows (event number, mean, 2.5 and 97.5 percentiles) over the replicates that drew the event."""
    found = [(j, value[m, j]) for j, m in enumerate(seen.T) if m.any()]
    return np.array([(j, v.mean(), *_quantiles(v, [0.025, 0.975])) for j, v in found]).reshape(-1, 4)


SIDES = [(kind, target) for kind in "st" for target in (True, False)]


def _interval(corners, trees, strata, event, values, reps, seed, k, direct_rows, kernel, formula) -> DataFrame:
    """Shared body of G4 and G5: split strata by size, sample, summarise per event.

    Rows are needed twice or more, to count and to sample the strata, so the joins behind them run once.
    """
    strata = list(strata)
    corners = written(corners.select(*strata, event, "target", "corner", *values), "corners")
    trees = written(trees.select(*strata, event, "target", "module", "trees"), "trees")
    rows = _stratum_rows(corners, trees, strata, event, values)
    small, large = split_hot(rows, strata, direct_rows)
    number = lambda kind, target: draws.stratum_number(
        *[F.col(c) for c in strata], F.lit("T" if target else "F"), F.lit(kind)
    )
    cols = ["kind", "target", "mark", "event", *values, "trees"]
    grouped = (
        _spread(small, strata)
        .groupBy(*strata)
        .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
        .select(*strata, "rows", *[number(x, t).alias(f"num_{x}{int(t)}") for x, t in SIDES])
    )
    out = T.StructType(
        [*_fields(rows, [*strata, "event"]), *[T.StructField(c, T.DoubleType()) for c in ("mean", "lo95", "hi95")]]
    )

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            kind, target = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "target"))
            names = flat.field("event").dictionary_encode()
            codes = names.indices.to_numpy()
            numbers = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in [*values, "trees"]}
            seeds = {(x, t): batch.column(f"num_{x}{int(t)}").to_pylist() for x, t in SIDES}
            owners, events, stats = [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                one = _Stratum(kind[a:b], target[a:b], codes[a:b], {c: v[a:b] for c, v in numbers.items()}, {x: s[i] for x, s in seeds.items()}, reps, seed, k)
                found = _event_stats(*kernel(one))
                owners.append(np.full(len(found), i))
                events.append(one.events[found[:, 0].astype(int)])
                stats.append(found[:, 1:])
            owner = pa.array(np.concatenate(owners or [np.zeros(0, int)]))
            event_ = names.dictionary.take(pa.array(np.concatenate(events or [np.zeros(0, int)]).astype(np.int64)))
            table = np.concatenate(stats or [np.zeros((0, 3))])
            columns = [*[batch.column(c).take(owner) for c in strata], event_, *[pa.array(np.ascontiguousarray(table[:, j])) for j in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, [*strata, "event", "mean", "lo95", "hi95"])

    near = grouped.mapInArrow(direct, out)
    if large is None:
        return near
    drawn = _index_join(large, strata, reps, seed, k)
    limits = F.percentile("_value", F.array(F.lit(0.025), F.lit(0.975)))
    far = (
        formula(drawn, ["rep", *strata, "event"])
        .groupBy(*strata, "event")
        .agg(F.avg("_value").alias("mean"), limits.alias("_q"))
        .select(*strata, "event", "mean", F.col("_q")[0].alias("lo95"), F.col("_q")[1].alias("hi95"))
    )
    return near.unionByName(far)


def regen_index_interval(
    corners: DataFrame, trees: DataFrame, strata: Sequence[str], event: str, reps: int, seed: int,
    corner_draws: int = 8, tree_draws: int = 4, direct_rows: int = 8_000,
) -> DataFrame:
    """G4. Mean and 2.5 / 97.5 percentiles of the sustainability index per event.

    Strata are (unit, cycle), so several events of one cycle are resampled together.  Per
    replicate, 8 corner rows and 4 module rows are drawn for each target side; a side that was
    not drawn leaves the ratio at 0.  ``corners`` carries seedlings, small_saplings,
    large_saplings; ``trees`` carries trees.
    """
    values = list(regen.INDEX_CLASSES)

    def kernel(s: _Stratum):
        seed_side, sap_side, drawn = {}, {}, {}
        for target in (True, False):
            times, got = s.sums("s", target, values)
            _, tree = s.sums("t", target, ["trees"])
            drawn[target] = times > 0
            seed_side[target] = regen.SEED_FACTOR * got["seedlings"] + regen.SAPLING_FACTOR * got["small_saplings"]
            sap_side[target] = regen.SAPLING_FACTOR * got["large_saplings"] + tree["trees"]
        both = drawn[True] & drawn[False]

        def share(side):
            whole = side[True] + side[False]
            return np.divide(side[True], whole, out=np.zeros_like(whole), where=both & (whole > 0))

        return share(seed_side) + share(sap_side), drawn[True] | drawn[False]

    def formula(drawn: DataFrame, keys: list[str]) -> DataFrame:
        aggs = []
        for side, on in (("t", F.col("target")), ("o", ~F.col("target"))):
            s = on & (F.col("kind") == "s")
            aggs += [F.sum(F.when(s, F.col(v))).alias(f"{side}_{v}") for v in values]
            aggs.append(F.coalesce(F.sum(F.when(on, F.col("trees"))), F.lit(0.0)).alias(f"{side}_trees"))
        sums = drawn.groupBy(*keys).agg(*aggs)
        seed_t, sap_t = regen.index_columns("t", "t_trees")
        seed_o, sap_o = regen.index_columns("o", "o_trees")
        seen = F.col("t_seedlings").isNotNull() | F.col("o_seedlings").isNotNull()
        return sums.where(seen).withColumn("_value", regen.ratio(seed_t, seed_o) + regen.ratio(sap_t, sap_o))

    k = {"s": corner_draws, "t": tree_draws}
    return _interval(corners, trees, strata, event, values, reps, seed, k, direct_rows, kernel, formula)


def importance_interval(
    corners: DataFrame, trees: DataFrame, strata: Sequence[str], event: str, reps: int, seed: int,
    corner_draws: int = 8, tree_draws: int = 4, direct_rows: int = 8_000,
) -> DataFrame:
    """G5. Mean and 2.5 / 97.5 percentiles of the importance score per event, target species only.

    ``corners`` carries p1, p2, p10, p50; both inputs hold target rows only.
    """
    values = list(regen.IMPORTANCE_CLASSES)

    def kernel(s: _Stratum):
        times, got = s.sums("s", True, values)
        _, tree = s.sums("t", True, ["trees"])
        w = regen.IMPORTANCE_POINTS
        points = (got["p1"] * w["p1"] + got["p2"] * w["p2"] + got["p10"] * w["p10"]) * (regen.HECTARE_M2 / regen.SEED_M2)
        points = points + got["p50"] * w["p50"] * (regen.HECTARE_M2 / regen.SAPLING_M2)
        points = points + tree["trees"] * w["p50"] * (regen.HECTARE_M2 / regen.PLOT_M2)
        return np.log1p(points), times > 0

    def formula(drawn: DataFrame, keys: list[str]) -> DataFrame:
        s = F.col("kind") == "s"
        aggs = [F.sum(F.when(s, F.col(v))).alias(v) for v in values]
        sums = drawn.groupBy(*keys).agg(*aggs, F.sum("trees").alias("_trees")).where(F.col("p1").isNotNull())
        return sums.withColumn("_value", regen.importance_value(*[F.col(v) for v in values], F.col("_trees")))

    k = {"s": corner_draws, "t": tree_draws}
    return _interval(corners.where("target"), trees.where("target"), strata, event, values, reps, seed, k, direct_rows, kernel, formula)
