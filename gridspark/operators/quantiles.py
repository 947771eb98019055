"""Exact linear-interpolated quantiles in two scans, without gathering the values in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which does not
scale for continuous values. Here one scan makes a mergeable rank sketch per group, whose error bounds give a
narrow window of values around every wanted rank. The second scan counts exactly: one number for the values
between two windows, one per distinct value inside a window. Windows that would still hold more than
``MOST_VALUES`` are narrowed by sketches of their own first, and a rank that a sketch missed is sought again
where the exact counts put it, so the result never depends on a sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SKETCH_SIZE = 4096
ERROR = 0.0026  # of a rank in a sketch of that size, twice its 99 % bound
MOST_VALUES = 4_000_000
NARROWINGS = 8
_INF = math.inf


def _slot(value: Column, edges: list[tuple[Column, Column]]) -> Column:
    """2i + 1 inside the i-th window, 2i before it."""
    out = F.lit(0)
    for low, high in edges:
        out = out + (value >= low).cast("int") + (value > high).cast("int")
    return out


def _with_slots(base: DataFrame, keys: list[str], windows: dict) -> DataFrame:
    """``base`` with the slot of every value; ``windows``: disjoint ascending ones per group."""
    most = max(map(len, windows.values()))
    if not keys:
        return base.withColumn("_slot", _slot(F.col("_v"), [(F.lit(a), F.lit(b)) for a, b in windows[()]]))
    schema = base.select(*keys).schema
    for i in range(most):
        schema = schema.add(f"_low{i}", "double").add(f"_high{i}", "double")
    rows = []
    for group, some in windows.items():
        edges = [e for w in some for e in w] + [None] * 2 * (most - len(some))
        rows.append((*group, *edges))
    table = base.sparkSession.createDataFrame(rows, schema)  # a row per group
    same = [base[k].eqNullSafe(table[k]) for k in keys]
    found = base.join(F.broadcast(table), same).drop(*[table[k] for k in keys])
    edges = [(F.coalesce(f"_low{i}", F.lit(_INF)), F.coalesce(f"_high{i}", F.lit(_INF))) for i in range(most)]
    # a missing window: nothing reaches it but infinity, which then counts as beyond the last one
    slot = F.least(_slot(F.col("_v"), edges), F.lit(2) * sum(F.col(f"_low{i}").isNotNull().cast("int") for i in range(most)))
    return found.select(*base.columns, slot.alias("_slot"))


def _merged(windows: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _ranks(n: int, probs: list[float]) -> list[int]:
    return sorted({end(p * (n - 1)) for p in probs for end in (math.floor, math.ceil)})


def _sketched(rows: DataFrame, by: list[str]) -> list:
    """Per group of rows: how many there are and a fine grid of its sketch's quantiles."""
    grid = F.array(*[F.lit(i / 1024) for i in range(1025)])
    sketch = F.kll_sketch_agg_double("_v", F.lit(SKETCH_SIZE)).alias("_sketch")
    found = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch)
    quantiles = F.kll_sketch_get_quantile_double("_sketch", grid)
    return found.where("_n > 0").select(*by, "_n", "_min", "_max", quantiles.alias("_grid")).collect()


def _window(rank: int, n: int, row) -> tuple[float, float]:
    """Values between which the sketch sees ``rank`` of ``n`` values."""
    low, high = (rank / n - ERROR) * 1024, ((rank + 1) / n + ERROR) * 1024
    return (
        row["_min"] if low <= 0 else row["_grid"][math.floor(low)],
        row["_max"] if high >= 1024 else row["_grid"][math.ceil(high)],
    )


def _narrow(base: DataFrame, keys: list[str], windows: dict, ranks: dict) -> tuple[dict, dict]:
    """Windows around the wanted ranks inside ``windows``, and how many values they may hold."""
    slots: dict = {}
    for r in _sketched(_with_slots(base, keys, windows), [*keys, "_slot"]):
        slots.setdefault(tuple(r[k] for k in keys), []).append(r)
    out, sizes = {}, {}
    for group, rows in slots.items():
        before, some, size = 0, [], 0.0
        for r in sorted(rows, key=lambda r: r["_slot"]):
            mine = [k - before for k in ranks[group] if before <= k < before + r["_n"]]
            new = [_window(k, r["_n"], r) for k in mine]
            some += new
            size += sum(min(1.0, 2 * ERROR + 3 / 1024) * r["_n"] for low, high in new if low < high)
            before += r["_n"]
        out[group], sizes[group] = _merged(some), size
    return out, sizes


def group_quantiles(df: DataFrame, value: Column, probs: list[float], by: list[str] = ()) -> dict[tuple, list[float]]:
    """Quantiles per group as numbers, an action; the groups must be few, as their rows come to the driver.

    Nulls are skipped, NaN counts as infinite; a group without values is not in the result.
    """
    keys, v = list(by), value.cast("double")
    base = df.select(*keys, F.nanvl(v, F.lit(_INF)).alias("_v")).where(F.col("_v").isNotNull())
    totals, windows, sizes = {}, {}, {}
    for r in _sketched(base, keys):
        group = tuple(r[k] for k in keys)
        totals[group] = r["_n"]
        some = [_window(k, r["_n"], r) for k in _ranks(r["_n"], probs)]
        windows[group] = _merged(some)
        sizes[group] = sum((2 * ERROR + 3 / 1024) * r["_n"] for low, high in some if low < high)
    ranks = {g: _ranks(n, probs) for g, n in totals.items()}
    found: dict = {g: {} for g in totals}
    tries = 0
    while windows:
        if tries < NARROWINGS and max(sizes.values()) > MOST_VALUES:
            windows, sizes = _narrow(base, keys, windows, ranks)
            tries += 1
            continue
        slotted = _with_slots(base, keys, windows)
        inside = F.when(F.col("_slot") % 2 == 1, F.col("_v"))
        counts = slotted.groupBy(*keys, "_slot", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        so_far = Window.partitionBy(*keys, F.lit(0)).orderBy("_slot", "_v")  # MOST_VALUES rows a group at most
        placed = counts.withColumn("_end", F.sum("_n").over(so_far))
        wanted = [k for g in windows for k in ranks[g]]
        if keys:
            named = base.sparkSession.createDataFrame(
                [(*g, ranks[g]) for g in windows], placed.select(*keys).schema.add("_ranks", T.ArrayType(T.LongType()))
            )
            same = [placed[k].eqNullSafe(named[k]) for k in keys]
            placed = placed.join(F.broadcast(named), same).drop(*[named[k] for k in keys])
        else:
            placed = placed.withColumn("_ranks", F.array(*[F.lit(k).cast("bigint") for k in wanted]))
        mine = F.filter("_ranks", lambda k: (k < F.col("_end")) & (k >= F.col("_end") - F.col("_n")))
        rows = placed.select(*keys, "_slot", "_v", F.explode(mine).alias("_rank")).collect()
        missed: dict = {}
        for r in rows:
            group = tuple(r[k] for k in keys)
            if r["_slot"] % 2:
                found[group][r["_rank"]] = r["_v"]
            else:  # between two windows: the sketch was off
                i, edges = r["_slot"] // 2, windows[group]
                gap = (edges[i - 1][1] if i else -_INF, edges[i][0] if i < len(edges) else _INF)
                missed.setdefault(group, []).append(gap)
        windows = {g: _merged(w) for g, w in missed.items()}
        sizes = {g: float(totals[g]) for g in windows}
        base = base if not keys or not windows else base.where(_one_of(keys, windows))
    return {g: [_between(found[g], p * (totals[g] - 1)) for p in probs] for g in totals}


def _one_of(keys: list[str], groups) -> Column:
    out = F.lit(False)
    for g in groups:
        same = F.lit(True)
        for k, v in zip(keys, g):
            same = same & F.col(k).eqNullSafe(F.lit(v))
        out = out | same
    return out


def _between(values: dict[int, float], at: float) -> float:
    low, high = values[math.floor(at)], values[math.ceil(at)]
    # equal ends first: infinite values must not meet in a difference
    return low if low == high else low + (high - low) * (at - math.floor(at))


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], by: list[str] = ()) -> DataFrame:
    """One row per group with ``q``, an array of quantiles in the order of ``probs`` (see :func:`group_quantiles`)."""
    found = group_quantiles(df, value, probs, by)
    schema = df.select(*by).schema.add("q", T.ArrayType(T.DoubleType()))
    return df.sparkSession.createDataFrame([(*g, q) for g, q in found.items()], schema)


def quantile_values(df: DataFrame, value: Column, probs: list[float]) -> list[float] | None:
    """The quantiles as numbers (like ``approxQuantile``, an action), or None without values.

    A filter on such a number can be pushed to the scan, and stacked filters keep simple plans.
    """
    return group_quantiles(df, value, probs).get(())


def quantile_scalar(df: DataFrame, value: Column, probs: list[float]) -> Column:
    """The quantiles of a whole frame as a literal array, null without values."""
    found = quantile_values(df, value, probs)
    return F.lit(None).cast("array<double>") if found is None else F.array(*[F.lit(q) for q in found])
