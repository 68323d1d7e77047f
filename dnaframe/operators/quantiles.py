"""Exact order statistics and quantiles at any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here the
k-th smallest value is found by narrowing. One pass keeps a mergeable KLL sketch of every group
(``quantile_sketches``); the sketches alone, without the rows, bracket all wanted ranks at once. A
counting pass checks the brackets and counts the rows below them; brackets of at most
``max_candidates`` values are brought to the driver, larger ones (about 0.3 % of a group)
are narrowed again by ``percentile_approx`` inside them. Each pass is a map-side combined aggregate,
so the work spreads over all executors and the driver holds a bounded number of values. Dates,
timestamps and decimals have no sketch and are narrowed from the start.

The sketches are a table of one row per group, about 100 KB each: stored, they can be combined into
coarser groups (``merge_sketches``) or with those of later rows, and read at any rank
(``sketched_quantiles``) without the rows they came from. NaN is counted beside them and ranks last.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CANDIDATES = 200_000
ACCURACY = 10_000
SKETCH_K = 4096
#: Rank error that a sketch of ``SKETCH_K`` keeps within at 99 %: 2.296 / k ** 0.9723, both sides.
SKETCH_ERROR = 2.296 / SKETCH_K ** 0.9723
_WHOLE, _FLOATING = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def _sketch_kind(df: DataFrame, value_col: str) -> str | None:
    kind = df.schema[value_col].dataType.simpleString()
    return "bigint" if kind in _WHOLE else "double" if kind in _FLOATING else None


def quantile_sketches(df: DataFrame, value_col: str, keys: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """keys, n (values that are not null), numbers (those that are not NaN), sketch (KLL of the numbers; null without one)."""
    kind = _sketch_kind(df, value_col)
    v = F.col(value_col)
    number = v if kind != "double" else F.when(~F.isnan(v), v)
    numbers = F.count(number)
    agg = {"bigint": F.kll_sketch_agg_bigint, "double": F.kll_sketch_agg_double}
    sketch = F.when(numbers > 0, agg[kind](number.cast(kind), k)) if kind else F.lit(None).cast("binary")
    return df.groupBy(*(keys or [])).agg(F.count(v).alias("n"), numbers.alias("numbers"), sketch.alias("sketch"))


def merge_sketches(sketches: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """The sketches of ``quantile_sketches`` combined into coarser groups; ``kind``: ``bigint`` (whole numbers) or ``double``."""
    merge = {"bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double}[kind]
    numbers = F.sum("numbers")
    return sketches.groupBy(*(keys or [])).agg(F.sum("n").alias("n"), numbers.alias("numbers"),
                                               F.when(numbers > 0, merge("sketch")).alias("sketch"))


def sketched_quantiles(kind: str, at: list[float]) -> Column:
    """Approximate values at the ranks ``at`` (0 to 1) of a row of ``quantile_sketches``; null without a number."""
    get = {"bigint": F.kll_sketch_get_quantile_bigint, "double": F.kll_sketch_get_quantile_double}[kind]
    return F.when(F.col("numbers") > 0, get("sketch", F.array(*[F.lit(float(p)) for p in at])))


def _order(v) -> tuple:
    """Spark's order of values: NaN above all numbers (Python's comparisons with it are all false)."""
    return (True, 0) if isinstance(v, float) and math.isnan(v) else (False, v)


def _or_any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _in_group(group_col: str | None, g) -> Column:
    return F.lit(True) if group_col is None else F.col(group_col).eqNullSafe(F.lit(g))


def _key(g):
    """A group's name as a dictionary key: NaN equals itself."""
    return ("nan",) if isinstance(g, float) and math.isnan(g) else g


def _brackets(sketches: DataFrame, kind: str, tasks: list[dict], group_col: str | None, error: float) -> None:
    """Sets ``first`` of every task: values between which its rank lies, if the sketch keeps its error; None = open."""
    by_group: dict = {}
    for t in tasks:
        by_group.setdefault(_key(t["g"]), (t["g"], []))[1].append(t)
    ranks = {at: [min(max(t["k"] / t["n"] + side * 2 * error, 0.0), 1.0) for t in ts for side in (-1, 1)] for at, (_, ts) in by_group.items()}
    values = F.coalesce(*[F.when(_in_group(group_col, g), sketched_quantiles(kind, ranks[at])) for at, (g, _) in by_group.items()])
    rows = sketches.select(*([group_col] if group_col else []), values.alias("quantiles")).filter("quantiles is not null").collect()
    for row in rows:
        at = _key(row[group_col] if group_col else None)
        ends = [q if 0.0 < p < 1.0 else None for p, q in zip(ranks[at], row["quantiles"])]
        for i, t in enumerate(by_group[at][1]):
            t["first"] = (ends[2 * i], ends[2 * i + 1])


def order_statistics(df: DataFrame, value_col: str, ranks: dict, group_col: str | None = None,
                     accuracy: int = ACCURACY, max_candidates: int = MAX_CANDIDATES, sketches: DataFrame | None = None) -> dict:
    """``{(group, k): k-th smallest non-null value}`` for 1-based ranks ``ranks[group]``; NaN ranks above all numbers, as in Spark.

    ``sketches`` are those of ``quantile_sketches`` by the group, if they are at hand.
    """
    v = F.col(value_col)
    kind = _sketch_kind(df, value_col)
    own = sketches is None
    if own:
        sketches = quantile_sketches(df, value_col, [group_col] if group_col else None).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numbers = {_key(r[group_col] if group_col else None): r["numbers"] for r in sketches.drop("sketch").collect()}
        # NaN takes the ranks behind all numbers; everything below sees numbers only
        result = {(g, int(k)): math.nan for g, ks in ranks.items() for k in ks if kind == "double" and k > numbers.get(_key(g), 0)}
        if kind == "double":
            df = df.filter(~F.isnan(v))
        # dict per (g, k): lo, hi (bracket, ends excluded; None = open), below = rows <= lo, n = rows inside, first = the sketch's bracket
        tasks = [{"g": g, "k": int(k), "lo": None, "hi": None, "below": 0, "n": numbers.get(_key(g), 0), "first": None}
                 for g, ks in ranks.items() for k in ks if (g, int(k)) not in result]
        large = [t for t in tasks if t["n"] > max_candidates]
        if kind and large:
            _brackets(sketches, kind, large, group_col, SKETCH_ERROR)
    finally:
        if own:
            sketches.unpersist()
    while tasks:
        def member(t):
            c = _in_group(group_col, t["g"]) & v.isNotNull()
            if t["lo"] is not None:
                c = c & (v > F.lit(t["lo"]))
            if t["hi"] is not None:
                c = c & (v < F.lit(t["hi"]))
            return c

        small = [t for t in tasks if t["n"] <= max_candidates]
        large = [(t, t["n"]) for t in tasks if t["n"] > max_candidates]
        if small:  # one job brings the (bounded) candidates of every small bracket
            gcol = F.col(group_col) if group_col else F.lit(None)
            rows = df.filter(_or_any([member(t) for t in small])).select(gcol.alias("g"), v.alias("v")).collect()
            for t in small:
                vals = sorted(r["v"] for r in rows if (group_col is None or r["g"] == t["g"])
                              and (t["lo"] is None or r["v"] > t["lo"]) and (t["hi"] is None or r["v"] < t["hi"]))
                result[(t["g"], t["k"])] = vals[t["k"] - t["below"] - 1]
        if not large:
            break
        # bracket the local rank: by the sketch at first, then with approximate quantiles inside the current bracket
        exprs, ends = [], {}
        for i, (t, n) in enumerate(large):
            if t["first"]:
                ends[i] = t["first"]
                continue
            local = t["k"] - t["below"]
            slack = 2.0 * n / accuracy + 1
            p_lo = min(max((local - slack) / n, 0.0), 1.0)
            p_hi = min(max((local + slack) / n, 0.0), 1.0)
            exprs.append(F.percentile_approx(F.when(member(t), v), [p_lo, p_hi], accuracy).alias(f"q{i}"))
        if exprs:
            ends |= {int(name[1:]): tuple(q) for name, q in df.agg(*exprs).first().asDict().items()}
        counts = []
        for i, (t, _) in enumerate(large):
            for at, value in zip(("be", "fu"), ends[i]):
                if value is not None:
                    counts += [F.count_if(member(t) & (v < F.lit(value))).alias(f"{at[0]}{i}"),
                               F.count_if(member(t) & (v <= F.lit(value))).alias(f"{at[1]}{i}")]
        found = df.agg(*counts).first().asDict() if counts else {}
        nxt = []
        for i, (t, n) in enumerate(large):
            (lo, hi), k = ends[i], t["k"] - t["below"]
            # rows below and up to each end; an open end has none below it, or all
            b, e, f, u = (found.get(f"{at}{i}", n if at in "fu" else 0) for at in "befu")
            if b < k <= e:
                result[(t["g"], t["k"])] = lo
            elif f < k <= u:
                result[(t["g"], t["k"])] = hi
            elif e < k <= f:  # strictly between: the bracket loses both ends, so it always shrinks
                nxt.append({**t, "lo": t["lo"] if lo is None else lo, "hi": t["hi"] if hi is None else hi, "below": t["below"] + e,
                            "n": f - e, "first": None})
            else:
                # the sketch missed (rare): keep the bracket, ask for a finer one
                accuracy = accuracy if t["first"] else min(accuracy * 4, 2**31 - 1)
                nxt.append({**t, "first": None})
        tasks = nxt
    return result


def quantile_ranks(n: int, q: float) -> tuple[int, int, float]:
    """Linear interpolation positions (pandas / numpy default): ranks and fraction."""
    pos = (n - 1) * q
    lo = math.floor(pos)
    return lo + 1, min(lo + 2, n), pos - lo


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_col: str | None = None,
                    persist: bool = True, **kw) -> dict:
    """``{(group, q): value}`` with linear interpolation; q = 0.5 uses the mean of the two
    middle values like ``median``.

    The (group, value) projection is persisted (memory, spilling to disk) across the few passes,
    since its input is usually a model's predictions; ``persist=False`` recomputes instead.
    """
    cols = [value_col] + ([group_col] if group_col else [])
    df = df.select(*cols)
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _exact_quantiles(df, value_col, probs, group_col, **kw)
    finally:
        if persist:
            df.unpersist()


def _exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_col: str | None = None,
                     **kw) -> dict:
    sketches = quantile_sketches(df, value_col, [group_col] if group_col else None).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {(r[group_col] if group_col else None): r["n"] for r in sketches.drop("sketch").collect()}
        return _interpolated(df, value_col, probs, group_col, counts, sketches=sketches, **kw)
    finally:
        sketches.unpersist()


def _interpolated(df: DataFrame, value_col: str, probs: list[float], group_col: str | None, counts: dict, **kw) -> dict:
    ranks = {}
    for g, n in counts.items():
        if n:
            ranks[g] = sorted({r for q in probs for r in quantile_ranks(n, q)[:2]})
    stats = order_statistics(df, value_col, ranks, group_col, **kw)
    out = {}
    for g, n in counts.items():
        for q in probs:
            if not n:
                out[(g, q)] = None
                continue
            r1, r2, frac = quantile_ranks(n, q)
            a, b = stats[(g, r1)], stats[(g, r2)]
            if _order(a) == _order(b):  # infinities included
                out[(g, q)] = a
            elif math.isinf(a) or math.isinf(b):
                out[(g, q)] = a * (1 - frac) + b * frac if frac else a
            elif q == 0.5 and n % 2 == 0:
                out[(g, q)] = (a + b) / 2.0
            else:
                out[(g, q)] = a + (b - a) * frac if frac else a
    return out
