"""Time series (U8-U11): column choice, period/horizon rules, history tail and
Holt-Winters forecasts for many series and for long ones.

For fixed (alpha, beta, gamma) a step of additive Holt-Winters is an affine map
of the state (level, trend, seasons), so a stretch of points acts as one: its
linear part is a power of the step's matrix, its offset the state it ends in when it starts from zero.
Points are dealt by ranges of (series, time) into segments; a series that lies inside one task
is run there, lanes of many series and all parameters of the grid at a time.  A longer one is run
in three passes: all segments from zero, a pass over these offsets (one row per
segment) for the state that each segment starts in, and all segments again from those states, for the errors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablelens.operators.ranks import null_safe
from tablelens.session import cut_lineage
from tablelens.functions.scalars import finite_table, is_datetime_type, is_numeric_type, to_number


def _q(c: str):
    return F.col(f"`{c}`")


def pick_columns(df: DataFrame, target: str | None = None) -> tuple[str, str | None]:
    """U8: ``(value_col, date_col)``: the target when >80 % numeric, else the
    last >80 %-numeric column; the date is the first other column >80 %
    parsable as a date/time.  Numeric columns are never taken as dates."""
    from tablelens.operators.clean import parse_datetime_text

    cols = df.columns
    num = {c: (_q(c).cast("double") if is_numeric_type(df.schema[c].dataType) else to_number(_q(c))) for c in cols}
    dt = {c: (_q(c) if is_datetime_type(df.schema[c].dataType) else
              (F.lit(None) if is_numeric_type(df.schema[c].dataType) else parse_datetime_text(_q(c).cast("string"))))
          for c in cols}
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(num[c]).alias(f"v{i}") for i, c in enumerate(cols)],
               *[F.count(dt[c]).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    n = r["_n"] or 1
    isnum = {c: r[f"v{i}"] / n > 0.8 for i, c in enumerate(cols)}
    value = target if target in cols and isnum[target] else None
    if value is None:
        nums = [c for c in cols if isnum[c]]
        if not nums:
            raise ValueError("no column holds numbers to forecast")
        value = nums[-1]
    date = next((c for i, c in enumerate(cols) if c != value and not is_numeric_type(df.schema[c].dataType)
                 and r[f"d{i}"] / n > 0.8), None)
    return value, date


def infer_period(n: F.Column) -> F.Column:
    """Season length from the number of points: >=60 -> 12, >=28 -> 7, else 1."""
    return F.when(n >= 60, 12).when(n >= 28, 7).otherwise(1)


def series_plan(series: DataFrame, keys: list[str]) -> DataFrame:
    """U9 per series: ``n, period, seasonal, horizon`` (horizon = max(6, min(24, n // 6)))."""
    g = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per = infer_period(F.col("n"))
    return g.select(*keys, "n", per.alias("period"), ((per > 1) & (F.col("n") > 2 * per)).alias("seasonal"),
                    F.greatest(F.lit(6), F.least(F.lit(24), F.floor(F.col("n") / 6))).cast("int").alias("horizon"))


def history_tail(series: DataFrame, keys: list[str], t_col: str, y_col: str, n: int = 60) -> DataFrame:
    """The last ``n`` points of each series with their position ``idx``
    (0 = oldest kept point)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(t_col))
    tail = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*keys)
    return tail.select(*keys, t_col, F.col(y_col).alias("value"),
                       (F.count(F.lit(1)).over(w2) - F.col("_r")).cast("int").alias("idx"))


# ------------------------------------------------------------ Holt-Winters

_GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
#: Points of a segment, lanes run together, points that are shown, and points that can set the first state.
SEGMENT, LANES, SHOWN, HEAD = 8192, 256, 60, 24
#: Sums over the points of a segment, by parameters.
SQUARES, ERRORS, SHARES = range(3)


@functools.lru_cache(None)
def _grid(m: int) -> np.ndarray:
    """(3, parameter sets): alpha, beta, gamma."""
    return np.array(list(itertools.product(_GRID, _GRID, _GRID if m > 1 else [0.0]))).T


@functools.lru_cache(None)
def _step_matrix(m: int) -> np.ndarray:
    """(parameter sets, d, d): the linear part of a step on (level, trend, seasons from the next one on)."""
    a, b, g = _grid(m)
    d = 2 + (m if m > 1 else 0)
    out = np.zeros((len(a), d, d))
    out[:, 0, 0] = out[:, 0, 1] = 1 - a
    out[:, 1, 0], out[:, 1, 1] = -a * b, b * (1 - a) + 1 - b
    if m > 1:
        out[:, 0, 2], out[:, 1, 2] = -a, -a * b
        out[:, range(2, d - 1), range(3, d)] = 1  # the others move up; the one just used, renewed, comes last
        out[:, d - 1, 0] = out[:, d - 1, 1] = -g * (1 - a)
        out[:, d - 1, 2] = g * a + 1 - g
    return out


def first_state(head: np.ndarray, m: int) -> np.ndarray:
    """State before the first point, from the first two seasons (two points without a season)."""
    if m > 1:
        level = head[:m].mean()
        return np.r_[level, (head[m:2 * m].mean() - level) / m, head[:m] - level]
    return np.array([head[0], head[1] - head[0]])


def run_lanes(points: list[np.ndarray], states: np.ndarray, m: int, errors: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Run lanes of points from their states, (lanes, parameter sets, d): the states they end in, and the sums of
    squared, absolute and relative errors, (lanes, 3, parameter sets)."""
    a, b, g = _grid(m)
    order = sorted(range(len(points)), key=lambda i: -len(points[i]))
    lengths = np.array([len(points[i]) for i in order])
    y = np.zeros((lengths[0], len(order)))
    for lane, i in enumerate(order):
        y[:lengths[lane], lane] = points[i]
    state = states[order]
    level, trend, season = state[:, :, 0].copy(), state[:, :, 1].copy(), np.moveaxis(state[:, :, 2:], 2, 0).copy()
    sums = np.zeros((3, len(order), len(a)))
    size = np.abs(y)
    weight = np.divide(1.0, size, out=np.zeros_like(size), where=size >= 1e-9)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes that have a point at each time
    with np.errstate(over="ignore", invalid="ignore"):
        for t, k in enumerate(live):
            l, tr, now = level[:k], trend[:k], y[t, :k, None]
            ahead = l + tr
            if m > 1:
                s = season[t % m, :k]
                new = a * (now - s) + (1 - a) * ahead
                error = now - ahead - s
                season[t % m, :k] = g * (now - new) + (1 - g) * s
            else:
                new = a * now + (1 - a) * ahead
                error = now - ahead
            trend[:k] = b * (new - l) + (1 - b) * tr
            level[:k] = new
            if errors:
                sums[SQUARES, :k] += error * error
                np.abs(error, out=error)
                sums[ERRORS, :k] += error
                sums[SHARES, :k] += error * weight[t, :k, None]
    out = np.empty_like(state)
    out[order, :, 0], out[order, :, 1] = level, trend
    for lane, i in enumerate(order):
        if m > 1:
            out[i, :, 2:] = np.roll(season[:, lane], -(lengths[lane] % m), axis=0).T
    totals = np.empty((len(order), 3, len(a)))
    totals[order] = np.moveaxis(sums, 0, 1)
    return out, totals


def _outcome(key, plan: tuple, n: int, sized: int, tail: np.ndarray, state: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """Rows of a series: the last points, the forecast of the parameters with the least squared error, its errors."""
    period, seasonal, horizon = plan
    m = period if seasonal else 1
    best = int(np.argmin(np.nan_to_num(sums[SQUARES], nan=np.inf)))
    level, trend, season = state[best, 0], state[best, 1], state[best, 2:]
    steps = np.arange(1, horizon + 1)
    ahead = level + steps * trend + (season[(steps - 1) % m] if m > 1 else 0.0)
    moved = ahead[-1] - tail[-1]
    facts = (sums[ERRORS, best] / n, sums[SHARES, best] / sized * 100 if sized else None, m, horizon,
             "flat" if moved == 0 else "rising" if moved > 0 else "falling")
    return [(*key, "history" if i < len(tail) else "forecast", i, float(v), *facts) for i, v in enumerate(np.r_[tail, ahead])]


def _sized(y: np.ndarray) -> int:
    return int((np.abs(y) >= 1e-9).sum())


def _whole(series: list[tuple]) -> list[tuple]:
    """Outcomes of series that are here whole: (key, plan, points)."""
    out = []
    for m in {p[0] if p[1] else 1 for _, p, _ in series}:
        own = [s for s in series if (s[1][0] if s[1][1] else 1) == m]
        for at in range(0, len(own), LANES):
            lanes = own[at:at + LANES]
            start = np.stack([np.repeat(first_state(y, m)[None], _grid(m).shape[1], axis=0) for _, _, y in lanes])
            ends, sums = run_lanes([y for _, _, y in lanes], start, m)
            for (key, plan, y), state, total in zip(lanes, ends, sums):
                out += _outcome(key, plan, len(y), _sized(y), y[-SHOWN:], state, total)
    return out


_FACTS = ["kind", "idx", "value", "mae", "mape", "period", "horizon", "direction"]
_OUT = "kind string, idx int, value double, mae double, mape double, period int, horizon int, direction string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _few(batches: Iterator[pa.RecordBatch], most: int = LANES) -> Iterator[pa.RecordBatch]:
    """The batches in slices: a row here holds a segment or a state."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _cut(n_keys: int, out: pa.Schema, segment: int):
    """Points sorted by (series, time) to segments: outcomes of series that lie inside the task in one segment, and
    the segments of all others (kind null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 33
        key, plan, held, size, first, continued = None, None, [], 0, True, False
        whole, rows = [], []

        def close(inside: bool) -> None:
            nonlocal held, size, seq
            if size:
                y = np.concatenate(held)
                if inside:
                    whole.append((key, plan, y))
                else:
                    rows.append((*key, *[None] * len(_FACTS), seq, *plan, y.tolist()))
                    seq += 1
            held, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
            y = batch.column("_y").to_numpy()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if plan is None or keys[a] != key:
                    close(not first and not continued)
                    first, continued = plan is None, False
                    key, plan = keys[a], tuple(batch.column(c)[a].as_py() for c in ("period", "seasonal", "horizon"))
                while a < b:
                    if size == segment:
                        close(False)
                        continued = True
                    more = y[a:min(b, a + segment - size)]
                    held.append(more)
                    size, a = size + len(more), a + len(more)
            if sum(len(w[2]) for w in whole) + sum(len(r[-1]) for r in rows) >= LANES * 1024:
                yield _batch([(*o, *[None] * 5) for o in _whole(whole)] + rows, out)
                whole, rows = [], []
        close(False)  # it may go on in the next task
        yield _batch([(*o, *[None] * 5) for o in _whole(whole)] + rows, out)
    return run


def _segment_lanes(batches: Iterator[pa.RecordBatch], start) -> Iterator[tuple]:
    """(row, points, state at the end, sums) of segments, run lanes at a time; ``start`` gives a row's first state, if any."""
    for batch in _few(batches):
        rows = list(_rows(batch))
        for m in {r[1] if r[2] else 1 for r in rows}:
            own = [r for r in rows if (r[1] if r[2] else 1) == m]
            shape = (_grid(m).shape[1], 2 + (m if m > 1 else 0))
            for at in range(0, len(own), LANES):
                lanes = own[at:at + LANES]
                points = [np.array(r[4]) for r in lanes]
                states = np.stack([start(r, shape) for r in lanes])
                yield from zip(lanes, points, *run_lanes(points, states, m, errors=start is not _zero))


def _zero(_row, shape):
    return np.zeros(shape)


def _entered(row, shape):
    return np.array(row[5]).reshape(shape)


_OFFSETS = pa.schema([("seq", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.float64())), ("offset", pa.list_(pa.float64()))])


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, y, state, _ in _segment_lanes(batches, _zero):
        yield _batch([(row[0], len(y), y[:HEAD].tolist(), state.ravel().tolist())], _OFFSETS)


_ENTRIES = pa.schema([("seq", pa.int64()), ("entry", pa.list_(pa.float64())), ("ends", pa.bool_())])


def _entries(n_keys: int):
    """The state that each segment starts in, over the segments of each series in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, state, begun = None, [], None, False

        def passed(row) -> tuple:
            nonlocal state
            seq, period, seasonal, n, _, offset = row
            m = period if seasonal else 1
            entry = state
            with np.errstate(over="ignore", invalid="ignore"):
                power = np.linalg.matrix_power(_step_matrix(m), n)
                state = (power @ state[:, :, None])[:, :, 0] + np.array(offset).reshape(state.shape)
            return seq, entry.ravel().tolist(), False

        def settle(last: bool) -> list[tuple]:
            """Pass the waiting segments on, once they hold the points that set the first state; all but the newest."""
            nonlocal state, waiting
            if not waiting:
                return []
            m = waiting[0][1] if waiting[0][2] else 1
            if state is None:
                head = np.concatenate([r[4] for r in waiting])
                if len(head) < 2 * m and not last:
                    return []
                state = np.repeat(first_state(head, m)[None], _grid(m).shape[1], axis=0)
            out = [passed(r) for r in (waiting if last else waiting[:-1])]
            waiting = [] if last else waiting[-1:]
            if last:
                out[-1] = (*out[-1][:2], True)
            return out

        for batch in _few(batches):
            out = []
            for row in _rows(batch):
                if not begun or row[:n_keys] != key:
                    out += settle(True)
                    key, begun, state = row[:n_keys], True, None
                waiting.append(row[n_keys:])
                out += settle(False)
            yield _batch(out, _ENTRIES)
        yield _batch(settle(True), _ENTRIES)
    return run


_RUNS = pa.schema([("seq", pa.int64()), ("n", pa.int64()), ("sized", pa.int64()), ("tail", pa.list_(pa.float64())),
                   ("sums", pa.list_(pa.float64())), ("state", pa.list_(pa.float64()))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, y, state, sums in _segment_lanes(batches, _entered):
        yield _batch([(row[0], len(y), _sized(y), y[-SHOWN:].tolist(), sums.ravel().tolist(),
                       state.ravel().tolist() if row[6] else None)], _RUNS)


def _finish(n_keys: int, out: pa.Schema):
    """Outcomes over the runs of each series in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sized = 0
        tail, sums = np.empty(0), 0.0
        for batch in _few(batches):
            rows = []
            for row in _rows(batch):
                key, (period, seasonal, horizon, own_n, own_sized, own_tail, own_sums, state) = row[:n_keys], row[n_keys + 1:]
                n, sized, tail = n + own_n, sized + own_sized, np.r_[tail, own_tail][-SHOWN:]
                with np.errstate(over="ignore", invalid="ignore"):
                    sums = sums + np.array(own_sums).reshape(3, -1)
                if state is not None:  # the last segment of its series
                    rows += _outcome(key, (period, seasonal, horizon), n, sized, tail,
                                     np.array(state).reshape(sums.shape[1], -1), sums)
                    n, sized, tail, sums = 0, 0, np.empty(0), 0.0
            yield _batch(rows, out)
    return run


def holt_winters(series: DataFrame, keys: list[str], t_col: str, y_col: str,
                 max_points: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Per series forecast with a fixed (alpha, beta, gamma) grid chosen by
    in-sample SSE, over all its points (``max_points``: only the last so many).
    Output rows ``keys..., kind (history|forecast), idx, value`` (history = the
    last 60 points) with the series' ``mae, mape, period, horizon, direction``
    repeated on each row.  Period and horizon are those of :func:`series_plan`.
    Points of one time are taken in the order of their values."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"_k{i}" for i in range(len(keys))]
    key_schema = ", ".join(f"{k} {series.schema[c].dataType.simpleString()}" for k, c in zip(names, keys))
    points = finite_table(series.select(*[_q(c).alias(k) for k, c in zip(names, keys)],
                                        _q(t_col).alias("_t"), _q(y_col).cast("double").alias("_y")))
    points = points.where(F.col("_y").isNotNull())
    if max_points:
        w = Window.partitionBy(*names).orderBy(F.desc("_t"))  # planned as a group limit, partial before the shuffle
        points = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_points).drop("_r")
    plan = series_plan(points, names).where("n >= 12").drop("n")
    planned = null_safe(points, plan, names).select(*names, "_t", "_y", "period", "seasonal", "horizon")

    outcome = f"{key_schema}, {_OUT}"
    cut = f"{outcome}, seq long, plan_period int, plan_seasonal boolean, plan_horizon int, points array<double>"
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    found = cut_lineage(planned.repartitionByRange(*names, "_t", "_y").sortWithinPartitions(*names, "_t", "_y")
                        .mapInArrow(_cut(len(names), arrow(cut), segment), cut))
    out = found.where("seq is null").select(*names, *_FACTS)
    if not found.where("seq is not null").isEmpty():
        out = out.unionByName(_long_series(found.where("seq is not null"), names, outcome, arrow(outcome)))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keys)], *_FACTS)


def _long_series(segments: DataFrame, names: list[str], outcome: str, schema: pa.Schema) -> DataFrame:
    """Outcomes of series in several segments: from zero, the states between, and again from those."""
    facts = ["plan_period", "plan_seasonal", "plan_horizon"]
    pieces = segments.select("seq", *facts, "points")
    order = segments.select("seq", *names, *facts)
    offsets = pieces.mapInArrow(_offsets, "seq long, n long, head array<double>, offset array<double>")
    entries = (order.join(offsets, "seq").repartition(*names).sortWithinPartitions(*names, "seq")
               .select(*names, "seq", *facts[:2], "n", "head", "offset")
               .mapInArrow(_entries(len(names)), "seq long, entry array<double>, ends boolean"))
    runs = (pieces.join(entries, "seq").select("seq", *facts, "points", "entry", "ends")
            .mapInArrow(_runs, "seq long, n long, sized long, tail array<double>, sums array<double>, state array<double>"))
    return (order.join(runs, "seq").repartition(*names).sortWithinPartitions(*names, "seq")
            .select(*names, "seq", *facts, "n", "sized", "tail", "sums", "state")
            .mapInArrow(_finish(len(names), schema), outcome))
