"""First touches of open-ended paths, and nearest prices, in one pass over each symbol's price days and anchors, sorted by date.

Spark deals both kinds of rows by symbol and sorts them; a task reads them in Arrow batches and holds the batch at hand and one
symbol's calendar.  Runs of days without a touch are skipped by minima and maxima over powers of two, so that an anchor costs the
logarithm of its symbol's days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are looked through at once, rounded up to whole symbols.
ROWS = 50_000


def _ladder(values: np.ndarray, extreme, longest: int) -> list[np.ndarray]:
    """``extreme`` over 1, 2, 4, .. values from each place on."""
    levels = [values]
    while 2 ** len(levels) <= longest:
        half = 2 ** (len(levels) - 1)
        levels.append(extreme(levels[-1][:-half], levels[-1][half:]))
    return levels


def _skip(levels: list[np.ndarray], lows: list[np.ndarray], touched, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place in [start, end) whose value ``touched``, else end; least low before it)."""
    at, least = start.copy(), np.full(len(start), np.nan)
    for k in range(len(levels) - 1, -1, -1):
        rows = np.flatnonzero(at + 2**k <= end)
        rows = rows[~touched(levels[k][at[rows]], rows)]
        least[rows] = np.fmin(least[rows], lows[k][at[rows]])
        at[rows] += 2**k
    return at, least


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and which of them are given."""
    return np.asarray(column.fill_null(0)), np.asarray(column.is_valid())


def _touches(rows: pa.Table, stops: Sequence[float], targets: Sequence[float], schema: pa.Schema) -> pa.RecordBatch:
    """Entry and touches of the anchors among the rows of whole symbols.  As in Spark, NaN is the greatest number."""
    symbol = rows["symbol"].combine_chunks()
    is_key = np.asarray(rows["is_key"])
    new = np.r_[True, np.asarray(pc.not_equal(symbol[1:], symbol[:-1]))]
    days = rows.filter(pa.array(~is_key))
    dates, dated = _numbers(days["date"].cast(pa.int32()))
    (opens, has_open), (closes, has_close), (highs, has_high), (lows, has_low) = (_numbers(days[c]) for c in ("open", "close", "high", "low"))

    # A symbol's days are first..last - 1 of all days; an anchor stands behind the days up to its date.
    before = np.r_[0, np.cumsum(~is_key)]
    heads = np.flatnonzero(new)
    segment = (np.cumsum(new) - 1)[is_key]
    first, last = before[heads][segment], before[np.r_[heads[1:], len(is_key)]][segment]
    start = before[:-1][is_key] - first
    undated = np.r_[0, np.cumsum(~dated)]
    start[start <= undated[last] - undated[first]] = 0  # days without a date come first and are on no date
    known = last > first

    def on(values: np.ndarray, given: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, has = np.zeros(len(at), values.dtype), np.zeros(len(at), bool)
        out[inside], has[inside] = values[at[inside]], given[at[inside]]
        return out, has

    close, has_close = on(closes, has_close, first + start - 1, start > 0)
    day1, has_day1 = on(opens, has_open, first + start, first + start < last)
    opened = has_day1 & ((day1 > 0) | np.isnan(day1))
    if "at_close" in rows.column_names:
        opened &= ~np.asarray(rows["at_close"])[is_key]
    entry, has_entry = np.where(opened, day1, close), opened | has_close

    usable = has_high & has_low
    place, counted = np.flatnonzero(usable), np.r_[0, np.cumsum(usable)]
    begin, end = counted[first + start], counted[last]
    longest = int((end - begin).max(initial=1))
    low = _ladder(lows[usable], np.fmin, longest)
    high = _ladder(highs[usable], np.maximum, longest)
    sought = np.where(has_entry, end, begin)

    spans = np.flatnonzero(end > begin)
    lowest = np.zeros(len(begin))
    level = np.frexp((end - begin)[spans])[1] - 1  # the largest power of two in it
    for k in np.unique(level):
        at = spans[level == k]
        lowest[at] = np.fmin(low[k][begin[at]], low[k][end[at] - 2**k])

    def column(values: np.ndarray, given: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(values.astype(np.float64 if pa.types.is_floating(kind) else np.int32), mask=~given).cast(kind)

    def touch(levels: list[np.ndarray], touched) -> list[pa.Array]:
        at, least = _skip(levels, low, touched, begin, sought)
        hit = at < sought
        day = np.zeros(len(at), np.int64)
        day[hit] = place[at[hit]]
        least[hit] = np.fmin(least[hit], low[0][at[hit]])
        date, has_date = on(dates, dated, day, hit)
        return [column(day - first + 1, hit, pa.int32()), column(date, has_date, pa.date32()), column(least, hit, pa.float64())]

    def under(pct: float):
        limit = entry * (1 - pct / 100)
        return lambda values, rows: (values <= limit[rows]) | np.isnan(limit[rows])

    def over(pct: float):
        limit = entry * (1 + pct / 100)
        return lambda values, rows: (values >= limit[rows]) | np.isnan(values)

    keys = rows.filter(pa.array(is_key))
    columns = [
        keys["symbol"].combine_chunks(), keys["date"].combine_chunks(), column(start, known, pa.int32()), column(close, has_close, pa.float64()),
        column(day1, has_day1, pa.float64()), column(entry, has_entry, pa.float64()),
        *[c for s in stops for c in touch(low, under(s))], *[c for t in targets for c in touch(high, over(t))],
        column(lowest, end > begin, pa.float64()), column(last - first - start, np.ones(len(start), bool), pa.int32()),
        *[keys[c].combine_chunks() for c in ("at_close",) if c in keys.column_names],
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _whole_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at least ``ROWS`` rows that end with a symbol's last row."""
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        symbol = batch["symbol"]
        ends = np.flatnonzero(np.asarray(pc.not_equal(symbol[1:], symbol[:-1]))) + 1
        if held and held[-1]["symbol"][-1].as_py() != symbol[0].as_py():
            ends = np.r_[0, ends]
        if n + len(batch) >= ROWS and len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, ends[-1])])
            batch, held, n = batch.slice(ends[-1]), [], 0
        held.append(batch)
        n += len(batch)
    if held:
        yield pa.Table.from_batches(held)


def scan_touches(keys: DataFrame, prices: DataFrame, stops: dict[str, float], targets: dict[str, float]) -> DataFrame:
    """Entry (as ``prices.anchor_entries``) and earliest touches (as ``barriers.first_touches``) per (symbol, anchor_date) of ``keys``.

    ``stops`` and ``targets`` name the touches.  Both inputs are shuffled once, by symbol.  Keys may have a flag ``at_close``: those
    that have it set enter at the anchor close.
    """
    names = [*stops, *targets]
    fields = [("symbol", pa.string()), ("anchor_date", pa.date32()), ("start_idx", pa.int32()), *[(c, pa.float64()) for c in ("anchor_close", "day1_open", "entry_price")]]
    fields += [f for name in names for f in ((f"{name}_idx", pa.int32()), (f"{name}_date", pa.date32()), (f"{name}_low", pa.float64()))]
    flags = ["at_close"] if "at_close" in keys.columns else []
    out = pa.schema([*fields, ("lowest", pa.float64()), ("n_rows", pa.int32()), *[(c, pa.bool_()) for c in flags]])
    numbers = ("open", "high", "low", "close")
    days = prices.filter("symbol IS NOT NULL").select(
        "symbol", "date", *[F.col(c).cast("double") for c in numbers], F.lit(False).alias("is_key"), *[F.lit(False).alias(c) for c in flags])
    anchors = keys.dropna(subset=["symbol", "anchor_date"]).select(
        "symbol", F.col("anchor_date").alias("date"), *[F.lit(None).cast("double").alias(c) for c in numbers], F.lit(True).alias("is_key"), *flags)
    low, high = list(stops.values()), list(targets.values())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_symbols(batches):
            yield _touches(rows, low, high, out)

    sql = {pa.string(): "string", pa.date32(): "date", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}
    found = days.unionByName(anchors).repartition("symbol").sortWithinPartitions("symbol", "date", "is_key").mapInArrow(
        scan, ", ".join(f"{f.name} {sql[f.type]}" for f in out))
    touch = lambda n: F.when(F.col(f"{n}_idx").isNotNull(), F.struct(
        F.col(f"{n}_idx").alias("idx"), F.col(f"{n}_date").alias("date"), F.col(f"{n}_low").alias("run_low"))).alias(n)
    return found.select(
        "symbol", "anchor_date", "start_idx", "anchor_close", "day1_open", "entry_price", *[touch(n) for n in names], "lowest", "n_rows", *flags)


def _nearest(rows: pa.Table, offsets: Sequence[int], fwd: int, back: int, schema: pa.Schema) -> pa.RecordBatch:
    """The nearest close ``offsets`` days after each key among the rows of whole symbols."""
    symbol = rows["symbol"].combine_chunks()
    is_key = np.asarray(rows["is_key"])
    segment = np.cumsum(np.r_[True, np.asarray(pc.not_equal(symbol[1:], symbol[:-1]))]) - 1
    dates, dated = _numbers(rows["date"].cast(pa.int32()))
    # A symbol whose first row has no date is not looked ahead into, as its first dated day is not its first.
    undated = np.zeros(segment[-1] + 1, bool)
    undated[segment[~is_key & ~dated]] = True
    day = ~is_key & dated
    place = lambda at, date: (at.astype(np.int64) << 33) + date + 2**32
    days, closes = place(segment[day], dates[day].astype(np.int64)), np.asarray(rows["close"].fill_null(0))[day]
    keys, own = rows.filter(pa.array(is_key)), segment[is_key]
    begin = np.searchsorted(days, place(own, np.int64(-(2**32))))

    def close_of(offset: int) -> pa.Array:
        sought = place(own, dates[is_key].astype(np.int64) + offset)
        later, after = np.searchsorted(days, sought), np.searchsorted(days, sought, "right")
        reach = np.searchsorted(days, sought + fwd, "right")
        same, ahead = after > later, (reach > later) & ~(undated[own] & (later == begin))
        behind = (later > begin) & (days[later - 1] >= sought - back) if len(days) else np.zeros(len(own), bool)
        at = np.where(same, after - 1, np.where(ahead, later, later - 1))
        given = same | ahead | behind
        return pa.array(closes[np.where(given, at, 0)] if len(days) else np.zeros(len(own)), mask=~given)

    return pa.RecordBatch.from_arrays([*[keys[c].combine_chunks() for c in ("symbol", "date", "traded")], *[close_of(o) for o in offsets]], schema=schema)


def scan_nearest(keys: DataFrame, prices: DataFrame, offsets: Sequence[int], fwd: int = 5, back: int = 3) -> DataFrame:
    """``p<offset>``: the close that ``prices.nearest_days`` has ``offset`` days after each (symbol, base_date, traded) of ``keys``.

    Both inputs are shuffled once, by symbol; neither days nor keys are multiplied.
    """
    out = pa.schema([("symbol", pa.string()), ("base_date", pa.date32()), ("traded", pa.bool_()), *[(f"p{o}", pa.float64()) for o in offsets]])
    none = F.lit(None)
    days = prices.filter("symbol IS NOT NULL AND close IS NOT NULL").select(
        "symbol", "date", F.col("close").cast("double").alias("close"), F.lit(False).alias("is_key"), none.cast("boolean").alias("traded"))
    asked = keys.select("symbol", F.col("base_date").alias("date"), none.cast("double").alias("close"), F.lit(True).alias("is_key"), "traded")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_symbols(batches):
            yield _nearest(rows, offsets, fwd, back, out)

    return days.unionByName(asked).repartition("symbol").sortWithinPartitions("symbol", "date", "close").mapInArrow(
        scan, "symbol string, base_date date, traded boolean, " + ", ".join(f"p{o} double" for o in offsets))
