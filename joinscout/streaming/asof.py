"""As-of augmentation of a stream by another one: asof_join over rows that arrive in any order within the watermark.

Rows of both sides are kept by entity, with timers. A left row is answered once the watermark has passed the last right row that could be its
partner, so it gets what the batch join over the same rows gives it. Right rows go when no left row can need them: the last one before the watermark and
those after it stay, and those that rows still waiting reach. Rows older than the watermark are dropped, as everywhere in Structured Streaming.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and maps need; a session sets it before a stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DIRECTIONS = ("backward", "forward", "nearest")


def partner(times: list[int], t: int, direction: str, limit: int | None) -> int | None:
    """The place in sorted times of the row that t gets: of equal times the last one backwards and the first one forwards; nearest prefers the past."""
    back, ahead = bisect_right(times, t) - 1, bisect_left(times, t)
    found = [i for i in ((back,) if direction != "forward" else ()) if i >= 0]
    found += [i for i in ((ahead,) if direction != "backward" else ()) if i < len(times)]
    if not found:
        return None
    best = min(found, key=lambda i: abs(times[i] - t))  # the first, backward, of two equally far
    return best if limit is None or abs(times[best] - t) <= limit else None


def spare(times: list[int], mark: int, waiting: int | None, direction: str, limit: int | None) -> int:
    """How many of the first right rows no left row can need any more: of those still to come none is before `mark`, of those here none before `waiting`."""
    earliest = mark if waiting is None else min(mark, waiting)
    if direction == "forward":
        return bisect_left(times, earliest)
    gone = bisect_right(times, earliest) - 1  # all before the last one at or before it; its equals before it too
    gone = max(0, gone)
    return gone if limit is None else max(gone, bisect_left(times, earliest - limit))


class AsOf(StatefulProcessor):
    """State of an entity: right rows by (time, order) and left rows that wait. Times are microseconds."""

    def __init__(self, direction: str, limit: int | None):
        self.direction, self.limit = direction, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rights = handle.getMapState("rights", "t long, seq string", "row string")
        self.lefts = handle.getListState("lefts", "t long, row string")

    def _due(self, t: int) -> int:
        """Milliseconds of the watermark at which a left row of time t can be answered: all right rows up to then are there."""
        return -(-(t + (self.limit if self.direction != "backward" else 0)) // 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        due = set()
        for part in rows:
            for side, t, seq, row in zip(part["side"].tolist(), part["micros"].tolist(), part["seq"].tolist(), part["row"].tolist(), strict=True):
                if side:
                    self.rights.updateValue((int(t), seq), (row,))
                else:
                    self.lefts.appendValue((int(t), row))
                due.add(self._due(int(t)))
        for at in due:
            self.handle.registerTimer(at)
        yield pd.DataFrame({"left": pd.Series([], dtype=str), "right": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        rights = sorted(((k[0], k[1]), v[0]) for k, v in self.rights.iterator())
        times = [k[0] for k, _ in rights]
        lefts = [(r[0], r[1]) for r in self.lefts.get()] if self.lefts.exists() else []
        ready = [x for x in lefts if self._due(x[0]) <= mark]
        waiting = [x for x in lefts if self._due(x[0]) > mark]
        out = []
        for t, row in ready:
            i = partner(times, t, self.direction, self.limit)
            out.append((row, None if i is None else rights[i][1]))
        if ready:
            if waiting:
                self.lefts.put(waiting)
            else:
                self.lefts.clear()
        for k, _ in rights[: spare(times, 1000 * mark, min((t for t, _ in waiting), default=None), self.direction, self.limit)]:
            self.rights.removeKey(k)
        yield pd.DataFrame(out, columns=["left", "right"], dtype=object)

    def close(self) -> None:
        pass


def stream_asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], tolerance: float | None = None, direction: str = "nearest", order: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Every left row with the right row that asof_join gives it, once the watermark (`late` behind the latest row of the stream that lags) has passed it.

    Keys are timestamps, tolerance seconds; looking ahead needs one. `by` names columns of both sides, whose rows are in one task's state; rows with a null in `by` are an entity
    like others. Rows without a time are dropped, as the watermark can't order them. Columns as asof_join has them. The session's state store must be PROVIDER's.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction {direction!r}")
    if not by:
        raise ValueError("a stream needs an entity (by): its rows are one task's state")
    limit = None if tolerance is None or tolerance < 0 else round(tolerance * 1e6)
    if limit is None and direction != "backward":
        raise ValueError(f"direction {direction!r} needs a tolerance: else a row waits for ever")
    payload = [c for c in right.columns if c not in by and c != right_on]
    seq = F.col(order) if order else F.xxhash64(*payload) if payload else F.lit(0)
    names = [f"__by{i}" for i in range(len(by))]

    def side(df: DataFrame, time: str, n: int, order_of: Column, row: Column) -> DataFrame:
        keys = [F.col(b).alias(k) for b, k in zip(by, names, strict=True)]
        rows = df.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("timestamp").alias("at"), F.lit(n).alias("side"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), order_of.alias("seq"), row.alias("row"))
        return rows.withWatermark("at", late)

    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    # numbers of an order are compared as numbers: an offset and a fixed width
    ordered = F.lpad((seq.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0") if not order or right.schema[order].dataType.typeName() in ("byte", "short", "integer", "long") else seq.cast("string")
    kept = F.struct(F.col(right_on).alias(f"__right_{right_on}"), *[F.col(c) for c in payload])
    whole = F.struct(*[F.col(c) for c in left.columns])
    ls = side(left, left_on, 0, F.lit(""), F.to_json(whole, options))
    rs = side(right, right_on, 1, F.coalesce(ordered, F.lit("")), F.to_json(kept, options))
    out = ls.unionByName(rs).groupBy(*names).transformWithStateInPandas(AsOf(direction, limit), "left string, right string", "append", "eventtime")
    left_schema = left.select(whole.alias("x")).schema["x"].dataType
    right_schema = right.select(kept.alias("x")).schema["x"].dataType
    return out.select(F.from_json("left", left_schema, options).alias("l"), F.from_json("right", right_schema, options).alias("r")).select("l.*", "r.*")
