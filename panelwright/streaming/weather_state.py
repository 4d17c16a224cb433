"""Weather of a city with a lifetime, as state of a stream: what ``operators.weather.as_of`` gives over tables.

Runs and observations come in one stream, in any order within the watermark's delay. A run waits until the watermark has passed it,
as until then an earlier observation may still arrive; then it is answered from the observations that the state holds.

A state's key is a part of a city and has one timer, for what is due first: all runs that the watermark has passed are answered at once, by
one search in the sorted observations, and those that no later run can need are dropped. Rows are held packed, as many in a value as came
together, so that what it costs follows the rows and not the calls of the state. Cities are split in WAYS parts by run, so that one city's
runs don't all wait in one place; observations go to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelwright.operators.weather import LIFETIME_S, PATHS
from panelwright.settings import DEFAULT, Settings

WAYS = 4
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ", ".join(f"{c} double" for c in PATHS)
RUN, OBSERVATION = 1, 0


class AsOf(StatefulProcessor):
    """State of a part of a city: packed observations (times, fields), waiting runs (times, ids), and when its timer is due."""

    def __init__(self, lifetime_s: int):
        self.lifetime_us = lifetime_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "us binary, fields binary")
        self.waiting = handle.getListState("waiting", "us binary, run binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        due = []
        for frame in rows:
            kind, us = frame["kind"].to_numpy(), frame["us"].to_numpy(np.int64)
            seen, asked = kind == OBSERVATION, kind == RUN
            if seen.any():
                self.seen.appendValue((us[seen].tobytes(), frame.loc[seen, list(PATHS)].to_numpy(np.float64).tobytes()))
                due.append(self.needless(us[seen]))
            if asked.any():
                self.waiting.appendValue((us[asked].tobytes(), frame["run_id"].to_numpy(np.int64)[asked].tobytes()))
                due.append(self.passing(us[asked]))
        self.wait(due)
        yield pd.DataFrame()

    def passing(self, us) -> int:
        """The watermark, in milliseconds, that has passed the first of the times."""
        return int(us.min()) // 1000 + 1

    def needless(self, us) -> int:
        """The watermark at which no later run can need the first of these observations."""
        return self.passing(us + self.lifetime_us)

    def wait(self, due: list[int]) -> None:
        """Moves the timer to the first of ``due``, if there is no timer or it is later."""
        old = self.due.get()
        if due and (old is None or min(due) < old[0]):
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.due.update((min(due),))
            self.handle.registerTimer(min(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np

        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        us, fields = self.packed(self.seen, np.float64)
        fields = fields.reshape(len(us), len(PATHS))
        of, run = self.packed(self.waiting, np.int64)
        late = of // 1000 + 1 > passed
        yield self.answered(key[0], of[~late], run[~late], us, fields)
        held = (us + self.lifetime_us) // 1000 + 1 > passed
        due = []
        for state, times, values, at in ((self.waiting, of[late], run[late], self.passing), (self.seen, us[held], fields[held], self.needless)):
            state.clear()
            if len(times):
                state.appendValue((times.tobytes(), values.tobytes()))
                due.append(at(times))
        self.due.clear()
        self.wait(due)

    def packed(self, state, kind):
        """All times and values that a state holds."""
        import numpy as np

        parts = list(state.get())
        return np.frombuffer(b"".join(p[0] for p in parts), np.int64), np.frombuffer(b"".join(p[1] for p in parts), kind)

    def answered(self, city: str, of, run, us, fields):
        """The latest observation of each run that isn't older than a lifetime; of several at one time the smallest."""
        import numpy as np
        import pandas as pd

        order = np.lexsort([*(-fields.T[::-1]), us])
        us, fields = us[order], fields[order]
        place = np.searchsorted(us, of, "right") - 1
        fresh = place >= 0
        fresh[fresh] = us[place[fresh]] >= of[fresh] - self.lifetime_us
        values = np.full((len(of), len(PATHS)), np.nan)  # null in the result
        values[fresh] = fields[place[fresh]]
        out = pd.DataFrame(values, columns=list(PATHS))
        out.insert(0, "run_id", run)
        out.insert(1, "city", city)
        out["fetch_successful"] = fresh
        return out

    def close(self) -> None:
        pass


def as_of_stream(rows: DataFrame, delay: str, lifetime_s: int = LIFETIME_S, ways: int = WAYS, s: Settings = DEFAULT) -> DataFrame:
    """``run_id``, ``city``, the fields, ``fetch_successful`` of every run of the stream ``rows``, once the watermark has passed it.

    ``rows`` has ``kind`` (RUN, OBSERVATION; others only move the watermark), ``city``, ``at`` (timestamp), ``run_id`` and the fields. Rows that are later than
    ``delay`` are left out, as they are by any watermark. Runs without a city have the defaults at once; rows without a time can't be placed and go.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.withWatermark("at", delay)
    parts = F.when(F.col("kind") == RUN, F.array(F.pmod(F.xxhash64("run_id"), F.lit(ways)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long")))
    dealt = timed.where("at is not null and (city is not null or kind not in (0, 1))").select(
        F.coalesce("city", F.lit("")).alias("city"), F.explode(parts).alias("part"), "at", "kind", F.unix_micros("at").alias("us"), F.coalesce("run_id", F.lit(-1)).alias("run_id"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PATHS],
    )
    schema = f"run_id long, city string, {FIELDS}, fetch_successful boolean"
    found = dealt.groupBy("city", "part").transformWithStateInPandas(AsOf(lifetime_s), schema, outputMode="Append", timeMode="EventTime")
    lost = timed.where(f"city is null and kind = {RUN}").select("run_id", "city", *[F.lit(None).cast("double").alias(c) for c in PATHS], F.lit(False).alias("fetch_successful"))
    return found.union(lost).withColumns({c: F.coalesce(c, F.lit(float(s.weather_defaults[c]))) for c in PATHS})
