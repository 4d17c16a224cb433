"""Weather with a lifetime: tables against a loop, streams against tables."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from panelwright.operators import weather
from panelwright.settings import WEATHER_DEFAULTS
from panelwright.streaming import weather_state as state
from panelwright.streaming.replay import run_available, stream_of

FIELDS = list(weather.PATHS)
START = datetime(2024, 5, 1, tzinfo=timezone.utc)
LIFETIME = 600


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def log(seed, n=150):
    """Runs (id, city, second) and observations (city, second, fields) with ties, gaps, nulls and a busy city."""
    rng = random.Random(seed)
    city = lambda: rng.choice(["Oslo"] * 5 + ["Bern", "Aden", None])
    runs = [(i, city(), None if i % 31 == 0 else rng.randrange(0, 5000)) for i in range(n)]
    seen = [(city(), rng.randrange(0, 5000) if rng.random() < 0.8 else rng.choice(runs)[2], [float(rng.randrange(9)) for _ in FIELDS]) for _ in range(n // 3)]
    return runs, seen + seen[:3]


def expected(runs, seen):
    out = []
    for i, city, t in runs:
        known = [(s, [-v for v in w]) for c, s, w in seen if None not in (city, t, s) and c == city and t - LIFETIME <= s <= t]
        w = [-v for v in max(known)[1]] if known else [WEATHER_DEFAULTS[f] for f in FIELDS]
        out.append((i, city, *w, bool(known)))
    return sorted(out)


def frames(spark, runs, seen):
    kinds = ", ".join(f"{f} double" for f in FIELDS)
    return (
        spark.createDataFrame([(i, c, at(t)) for i, c, t in runs], "run_id long, city string, at timestamp"),
        spark.createDataFrame([(c, at(t), *w) for c, t, w in seen], f"city string, at timestamp, {kinds}"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tables_equal_a_loop(spark, seed):
    runs, seen = log(seed)
    got = weather.as_of(*(f.repartition(3) for f in frames(spark, runs, seen)), lifetime_s=LIFETIME)
    assert sorted(map(tuple, got.select("run_id", "city", *FIELDS, "fetch_successful").collect())) == expected(runs, seen)


def test_empty_tables(spark):
    runs, seen = log(4, 9)
    none, nothing = frames(spark, [], [])
    assert weather.as_of(none, frames(spark, [], seen)[1]).count() == 0
    alone = weather.as_of(frames(spark, runs, [])[0], nothing).collect()
    assert len(alone) == 9 and not any(r.fetch_successful for r in alone) and {r.ambient_temp_c for r in alone} == {25.0}


def test_a_stream_equals_the_tables_whatever_comes_late(spark, tmp_path):
    """Rows arrive in disorder within the delay, in four parts with a restart after each; what is later than the delay is left out."""
    runs, seen = log(5)
    runs = [r for r in runs if r[2] is not None]
    rng = random.Random(7)
    rows = [(state.RUN, c, at(t), i, *[None] * len(FIELDS), t + rng.randrange(100)) for i, c, t in runs]
    rows += [(state.OBSERVATION, c, at(t), None, *w, t + rng.randrange(100)) for c, t, w in seen if t is not None]
    too_late = [(state.OBSERVATION, c, at(10), None, *[77.0] * len(FIELDS), 4000) for c in ("Oslo", "Bern")]
    closing = (2, None, at(90_000), None, *[None] * len(FIELDS), 9000)
    like = f"kind int, city string, at timestamp, run_id long, {', '.join(f'{f} double' for f in FIELDS)}, arrival long"
    every = spark.createDataFrame([*rows, *too_late, closing], like)
    schema = every.drop("arrival")
    for lo, hi in ((0, 1000), (1000, 2500), (2500, 4000), (4000, 8000), (8000, 10_000)):
        every.where(f"arrival >= {lo} and arrival < {hi}").drop("arrival").write.parquet(str(tmp_path / "log" / str(lo)))
        run_available(stream_of(spark, str(tmp_path / "log" / "*"), schema), lambda r: state.as_of_stream(r, "200 seconds", LIFETIME), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).select("run_id", "city", *FIELDS, "fetch_successful").collect()
    assert sorted(map(tuple, got)) == expected(runs, seen)


def test_a_stream_that_takes_too_long_is_stopped(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in" / "0"))
    stream = stream_of(spark, str(tmp_path / "in" / "*"), spark.range(1), 1)
    with pytest.raises(TimeoutError):
        run_available(stream, lambda s: s, str(tmp_path / "out"), str(tmp_path / "state"), timeout_s=0.001)
    run_available(stream, lambda s: s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_the_state_is_asked_a_few_times_however_many_rows_come(monkeypatch):
    """A part of a city costs some calls a batch: it has one timer, and rows are held as they came together."""
    pd = pytest.importorskip("pandas")

    class Held:
        def __init__(self):
            self.values = []

        def get(self):
            calls.append("get")
            return list(self.values)

        def appendValue(self, value):
            calls.append("append")
            self.values.append(value)

        def clear(self):
            self.values = []

    class One(Held):
        def get(self):
            return self.values[-1] if self.values else None

        update = Held.appendValue

    class Handle:
        getListState = lambda *_: Held()
        getValueState = lambda *_: One()
        registerTimer = lambda _, ms: timers.add(ms)
        deleteTimer = lambda _, ms: timers.discard(ms)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    calls, timers = [], set()
    part = state.AsOf(LIFETIME)
    part.init(Handle())
    n = 5000
    rows = [(state.RUN, 1_000_000 * (i + 1), i, *[0.0] * 7) for i in range(n)] + [(state.OBSERVATION, 1_000_000 * i, -1, *[float(i)] * 7) for i in range(0, n, 9)]
    list(part.handleInputRows(("Oslo", 0), iter([pd.DataFrame(rows, columns=["kind", "us", "run_id", *FIELDS])]), None))
    assert len(timers) == 1
    out = pd.concat(part.handleExpiredTimer(("Oslo", 0), At(2_000_000), At(min(timers))))
    assert len(calls) < 20 and len(out) == 1999 and len(timers) == 2
    out = pd.concat([out, *part.handleExpiredTimer(("Oslo", 0), At(10**9), At(max(timers)))])
    assert out["run_id"].tolist() == list(range(n)) and out["ambient_temp_c"].tolist() == [float((i + 1) // 9 * 9 if i < n - 1 else (n - 1) // 9 * 9) for i in range(n)]
    assert not part.seen.values and not part.waiting.values
