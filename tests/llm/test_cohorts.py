"""Cohort retention against plain Python; the query itself is compared with SQL in test_sql."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from math import floor
from zlib import crc32

from panelspark.llm import cohorts

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, segment string"
BEFORE = datetime(2024, 2, 15)
COLUMNS = "state segment cohort period users users_crc32 moved cents".split()


def plain(clicks, clients, cohort_days=1, period_days=1):
    crc = lambda n: crc32(str(n).encode())
    segments = {}
    for c, s in clients:
        if c is not None and s is not None:
            segments[c] = min(s, segments.get(c, s))
    rows = []
    for id_, ts, arrived, client, kind, value, _ in set(clicks):
        if ts is None or client is None:
            continue
        h = crc(id_) if id_ is not None else 1
        early = arrived is not None and arrived + timedelta(days=h % 100 if h % 3 == 0 else 0) < BEFORE
        rows.append((client, ts, kind, floor(100 * value + 0.5) if value is not None else 0, early))
    start = [defaultdict(lambda: datetime.max), defaultdict(lambda: datetime.max)]
    for client, ts, kind, _, early in rows:
        for state in [0, 1] if early else [1]:
            if kind == "signup":
                start[state][client] = min(start[state][client], ts)
    day = lambda t: (t - datetime(1970, 1, 1)) // timedelta(days=cohort_days)
    cells = defaultdict(lambda: [set(), 0])
    for client, ts, _, cents, early in rows:
        for state in [0, 1] if early else [1]:
            first = start[state].get(client)
            if first and ts >= first:
                cell = cells[state, segments.get(client, ""), day(first), (ts - first) // timedelta(days=period_days)]
                cell[0].add(client)
                cell[1] += cents
    moved = {c for c in start[0] if day(start[0][c]) != day(start[1][c])}
    return sorted((*k, len(u), sum(map(crc, u)), len(u & moved), cents) for k, (u, cents) in cells.items())


def made(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = 7 if rng.random() < 0.4 else rng.choice([None, *range(20)])
        ts = datetime(2024, 1, 1) + timedelta(days=rng.choice([0, 40, 150]) * rng.random(), microseconds=rng.randrange(3))
        rows.append((rng.choice([i, i, i, None]), rng.choice([ts, ts, ts, None]), rng.choice([ts + timedelta(hours=3), ts, None]), client, rng.choice(["signup", "view", None]), rng.choice([1.005, -2.5, 0.0, None, 1e6 * rng.random()]), "{}"))
    return rows + rows[: n // 3]


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_hot_clients_over_salts(spark):
    clicks, clients = made(900), [(7, "b"), (7, "a"), (1, None), (2, "x"), (None, "y")]
    want = plain(clicks, clients)
    frame = spark.createDataFrame(clicks, CLICKS).withColumn("salt", cohorts.F.lit("extra")).withColumn("state", cohorts.F.lit(3))
    for salt_rows in (1, 5, 10_000):
        assert result(cohorts.retention(frame, spark.createDataFrame(clients, CLIENTS), salt_rows=salt_rows)) == want
    assert any(r[0] == 0 for r in want) and any(r[6] for r in want)


def test_longer_cohorts_and_periods(spark):
    clicks, clients = made(300, 8), [(7, "b")]
    assert result(cohorts.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS), cohort_days=7, period_days=2)) == plain(clicks, clients, 7, 2)


def test_far_and_broken_rows(spark):
    at = datetime(1969, 12, 31, 23, 59, 59, 999_999)
    clicks = [
        (1, at, at, 5, "signup", float("nan"), None), (2, at + timedelta(days=1), at, 5, None, 1e300, None), (2, at + timedelta(days=1, microseconds=-1), at, 5, None, 1.0, None),
        (4, datetime(9999, 12, 31), at, 5, "view", float("-inf"), None), (5, at, at, 6, "view", 3.0, None),
    ]
    got = result(cohorts.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame([], CLIENTS)))
    assert [(r[0], r[2], r[3], r[7]) for r in got] == [(s, -1, p, c) for s in (0, 1) for p, c in ((0, 100), (1, 0), ((datetime(9999, 12, 31) - at).days, 0))]


def test_empty_and_zoned(spark):
    empty = spark.createDataFrame([], CLICKS)
    assert result(cohorts.retention(empty, spark.createDataFrame([], CLIENTS))) == []
    clicks = [r for r in made(60) if r[2]]
    frame = spark.createDataFrame(clicks, CLICKS)
    zoned = frame.withColumn("ts", frame.ts.cast("timestamp")).withColumn("arrived_at", frame.arrived_at.cast("timestamp"))
    assert result(cohorts.retention(zoned, spark.createDataFrame([], CLIENTS))) == plain(clicks, [])
