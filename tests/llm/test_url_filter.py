"""Dated URL lists against a plain loop over every event."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tillspark.llm import url_filter

HOSTS = ("a.hot.org", "b.hot.org", "hot.org", "x.y.z.co", "co")
START = dt.datetime(2024, 1, 1)


def random_case(seed):
    rng = random.Random(seed)
    hours = lambda: START + dt.timedelta(hours=rng.randrange(24 * 12))
    keys = ("hot.org", "a.hot.org", "z.co", "y.z.co", "a.hot.org/p", "hot.org/")
    events = [(rng.choice(keys), hours(), rng.random() < 0.6) for _ in range(80)]
    events += rng.sample(events, 5) + [(None, START, True), ("hot.org", None, True)]
    seen = [(i, f"http://{rng.choice(HOSTS[:1] * 6 + HOSTS[1:])}{rng.choice(('', '/', '/p?q', '/q'))}",
             hours()) for i in range(300)]
    return events, seen + [seen[0], (900, None, START), (901, "http://hot.org", None), (902, "", START)]


def by_hand(events, url, at):
    """The active keys of a capture and since when, one event after another."""
    if not url or at is None:
        return {}
    host, _, path = url.removeprefix("http://").partition("/")
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))}
    keys.add(f"{host}/{path.split('?')[0]}")
    active = {}
    for key in keys:
        mine = {}
        for k, time, listed in events:
            if k == key and time is not None:
                mine[time] = mine.get(time, True) and listed
        since = None
        for time in sorted(t for t in mine if t <= at):
            since = (since or time) if mine[time] else None
        if since is not None:
            active[key] = since
    return active


def test_as_of_join_against_a_loop(spark):
    for seed in (1, 2):
        events, seen = random_case(seed)
        table = spark.createDataFrame(seen, "page_id long, url string, fetched timestamp")
        table = table.withColumns({"key": F.lit("mine"), "entry": F.lit(1), "day": F.lit(2)})
        listed = spark.createDataFrame(events, "key string, time timestamp, listed boolean")
        got = url_filter.judge(table, listed).collect()
        assert len(got) == len(seen)
        want = []
        for i, url, at in seen:
            active = by_hand(events, url, at)
            best = max(active, key=lambda k: (len(k), k), default=None)
            want.append((i, len(active), best, active.get(best)))
        key = lambda r: (r[0], str(r))
        have = [(r.page_id, r.n_entries, r.entry, r.valid_from) for r in got]
        assert sorted(have, key=key) == sorted(want, key=key)
        assert sum(n > 0 for _, n, _, _ in want) > 50


def test_empty_list_and_plan(spark):
    events, seen = random_case(3)
    table = spark.createDataFrame(seen, "page_id long, url string, fetched timestamp")
    listed = spark.createDataFrame(events, "key string, time timestamp, listed boolean")
    none = url_filter.judge(table, listed.limit(0)).collect()
    assert len(none) == len(seen) and not any(r.blocked for r in none)
    plan = url_filter.judge(table, listed)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cross" not in plan
