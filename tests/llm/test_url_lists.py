"""Dated lists against brute force over all pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import duckdb
import pytest

from quillon.llm import common, url_lists

T0 = datetime(2024, 1, 1)


def brute(captures: list[tuple], events: list[tuple]) -> list[list[str] | None]:
    out = []
    for _, url, at in captures:
        names = set()
        host = (urlsplit(url).hostname or "").rstrip(".") if url else ""
        path = (urlsplit(url).path if url else "").rstrip("/")
        for name, pattern in {(e[0], e[1]) for e in events if None not in e}:
            past = [(e[3], e[2] != "remove", e[2]) for e in events if None not in e and e[:2] == (name, pattern) and at is not None and e[3] <= at]
            if not past or min(past, key=lambda p: (-(p[0] - T0).total_seconds(), p[1]))[2] != "add":
                continue
            domain, slash, rest = pattern.lower().partition("/")
            if slash and rest.strip("/"):
                want = "/" + pattern.partition("/")[2].rstrip("/")
                hit = host.removeprefix("www.") == domain.removeprefix("www.") and (path == want or path.startswith(want + "/"))
            else:
                hit = host == domain or host.endswith("." + domain)
            if hit and host:
                names.add(name)
        out.append(sorted(names))
    return out


def test_random_lists(spark):
    rng = random.Random(5)
    hosts = ["a.com", "www.a.com", "x.a.com", "b.org", "c.b.org", "Z.net", "com"]
    paths = ["", "/", "/en", "/en/1", "/en/1/", "/english", "/de?x=/en"]
    captures = [(k, f"http{'s' * (k % 2)}://{rng.choice(hosts)}{rng.choice(paths)}", T0 + timedelta(hours=rng.randrange(0, 9000))) for k in range(400)]
    captures += [(1000, None, T0), (1001, "nonsense", T0), (1002, "http://a.com/en", None), (1002, "http://a.com/en", None), (None, "http://u:p@a.com:8/en#f", T0)]
    patterns = ["a.com", "b.org", "com", "x.a.com", "a.com/en", "www.a.com/en/1", "z.net/en", "B.org/en/"]
    events = [(rng.choice("pqr"), rng.choice(patterns), rng.choice(["add", "remove"]), T0 + timedelta(hours=rng.randrange(-900, 9900))) for _ in range(120)]
    events += [("p", "a.com", "add", T0 + timedelta(hours=50)), ("p", "a.com", "remove", T0 + timedelta(hours=50)), (None, "a.com", "add", T0), ("q", None, "add", T0)]
    frame = spark.createDataFrame([(*c, "host") for c in captures], "page_id long, url string, fetched_at timestamp, host string")
    log = spark.createDataFrame(events, "list string, pattern string, action string, at timestamp")
    found = url_lists.active_entries(frame, log).collect()
    assert found[0].__fields__ == ["page_id", "url", "fetched_at", "host", "lists"]
    want = sorted((repr(c), names) for c, names in zip(captures, brute(captures, events), strict=True))
    assert sorted((repr(tuple(r)[:3]), r["lists"]) for r in found) == want
    assert any(names for _, names in want)
    left = url_lists.drop_listed(frame.select("page_id", "url", "fetched_at"), log)
    assert left.count() == sum(not names for _, names in want)


def test_empty_sides(spark):
    frame = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    log = spark.createDataFrame([], "list string, pattern string, action string, at timestamp")
    assert url_lists.active_entries(frame, log).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/", T0)], frame.schema)
    assert url_lists.active_entries(one, log).first()["lists"] == []


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "shuffle"])
def test_many_entries_a_hot_host_and_far_times(spark, monkeypatch, limit):
    """100,000 entries and one that is toggled every minute, a host with most captures, captures in years 1700 and 9999."""
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(11)
    toggles = [("hot", "busy.org", "add" if k % 2 == 0 else "remove", T0 + timedelta(minutes=k)) for k in range(5000)]
    many = [(f"l{k % 9}", f"s{k // 9}.net", rng.choice(["add", "remove"]), T0 + timedelta(minutes=rng.randrange(10_000))) for k in range(2000)]
    events = toggles + many + [("far", "s7.net", "add", T0), ("deep", "busy.org/a/b", "add", T0 + timedelta(days=1))]
    captures = [(k, f"http://x.busy.org/{k % 7}", T0 + timedelta(seconds=rng.randrange(400_000))) for k in range(1500)]
    captures += [(2000 + k, f"http://s{rng.randrange(240)}.net/", T0 + timedelta(minutes=rng.randrange(-10, 11_000))) for k in range(300)]
    captures += [(3000, "http://s7.net/", datetime(9999, 1, 1)), (3001, "http://s7.net/", datetime(1700, 1, 1))]
    captures += [(3002, "http://busy.org" + "/a/b" * 20_000, T0 + timedelta(days=3)), (3003, "http://" + "busy.org." * 3000 + "busy.org/", T0 + timedelta(minutes=2))]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp")
    log = spark.createDataFrame(events, "list string, pattern string, action string, at timestamp")
    wide = spark.range(100_000).selectExpr("'wide' AS list", "concat('w', id, '.com') AS pattern", "'add' AS action", "timestamp'2024-01-02' AS at")
    got = {r["page_id"]: r["lists"] for r in url_lists.active_entries(frame, log.unionByName(wide)).collect()}
    by_name: dict[tuple, list] = {}
    for name, pattern, action, at in events:
        by_name.setdefault((name, pattern), []).append((at, action))

    def state(key: tuple, at: datetime) -> bool:
        past = [e for e in by_name[key] if e[0] <= at]
        last = max((e[0] for e in past), default=None)
        return last is not None and all(e[1] == "add" for e in past if e[0] == last)

    for page_id, url, at in captures:
        host, path = url[7:].partition("/")[::2]
        want = set()
        for name, pattern in by_name:
            domain, slash, rest = pattern.partition("/")
            inside = (host == domain and f"{path}/".startswith(f"{rest}/")) if slash else (host == domain or host.endswith("." + domain))
            if inside and state((name, pattern), at):
                want.add(name)
        assert got[page_id] == sorted(want), page_id
    assert got[3000] and not got[3001] and "deep" in got[3002] and got[3003] == ["hot"]


def test_query_equals_its_sql(spark, sf_dir):
    found = url_lists.query(spark, sf_dir)
    assert found.where("lists LIKE '%auto%'").count() > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    cursor = con.execute(url_lists.ORACLE_SQL["op6_url_lists"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())
