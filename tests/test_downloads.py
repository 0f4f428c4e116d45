"""Downloads with a state for each item: retries, dead letters, limits, and a job that is killed and started again."""

import os
import re
import time
from collections import Counter, defaultdict

import pytest

from vecatlas.operators import ingest
from vecatlas.streaming import downloads


def post(spark, inbox, rows):
    spark.createDataFrame(rows, "id int, primaryImage string").coalesce(1).write.mode("append").parquet(inbox)


def requests(place):
    """When each address was asked for."""
    folder = f"{place}/server"
    return {n: [float(x) for x in open(os.path.join(folder, n))] for n in os.listdir(folder)}


def test_waits_double_and_spread():
    waits = [downloads.wait_ms(i, k, 2.0, 30.0) for i in range(50) for k in range(1, 9)]
    for n, w in enumerate(waits):
        whole = 1000 * min(30.0, 2.0 * 2 ** (n % 8))
        assert 0.75 * whole - 1 <= w <= 1.25 * whole
    assert len(set(waits[::8])) > 25 and downloads.wait_ms(1, 5000, 2.0, 30.0) <= 37_500


@pytest.fixture
def place(tmp_path):
    for d in ("inbox", "server", "stored"):
        (tmp_path / d).mkdir()
    return tmp_path


def job(spark, place, **options):
    server, stored = str(place / "server"), str(place / "stored")

    def fetcher(url):
        """Fails as the address says (http://h/7?fail=2: the first two times) and notes each request."""
        log = os.path.join(server, re.sub(r"\W", "_", url))
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        told = re.search(r"(fail|limit)=(\d+)", url)
        if told and sum(1 for _ in open(log)) <= int(told[2]):
            raise ingest.RateLimited("status 429") if told[1] == "limit" else OSError("status 503")
        return url.encode()

    def store(key, data):
        with open(os.path.join(stored, key.replace("/", "_")), "wb") as f:
            f.write(data)

    options = {"first": 0.3, "most": 3, "every": "200 milliseconds"} | options
    return downloads.download_job(spark, f"{place}/inbox", f"{place}/results", f"{place}/checkpoint", fetcher, store, **options)


def test_retries_dead_letters_and_repeats(spark, place):
    rows = [(1, "http://h/1"), (2, "http://h/2?fail=1"), (3, "http://h/3?fail=2"), (4, "http://h/4?fail=3"), (5, None), (6, ""), (None, "http://h/none"), (1, "http://h/1")]
    post(spark, f"{place}/inbox", rows)
    post(spark, f"{place}/inbox", [(1, "http://h/1"), (2, "http://h/2?fail=1"), (7, "http://h/7")])
    assert downloads.wait_until_settled(job(spark, place, files_per_batch=1), spark, f"{place}/results", pause=0.3, timeout=120)
    events = downloads.events_of(spark, f"{place}/results")
    found = {r["id"]: (r["status"], r["attempts"]) for r in downloads.outcomes(events).collect()}
    assert found == {1: ("done", 1), 2: ("done", 2), 3: ("done", 3), 4: ("dead", 3), 7: ("done", 1)}
    times = requests(place)
    assert {n: len(t) for n, t in times.items()} == {"http___h_1": 1, "http___h_2_fail_1": 2, "http___h_3_fail_2": 3, "http___h_4_fail_3": 3, "http___h_7": 1}
    a, b, c = times["http___h_3_fail_2"]
    assert b - a > 0.2 and c - b > 0.4  # three quarters of 0.3 and of 0.6 seconds at least
    assert {r["error"] for r in events.where("status in ('retry', 'dead')").collect()} == {"OSError: status 503"}
    # a dead letter comes back with another address only
    post(spark, f"{place}/inbox", [(4, "http://h/4?fail=3"), (1, "http://h/other")])
    post(spark, f"{place}/inbox", [(4, "http://h/moved")])
    assert downloads.wait_until_settled(job(spark, place), spark, f"{place}/results", pause=0.3, timeout=120)
    last = {r["id"]: r for r in downloads.outcomes(downloads.events_of(spark, f"{place}/results")).collect()}
    assert (last[4]["status"], last[4]["attempts"], last[4]["url"]) == ("done", 1, f"{ingest.PUBLIC_BASE}/artworks/4.jpg")
    assert len(requests(place)["http___h_4_fail_3"]) == 3 and "http___h_other" not in requests(place)
    assert open(place / "stored" / "artworks_4.jpg").read() == "http://h/moved"


def test_a_limit_is_not_an_attempt(spark, place):
    post(spark, f"{place}/inbox", [(i, f"http://h/{i}?limit=2") for i in range(8)])
    assert downloads.wait_until_settled(job(spark, place, most=1), spark, f"{place}/results", pause=0.3, timeout=120)
    events = downloads.events_of(spark, f"{place}/results").collect()
    last = {r["id"]: (r["status"], r["attempts"]) for r in downloads.outcomes(downloads.events_of(spark, f"{place}/results")).collect()}
    assert last == {i: ("done", 1) for i in range(8)}
    assert {r["error"] for r in events if r["status"] == "limited"} <= {"RateLimited: status 429", "RateLimited: not tried"}
    # in a batch each task (of four) asks once more at most after it was told to stop
    per_batch = Counter(r["batch"] for r in events if r["error"] == "RateLimited: status 429")
    assert max(per_batch.values()) <= 4


def test_killed_and_started_again(spark, place):
    """No item's attempt is twice in the results, and none is lost."""
    rows = [(i, f"http://h/{i}?fail={i % 3}") for i in range(40)]
    for k in range(4):
        post(spark, f"{place}/inbox", rows[10 * k : 10 * k + 10])
    broken = job(spark, place, files_per_batch=1)
    end = time.monotonic() + 60
    while time.monotonic() < end and not (os.path.exists(f"{place}/results/batch=1") and broken.lastProgress):
        time.sleep(0.05)
    broken.stop()  # in the middle of a batch, with timers running
    # as if the last batch had been written and its commit lost
    commits = sorted((int(n) for n in os.listdir(place / "checkpoint" / "commits") if n.isdigit()))
    os.remove(place / "checkpoint" / "commits" / str(commits[-1]))
    crc = place / "checkpoint" / "commits" / f".{commits[-1]}.crc"
    if crc.exists():
        os.remove(crc)
    assert downloads.wait_until_settled(job(spark, place, files_per_batch=1), spark, f"{place}/results", pause=0.3, timeout=120)
    tries = defaultdict(list)
    for r in downloads.events_of(spark, f"{place}/results").orderBy("batch").collect():
        tries[r["id"]].append((r["status"], r["attempts"]))
    assert set(tries) == set(range(40))
    for i, seen in tries.items():
        assert [a for _, a in seen] == list(range(1, len(seen) + 1)) and [s for s, _ in seen[:-1]] == ["retry"] * (len(seen) - 1) and seen[-1][0] == "done"
        assert len(seen) <= i % 3 + 1
