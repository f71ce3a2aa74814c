"""Changes followed in keyed state against batch diffs."""

import datetime as dt
import random

import pytest

from tessella.operators.diff import snapshot_diff
from tessella.streaming import keyed

EVENTS = "path string, hash string, at timestamp"
START = dt.datetime(2026, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Writes batches of (path, hash, minutes) and runs after each; gives the changes of each run."""
    source, table, checkpoint = (str(tmp_path / x) for x in ("source", "table", "checkpoint"))

    def run(batches, **options):
        table_of = lambda: [tuple(r) for r in spark.read.schema(f"{keyed.CHANGES}, batch int").option("recursiveFileLookup", "true").parquet(table).drop("batch").collect()]
        out, before = [], []
        for rows in batches:
            spark.createDataFrame([(p, h, START + dt.timedelta(minutes=m)) for p, h, m in rows], EVENTS).write.mode("append").parquet(source)
            keyed.store(keyed.track(spark.readStream.schema(EVENTS).parquet(source), **options), table, checkpoint)
            after = table_of()
            new = list(after)
            for r in before:
                new.remove(r)
            out.append(sorted((p, s, h or "") for p, s, h in new))
            before = after
        return out

    return run


def test_equals_batch_diffs_over_restarts(spark, stream):
    r = random.Random(2)
    states, batches = [{}], []
    for n in range(3):
        now = dict(states[-1])
        rows = []
        for k in r.sample(range(30), 18):
            h = r.choice([None, "a", "b", "c"])
            rows.append((f"f{k}", h, n * 60 + k))
            now.pop(f"f{k}", None)
            if h:
                now[f"f{k}"] = h
        batches.append(rows)
        states.append(now)
    got = stream(batches)
    schema = "path string, hash string"
    for before, after, found in zip(states, states[1:], got, strict=False):
        diff = snapshot_diff(spark.createDataFrame(list(before.items()), schema), spark.createDataFrame(list(after.items()), schema)).where("status <> 'unchanged'")
        assert found == sorted((d.path, d.status, after.get(d.path, "")) for d in diff.collect())


def test_the_last_event_of_a_batch_counts(stream):
    got = stream([[("a", "1", 0), ("a", "2", 5), ("b", "1", 0), ("b", None, 1), ("c", None, 3), ("c", "9", 3), (None, "1", 0)], [("a", "2", 9), ("c", None, 9), ("d", None, 9)]])
    assert got == [[("a", "added", "2"), ("c", "added", "9")], [("c", "deleted", "")]]


def test_silence_deletes(stream):
    got = stream([[("a", "1", 0), ("b", "1", 0)], [("a", "1", 50)], [("z", "1", 100)], [("y", "1", 101)]], silence="60 minutes")
    assert got[0] == [("a", "added", "1"), ("b", "added", "1")] and got[1] == []
    later = [x for g in got[2:] for x in g]
    assert ("b", "deleted", "") in later and ("a", "deleted", "") not in later and ("z", "added", "1") in later
