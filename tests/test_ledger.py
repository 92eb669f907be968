"""Many writers of one ledger."""

import os
import threading
import uuid

from gapline.plans.ledger import EVENTS, Ledger, NumberedLog


def test_writers_share_numbers(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    books = [Ledger(spark, name) for _ in range(8)]
    start = threading.Barrier(8)

    def run(k):
        start.wait()
        for i in range(25):
            books[k].log_event(f"{k}_{i}", parameters={"é": i})
            if i % 5 == 0:
                books[k].save_artifact(f"step{i}", f"{k}")

    threads = [threading.Thread(target=run, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = books[0].history(1000).collect()
    assert [r.id for r in rows] == list(range(200, 0, -1))
    assert {r.operation for r in rows} == {f"{k}_{i}" for k in range(8) for i in range(25)}
    for k in range(8):  # a writer's own events stay in order
        own = [int(r.operation.split("_")[1]) for r in reversed(rows) if r.operation.startswith(f"{k}_")]
        assert own == list(range(25))
    assert [r.step for r in books[3].artifacts().collect()] == sorted(f"step{i}" for i in range(0, 25, 5))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_entries_that_were_not_finished_are_not_seen(spark, tmp_path):
    log = NumberedLog(spark, f"file://{tmp_path}/log")
    assert log.last() == 0 and log.read(EVENTS).count() == 0
    (tmp_path / "log" / "_left").write_text('{"id": 9, "operation": "half')
    assert log.append({"operation": "a\n\"b\""}, "id") == 1 and log.append({"operation": "c"}, "id") == 2
    assert sorted((r.id, r.operation) for r in log.read(EVENTS).collect()) == [(1, 'a\n"b"'), (2, "c")]


def test_entries_by_renaming_where_there_are_no_links(spark, tmp_path):
    log = NumberedLog(spark, f"file://{tmp_path}/log")
    log.local = None  # as on a store that only Spark reaches
    assert [log.append({"operation": x}, "id") for x in "ab"] == [1, 2]
    other = NumberedLog(spark, f"file://{tmp_path}/log")
    other.local, other.last = None, lambda: 0  # it hasn't seen the others' entries
    assert other.append({"operation": "c"}, "id") == 3
    assert sorted((r.id, r.operation) for r in log.read(EVENTS).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert not [f for f in os.listdir(tmp_path / "log") if f.startswith("_")]
