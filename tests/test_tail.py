"""Logs that grow, rotate and are written to while they are read."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from tidewatch.sources.tail import tail_source
from tidewatch.streaming import jobs

HEADER = "mysqld, Version: 8.0 (log)\nTcp port: 3306\nTime  Id Command  Argument\n"


def block(n, text=None, use=""):
    at = f"2024-01-10T{n // 3600 % 24:02d}:{n // 60 % 60:02d}:{n % 60:02d}.{n % 1000:03d}000Z"
    return f"# Time: {at}\n# User@Host: a[a] @ h\n# Query_time: 2.{n:06d}  Lock_time: 0 Rows_sent: 1  Rows_examined: {n}\n{use}SET timestamp=1;\n{text or f'SELECT {n}'};\n"


def append(path, *parts):
    with open(path, "a") as file:
        file.write("".join(parts))


@pytest.fixture()
def follow(spark, tmp_path):
    """Runs the job over the folder `logs` from where it was left and returns the rows_examined of all events so far, in order."""
    (tmp_path / "logs").mkdir()

    def run(quiet_seconds=1e9, **more):
        jobs.stream_slow_log(
            spark, folder=f"{tmp_path}/logs/slow.log*", out=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp", instance_id="i",
            quiet_seconds=quiet_seconds, **more,
        ).awaitTermination()
        return sorted(r["rows_examined"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    return run, tmp_path / "logs" / "slow.log"


def test_appended_blocks_come_once_and_half_written_ones_wait(spark, follow):
    run, log = follow
    append(log, HEADER)
    assert run() == []
    append(log, block(1), block(2), block(3)[:60])
    assert run() == [1, 2]
    append(log, block(3)[60:])
    assert run() == [1, 2]  # nothing tells yet that it is complete
    append(log, block(4), block(5)[:20])
    assert run() == [1, 2, 3, 4][:4]
    append(log, block(5)[20:])
    assert run(quiet_seconds=0) == [1, 2, 3, 4, 5]
    assert run(quiet_seconds=0) == [1, 2, 3, 4, 5]


def test_a_renamed_log_is_read_on_and_the_new_one_from_its_start(spark, follow):
    run, log = follow
    append(log, HEADER, block(1), block(2), block(3))
    assert run() == [1, 2]
    append(log, block(4))
    os.rename(log, f"{log}.1")
    append(log, HEADER, block(11), block(12))
    assert run() == [1, 2, 3, 11]
    append(f"{log}.1", block(5))  # the server still writes to the file it has open
    append(log, block(13))
    assert run(quiet_seconds=0) == [1, 2, 3, 4, 5, 11, 12, 13]


def test_a_truncated_log_starts_anew(spark, follow):
    run, log = follow
    append(log, HEADER, block(1), block(2), block(3))
    assert run(quiet_seconds=0) == [1, 2, 3]
    log.write_text(HEADER + block(21))
    assert run(quiet_seconds=0) == [1, 2, 3, 21]
    log.write_text(HEADER + "".join(block(n) for n in range(31, 40)))  # shorter, then longer than before
    assert run(quiet_seconds=0) == [1, 2, 3, 21, *range(31, 40)]


def test_the_schema_in_force_is_carried_over_batches(spark, follow, tmp_path):
    run, log = follow
    append(log, HEADER, block(1, use="use shop;\n"), block(2))
    run(quiet_seconds=0)
    append(log, block(3))
    os.rename(log, f"{log}.1")
    append(f"{log}.1", block(4, use="use other;\n"))
    append(log, HEADER, block(5))
    run(quiet_seconds=0)
    append(f"{log}.1", block(6))
    run(quiet_seconds=0)
    got = {r["rows_examined"]: r["database_name"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "shop", 2: "shop", 3: "shop", 4: "other", 5: None, 6: "other"}


@pytest.mark.parametrize("split", [7, 64, 150, 1000])
def test_ranges_of_any_size_give_each_block_once(spark, follow, split):
    run, log = follow
    texts = {n: f"SELECT '{'é' * (n % 5)}',\n{n}\n# a note\n FROM t{n}" for n in range(1, 30)}
    append(log, HEADER, *[block(n, t) for n, t in texts.items()])
    assert run(quiet_seconds=0, split_bytes=split) == list(texts)


def test_latest_leaves_out_what_is_there(spark, follow):
    run, log = follow
    append(log, HEADER, block(1), block(2), block(3)[:50])
    args = dict(quiet_seconds=1e9, start="latest")
    append(log, "")
    try:
        run(**args)
    except Exception:  # noqa: BLE001  (nothing was written yet, so there is no output to read)
        pass
    append(log, block(3)[50:], block(4))
    assert run(**args) == [3]


def test_an_uncommitted_batch_is_read_again_and_lost_bytes_are_an_error(tmp_path):
    log = tmp_path / "slow.log"
    append(log, HEADER, block(1), block(2))
    source = tail_source()
    options = {"path": f"{tmp_path}/slow.log*", "quiet_seconds": "0"}
    first = source(options).streamReader(None)
    end = first.latestOffset()
    os.rename(log, f"{log}.1")
    again = source(options).streamReader(None)
    rows = [row for part in again.partitions({}, end) for batch in again.read(part) for row in batch.to_pylist()]
    assert [r["value"][:7] for r in rows] == ["mysqld,", "# Time:", "# Time:"] and all(r["file_path"].endswith(".1") for r in rows)
    os.remove(f"{log}.1")
    with pytest.raises(OSError):
        source(options).streamReader(None).partitions({}, end)
    gone = again.latestOffset()
    assert list(gone) == list(end) and not again.partitions(end, gone)
    append(log, HEADER, block(1), block(2), block(3))  # back under its first name
    back = again.latestOffset()
    assert [r["block_start"] for part in again.partitions(gone, back) for b in again.read(part) for r in b.to_pylist()] == [list(end.values())[0]["bytes"]]


def test_the_source_travels_without_the_package():
    load = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(tail_source()), cwd="/", check=True, timeout=60)
