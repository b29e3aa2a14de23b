"""Log files that grow and rotate, as a stream of whole blocks.

A file stream takes a file once, as it is when it is first seen. A slow log, in contrast, is appended to for as long as its server
runs, and then renamed or truncated. The source below follows such files: its offset holds, for each log, how many bytes of it were
handed out, and a micro-batch covers the blocks between two offsets, so that each block comes exactly once, also after a restart.

* A log is known by what it begins with, not by its name: the folder, and all bytes up to the end of the header of its first block (which holds
  the time and the figures of that statement). A renamed log is therefore read on from where it was left, and a new or truncated
  file under an old name is a new log.
* Blocks are cut at lines that begin with `# Time:`. The last block of a log may still be written to: it waits until another one follows, or
  until the file has not changed for `quiet_seconds`.
* Ranges of at most `split_bytes` go to different tasks; a block belongs to the range it begins in.

Files are reached through `pyarrow.fs`, thus by local or mounted paths and by the URIs it knows (s3, hdfs, gs). Compressed logs are left out by
the pattern. Only what is at the ends of files is read by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = "slow_log_tail"
SCHEMA = "value string, file_path string, file_id string, file_block_start bigint, block_start bigint"


def tail_source():
    """The data source class. It is made inside a function so that it travels to the executors by value, without this package."""
    import fnmatch
    import hashlib
    import time

    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    start_mark, first_mark, chunk, most_header = b"\n# Time:", b"# Time:", 1 << 20, 1 << 18

    class Range(InputPartition):
        def __init__(self, path: str, file_id: str, low: int, high: int, first: int, last: int):
            self.path, self.file_id, self.low, self.high, self.first, self.last = path, file_id, low, high, first, last

    def opened(path: str):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)

    def identity(file, size: int, folder: str) -> str | None:
        """What a log is known by; None until the header of its first block is complete."""
        head, need = b"", 1 << 12
        while True:
            head = file.read_at(min(need, size), 0)
            at = 0 if head.startswith(first_mark) else head.find(start_mark) + 1
            if at or head.startswith(first_mark):
                while head.startswith(b"#", at):  # header lines of the first block
                    line = head.find(b"\n", at)
                    if line < 0:
                        break
                    at = line + 1
                else:
                    if at < len(head):
                        return hashlib.sha1(folder.encode() + b"\0" + head[:at]).hexdigest()
            if need >= size or need >= most_header:
                return None
            need *= 4

    def last_start(file, size: int) -> int:
        """Where the last block begins; 0 if the first one does."""
        high = size
        while high > 0:
            low = max(0, high - chunk)
            at = file.read_at(min(size, high + len(start_mark)) - low, low).rfind(start_mark)
            if at >= 0:
                return low + at + 1
            high = low
        return 0

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.pattern = options["path"]
            self.quiet = float(options.get("quiet_seconds", "30"))
            self.split = int(options.get("split_bytes", str(64 << 20)))
            self.latest_first = options.get("start", "earliest") == "latest"
            self.keep = float(options.get("remember_hours", "48")) * 3600
            self.known: dict[str, dict] = {}
            self.floor: dict[str, int] = {}
            self.missing: dict[str, float] = {}
            self.cache: dict[str, tuple] = {}

        def files(self):
            """(uri, folder, size, modified) of the files the pattern names."""
            fixed = self.pattern.split("*")[0].split("?")[0].split("[")[0]
            root = fixed if fixed == self.pattern else fixed.rsplit("/", 1)[0]
            system, inner = fs.FileSystem.from_uri(root)
            prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
            wanted = inner + self.pattern[len(root):]
            infos = system.get_file_info(fs.FileSelector(inner, recursive=True)) if root != self.pattern else system.get_file_info([inner])
            if root == self.pattern and infos[0].type == fs.FileType.Directory:
                wanted, infos = f"{inner.rstrip('/')}/*", system.get_file_info(fs.FileSelector(inner))
            for info in infos:
                hidden = info.path.rsplit("/", 1)[-1].startswith((".", "_"))
                if info.type == fs.FileType.File and not hidden and fnmatch.fnmatchcase(info.path, wanted):
                    yield prefix + info.path, info.path.rsplit("/", 1)[0], info.size, info.mtime_ns or 0

        def listing(self) -> dict:
            found: dict[str, dict] = {}
            cache, now = {}, time.time()
            for uri, folder, size, modified in self.files():
                quiet = modified / 1e9 + self.quiet <= now
                entry = self.cache.get(uri)
                if entry is None or entry[0] != (size, modified, quiet):
                    with opened(uri) as file:
                        name = identity(file, size, folder)
                        end = 0 if name is None else size if quiet else last_start(file, size)
                    entry = ((size, modified, quiet), name, end)
                cache[uri] = entry
                _, name, end = entry
                if name is not None and (name not in found or end > found[name]["bytes"]):
                    found[name] = {"path": uri, "bytes": end}
            self.cache = cache
            return found

        def initialOffset(self):
            return self.listing() if self.latest_first else {}

        def latestOffset(self):
            found, now = self.listing(), time.time()
            for name, entry in self.known.items():
                if name in found:
                    self.missing.pop(name, None)
                    if found[name]["bytes"] < entry["bytes"]:
                        found[name] = {**found[name], "bytes": entry["bytes"]}
                elif now - self.missing.setdefault(name, now) < self.keep:
                    found[name] = {**entry, "gone": True}  # should it be listed again, it is read on, not anew
            self.known = found
            return found

        def partitions(self, start, end):
            for name, entry in start.items():
                self.floor[name] = max(entry["bytes"], self.floor.get(name, 0))
                self.known.setdefault(name, entry)
            for name, entry in end.items():
                self.known.setdefault(name, entry)
            parts = []
            for name, entry in end.items():
                first, last = start[name]["bytes"] if name in start else self.floor.get(name, 0), entry["bytes"]
                if last <= first or entry.get("gone"):
                    continue
                path = self.where(name, entry["path"], last)
                count = max(1, -(-(last - first) // self.split))
                cuts = [first + (last - first) * i // count for i in range(count + 1)]
                parts += [Range(path, name, low, high, first, last) for low, high in zip(cuts, cuts[1:])]
            return parts

        def where(self, name, path, last) -> str:
            """The path a log has now: it may have been renamed after the offset was taken."""
            for uri, folder, size, _ in sorted(self.files(), key=lambda f: f[0] != path):
                if size >= last:
                    with opened(uri) as file:
                        if identity(file, size, folder) == name:
                            return uri
            raise OSError(f"log {path} is gone before its bytes up to {last} were read")

        def read(self, part):
            with opened(part.path) as file:
                yield from batches(file, part)

        def commit(self, end):
            pass

    def blocks(file, part):
        """(start, bytes) of the blocks that begin in the range."""
        at, buffer, begin = part.low, b"", part.low
        if part.low > part.first:
            at = begin = part.low - 1
            while True:  # skip what belongs to the range before
                more = file.read_at(min(chunk, part.last - at), at)
                buffer += more
                at += len(more)
                hit = buffer.find(start_mark)
                if hit >= 0:
                    begin, buffer = begin + hit + 1, buffer[hit + 1 :]
                    break
                if at >= part.last or begin >= part.high:
                    return
                keep = len(start_mark) - 1
                begin, buffer = begin + max(0, len(buffer) - keep), buffer[-keep:]
        while True:
            *whole, buffer = buffer.split(start_mark)
            for i, block in enumerate(whole):
                if begin >= part.high:
                    return
                block = first_mark + block if i else block
                yield begin, block
                begin += len(block) + 1
            if whole:
                buffer = first_mark + buffer
            if begin >= part.high:
                return
            if at >= part.last:
                if buffer:
                    yield begin, buffer
                return
            more = file.read_at(min(chunk, part.last - at), at)
            buffer += more
            at += len(more)

    def batches(file, part):
        schema = pa.schema([("value", pa.string()), ("file_path", pa.string()), ("file_id", pa.string()),
                            ("file_block_start", pa.int64()), ("block_start", pa.int64())])

        def batch(rows):
            text = [b.decode("utf-8", "replace") for _, b in rows]
            n = len(rows)
            columns = [text, [part.path] * n, [part.file_id] * n, [part.low] * n, [s for s, _ in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

        rows, size = [], 0
        for row in blocks(file, part):
            rows.append(row)
            size += len(row[1])
            if len(rows) >= 5000 or size >= 4 * chunk:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    class SlowLogTail(DataSource):
        @classmethod
        def name(cls):
            return "slow_log_tail"

        def schema(self):
            return "value string, file_path string, file_id string, file_block_start bigint, block_start bigint"

        def streamReader(self, schema):
            return Reader(self.options)

    return SlowLogTail


def tail_blocks(spark: SparkSession, path: str, *, start="earliest", quiet_seconds: float = 30, split_bytes: int = 64 << 20) -> DataFrame:
    """A stream of the blocks of the logs at `path` (a folder, a file or a pattern with `*`), in the columns of `SCHEMA`.

    file_id names the log whatever its file is called; file_block_start is where the range of the task begins, block_start where the
    block does. start="latest" leaves out what the logs hold when the stream starts for the first time.
    """
    spark.dataSource.register(tail_source())
    return (
        spark.readStream.format(NAME).option("path", path).option("start", start)
        .option("quiet_seconds", str(quiet_seconds)).option("split_bytes", str(split_bytes)).load()
    )
