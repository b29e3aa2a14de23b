"""WARC archives of captures, and their index by an external merge.

Captures are written as WARC records (an HTTP response each) and read back by their lengths. A payload captured before is written as a
revisit that names its response. Each archive yields its captures as a run sorted by URL key and time; the runs are dealt out by ranges of
(URL key, time, page), so that one hot URL spreads over many tasks, and within a range they are merged by a loser tree. Ranges in order make one
globally ordered capture history.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import scratch, settled

END = "\r\n"
CAPTURE = (
    "run string, seq long, page_id long, url string, url_key string, captured_at string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload string"
)
ORDERED = ("url_key", "captured_at", "page_id")


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to). Of equal payloads of at least `least_bytes` bytes the one with
    the largest page_id is the response. Rows without page_id refer to it too; if none of a group has one, all are responses."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"),
    )
    # Only digests that repeat go on; they are merged on the map side, so a payload on a third of all pages is one row here.
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("payload_digest", "response")
    refers = F.when(F.col("response") != F.coalesce("page_id", F.col("response") - 1), F.col("response"))
    return rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to")
    )


def record(captured_at: Column) -> Column:
    """The WARC record of a row of `with_revisits`, without its closing empty lines."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(
        f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.octet_length(F.encode(http, "UTF-8")) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat_ws(
        END, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), captured_at), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    return F.concat(head, F.lit(END + END), http, F.when(revisit, F.lit("")).otherwise(F.col("html")))


def write_archives(captures: DataFrame, path: str, captured_at: Column, records_per_archive: int = 2000) -> None:
    """One gzip-compressed WARC file per `records_per_archive` records. The two empty lines after a record are the text writer's separator."""
    captures.select(record(captured_at).alias("value")).write.option("lineSep", END + END).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def url_key(url: str) -> str:
    """Host with its labels reversed and `www` left out, then path and query, in lower case; the fragment is dropped."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url)
    host = re.sub(r"^www[0-9]*\.", "", found[1].lower()) if found else ""
    rest = re.sub(r"#.*$", "", url[found.end() :] if found else url, flags=re.DOTALL)
    return ",".join(reversed(host.split("."))) + ")" + rest.lower()


def records_in(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, one at a time. A file cut short raises EOFError."""
    with gzip.open(io.BytesIO(archive)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError("no WARC record where one should start")
                continue
            headers = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = f.read(size)
            if len(block) < size:
                raise EOFError("record cut short")
            yield headers, block


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _capture(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not have the length and digest its record states")
    url = headers.get("warc-target-uri", "")
    return {
        "page_id": _number(headers["warc-record-id"]), "url": url, "url_key": url_key(url), "captured_at": headers["warc-date"],
        "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": _number(headers.get("warc-refers-to")),
        "payload": payload.decode("utf-8") if with_payload and kind == "response" else None,
    }


def _key(row: dict) -> tuple:
    return row["url_key"], row["captured_at"], row["page_id"] is not None, row["page_id"] or 0


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The captures of all archives below `path`, each archive a run (its file name) sorted by URL key, time and page."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                rows = sorted((_capture(h, b, with_payload) for h, b in records_in(content)), key=_key)
                frame = pd.DataFrame([{"run": path.rsplit("/", 1)[-1], "seq": i, **r} for i, r in enumerate(rows)], columns=names)
                yield frame.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes", "seq")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(read, CAPTURE)


class LoserTree:
    """Merges sorted lists. Inner nodes hold the list that lost there, so the next winner costs one walk from leaf to root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.lost = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._walk(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of list a goes before that of list b; ended lists go last, ties by number."""
        if self.at[a] >= len(self.runs[a]) or self.at[b] >= len(self.runs[b]):
            return self.at[b] >= len(self.runs[b]) and (self.at[a] < len(self.runs[a]) or a < b)
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _walk(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.lost[node]
            if other == -1:  # while the tree is built, the first to come waits for its opponent
                self.lost[node] = winner
                return
            if self._before(other, winner):
                self.lost[node], winner = winner, other
            node //= 2
        self.lost[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, position) in merged order."""
        while self.k and self.at[(top := self.lost[0])] < len(self.runs[top]):
            yield top, self.at[top]
            self.at[top] += 1
            self._walk(top)


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [p for p in parts if len(p)]
    if not rows:
        return
    frame = pd.concat(rows, ignore_index=True)  # ordered by run; a range has a bounded number of rows
    known = frame["page_id"].notna()
    keys = list(zip(frame["url_key"], frame["captured_at"], known, frame["page_id"].fillna(0)))
    starts = frame.index[frame["run"] != frame["run"].shift()].tolist() + [len(frame)]
    tree = LoserTree([keys[a:b] for a, b in zip(starts[:-1], starts[1:])])
    merged = frame.iloc[[starts[run] + i for run, i in tree]].reset_index(drop=True)
    merged["part"], merged["place"] = TaskContext.get().partitionId(), range(len(merged))
    yield merged


def merge_runs(captures: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """The captures with `position`: their place, from 1, in the order of URL key, time and page over all runs."""
    narrow = settled(captures.drop("payload"), "capture-runs")
    ranges = max(1, -(-narrow.count() // rows_per_range))
    dealt = narrow.repartitionByRange(ranges, *ORDERED).sortWithinPartitions("run", "seq")
    schema = ", ".join(c for c in CAPTURE.split(", ") if not c.startswith("payload string")) + ", part int, place long"
    merged = settled(dealt.mapInPandas(_merge, schema), "capture-history")
    sizes = merged.groupBy("part").count()  # a row per range
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return merged.join(before, "part").withColumn("position", F.col("before") + F.col("place") + 1).drop("part", "place", "before", "run", "seq")


def capture_index(pages: DataFrame, least_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write `pages` to archives (below `path`, or a new shared folder), read them back and merge their runs.

    Per row (page_id, url, url_key, captured_at, record_type, payload_bytes, payload_digest, refers_to, position). NULL html is an empty
    payload, a NULL url an empty one; NULL page ids stay NULL; repeated rows are captures of their own; rows that tie in URL, time and page
    take neighbouring positions. An empty table gives no rows. The table has no capture time; it is derived from page_id, a second per page.
    """
    path = path or scratch(pages.sparkSession, "archives")
    seconds = F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000))
    captured_at = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    write_archives(with_revisits(pages, least_bytes), path, captured_at)
    return merge_runs(read_archives(pages.sparkSession, path))
