"""WARC archives and their index, merged externally.

Pages become WARC/1.1 records in gzip files in the shared folder, written and
read by Spark, so the files can lie in any store that Spark reaches.  Of the
pages with the same payload of at least ``MIN_REVISIT`` bytes, the one with the
largest page_id is a response and the others are revisits that refer to it.

Reading an archive gives its run: one index entry for each record, sorted by
URL key and timestamp.  Runs are stored; ranges of keys are dealt to tasks, and
each task holds one range, of about ``RANGE_RECORDS`` entries, and merges its
pieces of all runs with a loser tree.  Entries carry their
range and place, so their order is global: the captures of a URL stand together
in time order.  Ranges split by timestamp, page_id and record, so a URL with a
third of all captures is spread over tasks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.store import cut, new_path, ship

MIN_REVISIT = 1000      #: bytes; smaller payloads are always responses
FILE_RECORDS = 5000     #: records in an archive file, at most
RANGE_RECORDS = 100_000  #: entries that a task merges, on average

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"        #: between records
FIRST_DAY = 946_684_800  #: 2000-01-01; without a capture time, page_id counts seconds from here


# -- writing ------------------------------------------------------------------------------------


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def with_decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, n, digest, refers_to): size and digest of the payload, and the response that a revisit refers to."""
    time = [F.col("captured").cast("timestamp").alias("captured")] if "captured" in pages.columns else []
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         _payload().alias("html"), F.octet_length(_payload()).cast("long").alias("n"),
                         F.sha1(_payload()).alias("digest"), *time)
    # one row for each repeated payload; copies are counted before the shuffle
    repeated = cut(sized.filter((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest")
                   .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
                   .filter("copies > 1").select("digest", "last"), "repeated")
    return (sized.join(repeated, "digest", "left")
            .withColumn("refers_to", F.when(F.col("page_id") != F.col("last"), F.col("last"))).drop("last"))


def _records(decided: DataFrame) -> DataFrame:
    """Each row's record as text, without the blank lines that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    seconds = F.timestamp_seconds(F.lit(FIRST_DAY) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    seconds = F.coalesce("captured", seconds) if "captured" in decided.columns else seconds
    date = F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.coalesce(page(F.col("page_id")), F.concat(F.lit("<urn:digest:"), F.col("digest"), F.lit(">")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("n")) + len(HTTP)
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name), line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", page(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)),
                                 line("X-Payload-Length", F.col("n").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")),
        F.lit("\r\n" + HTTP))
    return decided.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, file_records: int = FILE_RECORDS) -> str:
    """Write a record for each page into gzip files below ``path`` (a new shared folder by default)."""
    path = path or new_path(pages.sparkSession, "warc")
    (_records(with_decisions(pages)).write.option("compression", "gzip").option("lineSep", END)
     .option("maxRecordsPerFile", file_records).text(path))
    return path


# -- reading --------------------------------------------------------------------------------------


def _inflate(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Contents of a gzip file of any number of members, piece by piece."""
    while data:
        member = zlib.decompressobj(31)
        for at in range(0, len(data), step):
            yield member.decompress(data[at:at + step])
            if member.eof:
                data = member.unused_data + data[at + step:]
                break
        else:
            if not member.eof:
                raise ValueError("the archive ends in the middle of a gzip member")
            data = b""


def records(chunks: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, payload) of each record of an archive; one record is held at a time."""
    source, held, base = iter(chunks), bytearray(), 0

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends in a record's header")
            return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {base}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        if not fill(start + size + 4):
            raise ValueError(f"the record at byte {base} is cut off")
        block = bytes(held[start:start + size])
        http = block.find(b"\r\n\r\n")
        yield base, start + size, head, block[http + 4:] if http >= 0 else b""
        del held[:start + size + 4]
        base += start + size + 4


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then path and query, all in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def entry(offset: int, length: int, head: dict[str, str], payload: bytes) -> tuple:
    """Index entry of a record; checks a response's payload against its digest."""
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x.startswith("<urn:page:") else None
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:").lower()
    if len(digest) == 32 and not all(c in "0123456789abcdef" for c in digest):
        digest = base64.b32decode(digest.upper()).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {head.get('warc-record-id')} doesn't have its digest")
    size = int(head["x-payload-length"]) if kind == "revisit" else len(payload)
    return (url_key(head.get("warc-target-uri")), head.get("warc-date", ""), number(head.get("warc-record-id", "")), offset, length,
            kind, size, digest, number(head["warc-refers-to"]) if "warc-refers-to" in head else None)


_ENTRY = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()),
                    ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("number", pa.int64())])
_ENTRY_SQL = ("url_key string, captured string, page_id long, offset long, length long, record_type string, payload_bytes long, "
              "payload_digest string, refers_to long, archive string, number long")


def _order(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            own = sorted((entry(*r) for r in records(_inflate(content.as_py()))), key=_order)
            name = path.as_py().rpartition("/")[2]
            rows = [(*e, name, k) for k, e in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_ENTRY), _ENTRY)],
                                             schema=_ENTRY)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; the entries of an archive are a sorted run, counted by ``number``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_runs, _ENTRY_SQL)


# -- merging --------------------------------------------------------------------------------------


class LoserTree:
    """k-way merge of sorted lists of keys: each step compares along one path from a leaf to the root.

    Inner nodes hold the loser of their match, and slot 0 the winner of all;
    an exhausted list loses to every other.  Equal keys come in list order.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for leaf in range(len(runs)):
            self._play(leaf, start=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, leaf: int, start: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0 and start:      # the opponent hasn't come yet: wait here
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                winner, self.tree[node] = other, winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, position) of every key in merged order."""
        for _ in range(sum(map(len, self.runs))):
            run = self.tree[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), schema=_ENTRY)  # one range of the index
    if not table.num_rows:
        return
    table = table.combine_chunks().sort_by([("archive", "ascending"), ("number", "ascending")])  # pieces of a run in its order
    names = table.column("archive").to_pylist()
    keys = list(map(_order, zip(*(table.column(i).to_pylist() for i in range(4)))))
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
    runs = [keys[a:b] for a, b in zip(starts, starts[1:])]
    order = np.fromiter((starts[r] + i for r, i in LoserTree(runs)), np.int64, len(keys))
    part = TaskContext.get().partitionId()
    out = table.take(pa.array(order))
    out = out.append_column("range", pa.array(np.full(len(order), part), pa.int32()))
    yield from out.append_column("place", pa.array(np.arange(len(order)))).combine_chunks().to_batches()


def merge_runs(runs: DataFrame) -> DataFrame:
    """The entries of all runs in global order: by ``range``, then ``place``, they follow URL key and capture time."""
    ship(runs.sparkSession)
    n = max(1, -(-runs.count() // RANGE_RECORDS))  # a task holds one range, so their number follows the entries
    ranges = runs.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "number")
    return ranges.mapInArrow(_merged, _ENTRY_SQL + ", range int, place long")


def capture_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html and, if known, captured), read the archives back, and merge their index.

    One row for each row of ``pages``: url_key, captured, page_id, offset,
    length (both in the inflated archive), record_type, payload_bytes, payload_digest (of the full payload, also
    of a revisit), refers_to, archive, number, range, place.  Null html is an
    empty payload; a null url has an empty key.  Rows without a page_id are
    responses that no revisit refers to.  Repeated rows of the largest page_id
    are all responses.  An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = write_archives(pages, path)
    return merge_runs(cut(read_runs(spark, folder), "runs"))
