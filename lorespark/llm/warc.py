"""WARC archives of pages, and the merge of their index runs into globally ordered capture histories."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import attach, group_map, map_bits, map_place, new_path, returned, table, with_flag, written

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Captures carry no time of their own in pages: each gets this second plus its page_id.
EPOCH = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 form of the SHA-1 digest: 8 groups of 20 bits, 4 characters each."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels in reverse order, joined by commas, then port, path and query in lower case, no fragment."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?|#.*$", "")
    host, rest = F.regexp_extract(plain, r"^[^/?:]*", 0), F.regexp_replace(plain, r"^[^/?:]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/") | rest.startswith(":"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _record_id(page: Column, row: Column) -> Column:
    """A record's id: a UUID by hash of the page and of its row, so that rows that repeat a page differ."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("none")), row.cast("string")))
    parts = [F.substring(h, begin, n) for begin, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_record) of each page.

    Of records with equal payloads of at least least_bytes bytes the one with the largest page_id is response and
    the others revisit it, rows that repeat that page_id included, but for one of them (pages is read more than once
    and must come in the same order, as files do). A null page_id is smaller
    than any other. Null html is an empty payload. Only pages whose payload another has, as a map of fixed size
    tells, are shuffled with their payload, and those of the largest groups not even then.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    key = ["payload_digest", "payload_bytes"]
    each = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy(*key, "page_id").agg(F.count("*").alias("n"), F.min("__row").alias("row"))
    groups = each.groupBy(*key).agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "n", "row")).alias("__last"), F.sum("n").alias("__n")).filter("__n > 1")
    groups = written(groups, "payloads")
    bits = map_bits(groups.count())
    rows = with_flag(rows, map_place(bits, *map(F.col, key)), group_map(groups, bits, *key), "__shared")
    columns = ["page_id", "url", "payload", *key]
    record, target = _record_id(F.col("page_id"), F.col("__row")), _record_id(F.col("__last.page_id"), F.col("__last.row"))
    shared = attach(rows.filter("__shared"), groups, key, "__n", pages.count())
    stays = F.col("page_id").eqNullSafe(F.col("__last.page_id")) & ((F.col("__last.n") == 1) | (F.col("__row") == F.col("__last.row")))
    is_revisit = F.col("__last").isNotNull() & ~stays
    shared = shared.select(*columns, F.when(is_revisit, "revisit").otherwise("response").alias("record_type"), F.when(is_revisit, F.col("__last.page_id")).alias("refers_to"), record.alias("record_id"), F.when(is_revisit, target).alias("refers_record"))
    alone = rows.filter("not __shared").select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), record.alias("record_id"), F.lit(None).cast("string").alias("refers_record"))
    return shared.unionByName(alone)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri_sent(url: Column) -> Column:
    """The URL as the header has it: with the line's end it must make no version line, so a last full stop there is
    percent-encoded, and a percent sign that would read as one that was."""
    kept = F.regexp_replace(F.regexp_replace(url, r"[\r\n]", ""), r"WARC/1%((?:25)*2E1)\z", "WARC/1%25$1")
    return F.regexp_replace(kept, r"WARC/1\.1\z", "WARC/1%2E1")


def _uri_read(sent: Column) -> Column:
    """What _uri_sent was given, line ends aside."""
    return F.regexp_replace(F.regexp_replace(sent, r"WARC/1%2E1\z", "WARC/1.1"), r"WARC/1%25((?:25)*2E1)\z", "WARC/1%$1")


def warc_records(typed: DataFrame) -> DataFrame:
    """One column, record: each row as a WARC record without the two line ends that close it.

    A response holds the HTTP message, a revisit its header alone. A payload that contains the version line
    itself, or does with the line end that follows it, is sent in chunks (Transfer-Encoding: chunked) that part it
    there, so that the line only ever starts a record and a reader may split archives at it.
    """
    is_revisit = F.col("record_type") == "revisit"
    parted = (F.col("payload").contains(VERSION) | F.col("payload").endswith(VERSION[:-2])) & ~is_revisit
    # Each version line is cut within, so no piece has one or ends in what a line end would make one.
    pieces = F.split("payload", r"(?<=WARC/1)(?=\.1(?:\r\n|\z))", -1)
    chunks = F.transform(pieces, lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit("\r\n"), x, F.lit("\r\n")))
    encoding = F.when(parted, F.concat(F.lit("Transfer-Encoding: chunked\r\n"), _header("X-Chunks", F.size(pieces).cast("string")))).otherwise(_header("Content-Length", F.col("payload_bytes").cast("string")))
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), encoding, F.lit("\r\n"))
    body = F.when(is_revisit, F.lit("")).when(parted, F.concat(F.array_join(chunks, ""), F.lit("0\r\n\r\n"))).otherwise(F.col("payload"))
    block = F.concat(message, body)
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        F.coalesce(_header("Page-ID", F.col("page_id").cast("string")), F.lit("")),
        _header("WARC-Date", date),
        F.coalesce(_header("WARC-Target-URI", _uri_sent(F.col("url"))), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _header("WARC-Refers-To", F.col("refers_record")), F.coalesce(_header("Refers-To-Page-ID", F.col("refers_to").cast("string")), F.lit("")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return typed.select(record.alias("record"))


def write_archives(typed: DataFrame, path: str) -> None:
    """The records as archives under path, a file per task; any store that Spark writes to will do."""
    warc_records(typed).write.option("lineSep", END).text(path)


def _unchunked(sent: Column, chunks: Column) -> Column:
    """The body that was sent in so many chunks: sizes in hex lead, line ends follow."""
    data = sent.cast("binary")

    def take(acc: Column, _: Column) -> Column:
        line = F.substring_index(F.substring(data, acc["at"], F.lit(20)).cast("string"), "\r\n", 1)
        size, begins = F.conv(line, 16, 10).cast("int"), acc["at"] + F.length(line) + 2
        return F.struct((begins + size + 2).alias("at"), F.concat(acc["out"], F.substring(data, begins, size)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), chunks), F.struct(F.lit(1).alias("at"), F.lit(b"").alias("out")), take)["out"].cast("string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, timestamp, record_type, refers_to, payload, payload_bytes, payload_digest, archive) of each record.

    For archives that write_archives() wrote: they are split at version lines, so large ones are read by many tasks. The size and digest of a response
    are those of the payload read; those of a revisit are what its headers say. A page without id or URL has null
    there; records that repeat stay; no archives give no rows.
    """
    rows = spark.read.option("lineSep", VERSION).text(path).filter("value <> ''").select("value", F.col("_metadata.file_name").alias("archive"))

    def split_off(df: DataFrame, source: str, head: str, rest: str) -> DataFrame:
        df = df.withColumn(head, F.substring_index(source, END, 1))
        return df.withColumn(rest, F.substring(F.col(source), F.length(head) + len(END) + 1, F.length(source))).drop(source)

    rows = split_off(split_off(rows, "value", "head", "block"), "block", "message", "sent")
    said = lambda column, name, pattern: F.regexp_extract(column, rf"(?:^|\r\n){name}: {pattern}(?:\r\n|$)", 1)
    number = lambda text, kind="long": F.expr(f"try_cast({text} as {kind})")
    line = r"([^\r\n]*)"
    rows = rows.select(
        "archive", "sent",
        said("head", "WARC-Type", line).alias("record_type"),
        said("head", "Page-ID", r"(-?\d+)").alias("page"),
        said("head", "Refers-To-Page-ID", r"(-?\d+)").alias("target"),
        F.when(F.contains("head", F.lit("\r\nWARC-Target-URI: ")), _uri_read(said("head", "WARC-Target-URI", line))).alias("url"),
        F.unix_timestamp(said("head", "WARC-Date", line), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        said("head", "WARC-Payload-Digest", r"sha1:([A-Z2-7]*)").alias("stated"),
        said("message", "Content-Length", r"(\d+)").alias("length"),
        said("message", "X-Chunks", r"(\d+)").alias("chunks"),
    )
    is_response = F.col("record_type") == "response"
    exact = F.substring(F.col("sent").cast("binary"), F.lit(1), number("length", "int")).cast("string")
    payload = F.when(is_response, F.when(F.col("chunks") != "", _unchunked(F.col("sent"), number("chunks", "int"))).otherwise(exact))
    rows = rows.withColumn("payload", payload)
    size = F.when(is_response, F.octet_length("payload").cast("long")).otherwise(number("length"))
    digest = F.when(is_response, base32_sha1(F.col("payload").cast("binary"))).otherwise(F.col("stated"))
    return rows.select(number("page").alias("page_id"), "url", "timestamp", "record_type", number("target").alias("refers_to"), "payload", size.alias("payload_bytes"), digest.alias("payload_digest"), "archive")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive's bytes, of any version; gzip members are unpacked one
    after another. Blocks are taken by their length, whatever they hold; a record that is cut off ends the archive."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield from records_of(member.decompress(data) + member.flush())
        data = member.unused_data
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", begin)
        if end < 0:
            return
        lines = re.sub(rb"\r\n[ \t]+", b" ", data[begin:end]).decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        at = end + 4 + int(size)
        yield headers, data[end + 4 : at]


def _payload(block: bytes) -> bytes:
    """The body of an HTTP message, unchunked; a block that is none is a payload itself."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not found:
        return block
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    out, at = [], 0
    while size := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
        n = int(size[1], 16)
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n + 2
        if n == 0:
            break
    return b"".join(out)


def read_foreign_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, url, date, record_type, refers_to, payload binary, payload_bytes, payload_digest, archive) of each
    response, resource and revisit record of archives of any origin: WARC/1.0 and 1.1, plain or of gzip members, binary payloads.

    A task reads one archive after another, each whole, as gzip allows no other way: archives of the usual gigabyte need
    executors that hold one. What was written here is read by read_archives() in parts. Headers that are missing are null.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "date", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "archive"]
        kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for headers, block in records_of(content):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    body = None if kind == "revisit" else _payload(block)
                    said = headers.get("warc-payload-digest", "").partition("sha1:")[2] or None
                    digest = said if body is None else base64.b32encode(hashlib.sha1(body).digest()).decode()
                    row = (headers.get("warc-record-id"), headers.get("warc-target-uri", "").strip("<>") or None, headers.get("warc-date"), kind, headers.get("warc-refers-to"), body, None if body is None else len(body), digest, path)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, "record_id string, url string, date string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, archive string")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path only."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = list(runs)
        k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * k
        for leaf in range(k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run a comes first; ended runs come last, ties by the number of the run."""
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.losers)) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # while building: the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.heads[top := self.losers[0]]) is not None:
            yield item
            self.heads[top] = next(self.runs[top], None)
            self._replay(top)


KEYS = ["url_key", "timestamp", "__id"]
#: Rows that a merge reads from a run, and returns, at once.
STEP = 8192


def index_runs(captures: DataFrame) -> DataFrame:
    """The captures' index entries: a table whose files are runs sorted by URL key and timestamp, then page_id."""
    entries = captures.drop("payload").withColumn("url_key", url_key(F.col("url"))).withColumn("__id", F.coalesce("page_id", F.lit(-(1 << 62))))
    return written(entries.sortWithinPartitions(*KEYS), "runs").withColumn("run", F.col("_metadata.file_name"))


def merged_histories(runs: DataFrame, ways: int = 256) -> DataFrame:
    """The entries of all runs in one order, with capture: the number of the capture in its URL's history, from 1.

    Ranges of keys cut all runs alike. A task gets its range's slices of the runs as they are, one after another and
    each in order, and merges them by a loser tree, in groups of at most `ways` first if there are more; nothing is
    sorted anew. It holds its range as Arrow columns and reads and returns some thousand rows at a time. A URL with a
    large part of all captures is parted by time; numbers are first given within a range, and what the URL has in
    earlier ranges, known from the first and last key of each range, is added. Within a range rows keep that order, and
    ranges are numbered in it.

    Captures without URL have the empty key, those without page_id come first of their second; equal entries keep
    the order of their runs; no runs give no rows.
    """
    ranged = runs.repartitionByRange(*KEYS)
    names = [*runs.columns, "number", "range"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, batch_schema)
        columns = [held.column(k) for k in KEYS]

        def rows(begin: int, end: int) -> Iterator[tuple]:
            for at in range(begin, end, STEP):
                n = min(STEP, end - at)
                yield from zip(*[c.slice(at, n).to_pylist() for c in columns], range(at, at + n), strict=True)

        cuts, last = [0], None
        for *key, at in rows(0, held.num_rows):
            if last is not None and key < last:
                cuts.append(at)
            last = key
        cuts.append(held.num_rows)
        slices: list[Iterator] = [rows(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(slices) > ways:
            slices = [iter(LoserTree(slices[i : i + ways])) for i in range(0, len(slices), ways)]

        def batch(order: list[int], numbers: list[int]) -> Iterator[pa.RecordBatch]:
            merged, at = held.take(pa.array(order, pa.int64())), TaskContext.get().partitionId()
            yield from merged.append_column("number", pa.array(numbers, pa.int64())).append_column("range", pa.array([at] * len(order), pa.int64())).to_batches()

        order, numbers, last, n = [], [], None, 0
        for key, _, _, at in LoserTree(slices):
            n = n + 1 if key == last else 1
            last = key
            order.append(at)
            numbers.append(n)
            if len(order) == STEP:
                yield from batch(order, numbers)
                order, numbers = [], []
        if order:
            yield from batch(order, numbers)

    batch_schema = to_arrow_schema(runs.schema)
    schema = StructType([*runs.schema.fields, *StructType.fromDDL("number long, range long").fields])
    merged = written(ranged.mapInArrow(returned(merge), schema).select(names), "merged")
    ends = merged.groupBy("range").agg(F.min("url_key").alias("head"), F.max(F.struct("url_key", "number")).alias("tail"))
    known = ends.select("range", F.col("tail.url_key").alias("key"), F.col("tail.number").alias("n"))
    known = known.unionByName(ends.filter("head <> tail.url_key").select("range", F.col("head").alias("key"), F.lit(0).cast("long").alias("n")))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = known.withColumn("start", earlier).filter("start > 0").drop("n")
    numbered = merged.join(F.broadcast(starts.withColumnRenamed("range", "r")), F.expr("range = r and url_key = key"), "left")
    return numbered.select(*[c for c in runs.columns if c not in ("__id", "run")], (F.col("number") + F.coalesce("start", F.lit(0))).alias("capture"), "range")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(with_record_types(table(spark, sf_dir, "pages")), path)
    histories = merged_histories(index_runs(read_archives(spark, path)))
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "capture")


#: The contract's columns; what the archives' index adds is left to tests.
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS url FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY sha1(payload)) AS last FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('{BASE32}', CAST((CAST('0x' || substr(digest, 5 * g + 1, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
         regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?', ''), '#.*$', '') AS plain
  FROM d),
k AS (
  SELECT *, array_to_string(list_reverse(string_split(regexp_extract(plain, '^[^/?:]*'), '.')), ',') || ')'
            || CASE WHEN regexp_matches(plain, '^[^/?:]*[/:]') THEN '' ELSE '/' END || regexp_replace(plain, '^[^/?:]*', '') AS url_key
  FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, url_key, {EPOCH} + page_id AS timestamp,
       row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture
FROM k
"""
