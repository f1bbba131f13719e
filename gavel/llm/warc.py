"""Operator 12: a deterministic, sharded WARC writer, and the reader of its archives.

1. A compact pass (ids, hashes, sizes) finds payloads that occur more than once. Of such records the one with the largest
   page_id is the response and the others revisit it. The pass also sums bytes over cells of the id range; cells that hold too
   much are cut finer, a single id at last by its hash, so that the bounds of the ranges follow from the rows alone.
2. Each page becomes a gzip member with regenerated headers and digests in the task that reads it; members, not texts, are
   shuffled to their range and sorted by (page_id, hash of url and payload).
3. A task appends members to a file under a temporary name and rolls to the next once the compressed size is reached.
4. Only files that the finished job reports are renamed to their final names, and a manifest (name, records, bytes, SHA-256) is
   written last. A lost executor's files stay under temporary names, which are removed; a retried task writes the same bytes.

The bytes of the archives depend on the rows and the parameters, not on partitions, cores or attempts. What comes to the driver are
at most CELLS sums for each cut of the id range. Equal payloads are joined by (digest, salt), so that a payload which holds a
third of all rows is spread; decisions join the pages inside the one shuffle that sorts them.

Reading takes the files that the manifest names, a member at a time, and checks block and payload digests and record counts.

Defined results: a null html is an empty payload, and empty payloads are equal ones; rows with the same page_id, url and payload are copies: the
first is the response, if their payload's response is theirs, all others revisits; a null page_id is smaller than all others; a null url leaves out
the target; control characters and spaces in a url are percent-encoded in the header; an empty table gives a manifest without files; very long pages are one record each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.common import batch_of, map_slices, shared_dir, stored

#: Compressed bytes after which a file is rolled.
FILE_BYTES = 256 << 20
#: A range holds about a 256th of the payloads' bytes, but no less and no more than these.
LEAST_RANGE, MOST_RANGE = 4 << 20, 1 << 30
#: Cells into which a stretch of the id range is cut at once: all that comes to the driver.
CELLS = 4096
SALTS = 64
#: Tasks that read archives, at most; each reads one file after another.
MOST_TASKS = 10_000
DATE = "1970-01-01T00:00:00Z"
PACKED = "shard long, page_id long, h long, digest string, kind int, ref_page long, ref_h long, url string, size long, record binary"
FILES = "shard long, part long, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time in its header
    return c.compress(data) + c.flush()


def record_id(page_id: int | None, h: int, digest: str, copy: int = 0) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{h & 0xFFFFFFFFFFFFFFFF:016x}:{digest}:{copy}>"


def _header_value(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _record(kind: str, rid: str, url: str | None, block: bytes, digest: str, more: tuple[str, ...] = ()) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", *more]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(page_id: int | None, h: int, url: str | None, payload: bytes, digest: str) -> bytes:
    return _record("response", record_id(page_id, h, digest), url, _http(len(payload)) + payload, digest)


def revisit(page_id: int | None, h: int, copy: int, url: str | None, size: int, digest: str, to: str) -> bytes:
    """The block is the header of the payload that is not repeated, so its length is still told."""
    more = (f"WARC-Refers-To: {to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return _record("revisit", record_id(page_id, h, digest, copy), url, _http(size), digest, more)


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}"]
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _compact(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    df = df.withColumn("digest", F.sha1("html"))
    return df.select("page_id", "url", "html", "digest", F.xxhash64("url", "digest").alias("h"), F.octet_length("html").cast("long").alias("size"))


def decisions(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, h, digest, ref_page, ref_h) of the rows whose payload occurs more than once: the response of each payload."""
    same = rows.filter(F.col("size") >= least_bytes).groupBy("page_id", "h", "digest").agg(F.count("*").alias("n"))
    same = same.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    parts = same.groupBy("digest", "salt").agg(F.max(F.struct("page_id", "h")).alias("best"), F.sum("n").alias("n"))
    best = parts.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    by_salt = parts.select("digest", "salt").join(best, "digest")
    out = same.join(by_salt, ["digest", "salt"])
    return out.select("page_id", "h", "digest", F.col("best.page_id").alias("ref_page"), F.col("best.h").alias("ref_h"))


def bounds(rows: DataFrame) -> list[tuple[bool, int, int]]:
    """Where ranges begin, as (not null, page_id, h): bytes are summed over cells of the ids, and cells that hold too much are cut again."""
    cost = F.sum(F.col("size") + 200)
    total, low, high = rows.agg(cost, F.min("page_id"), F.max("page_id")).first()
    if total is None:
        return []
    most = min(max(total // 256, LEAST_RANGE), MOST_RANGE)
    none = rows.filter("page_id is null").agg(cost).first()[0] or 0
    leaves = [((False, 0), none)] if none else []
    todo = [(low, high)] if low is not None else []
    while todo:
        part = rows.filter("page_id is not null").select("page_id", "size")
        tests = [(F.col("page_id") >= a) & (F.col("page_id") <= b) for a, b in todo[:64]]  # stretches of one job
        now, todo = todo[:64], todo[64:]
        stretch, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, ((a, b), inside) in enumerate(zip(now, tests, strict=True)):
            width = (b - a) // CELLS + 1
            stretch = F.when(inside, i).otherwise(stretch)
            # both halves apart, so that ids far from each other do not overflow
            cell = F.when(inside, F.floor((F.col("page_id").cast("decimal(38,0)") - F.lit(str(a)).cast("decimal(38,0)")) / F.lit(str(width)).cast("decimal(38,0)")).cast("long")).otherwise(cell)
        for i, c, n in part.withColumn("stretch", stretch).withColumn("cell", cell).filter("stretch is not null").groupBy("stretch", "cell").agg(cost).collect():
            a, b = now[i]
            width = (b - a) // CELLS + 1
            first, last = a + c * width, min(b, a + (c + 1) * width - 1)
            if n > most and first < last:
                todo.append((first, last))
            else:
                leaves.append(((True, first), n))
    out, held = [], most
    for (known, first), n in sorted(leaves):
        if held + n > most:
            pieces = -(-n // most)
            out += [(known, first, -(1 << 63) + k * ((1 << 64) // pieces)) for k in range(pieces)]
            held = n if pieces == 1 else most
        else:
            held += n
    return out


def _packer(starts: list[tuple[bool, int, int]]):
    def make():
        def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for page_id, h, digest, kind, ref_page, ref_h, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = max(0, bisect_right(starts, (page_id is not None, page_id or 0, h)) - 1)
                size = record = None
                if kind:
                    size, record = len(html), gzip_member(response(page_id, h, url, html, base64.b32encode(bytes.fromhex(digest)).decode()))
                out.append((shard, page_id, h, digest, kind, ref_page, ref_h, url, size, record))
            return batch_of(out, PACKED)

        return pack

    return make


class _File:
    """A file under a temporary name, rolled by the caller."""

    def __init__(self, folder: str, shard: int, part: int):
        from pyarrow import fs

        self.shard, self.part, self.name = shard, part, f"pages-{shard:06d}-{part:05d}.warc.gz"
        system, path = fs.FileSystem.from_uri(folder)
        self.temporary = f"_temporary/{uuid.uuid4().hex}/{self.name}"
        system.create_dir(f"{path}/{self.temporary}".rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.temporary}", compression=None)
        self.records = self.bytes = 0
        self.sha = hashlib.sha256()
        self._put(gzip_member(_info(self.name)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def add(self, member: bytes) -> None:
        self._put(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, decided, ref, key, copy = None, None, None, None, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for shard, page_id, h, digest, kind, ref_page, ref_h, url, size, record in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    if not kind:
                        decided, ref = (page_id, h, digest), (ref_page, ref_h)
                        continue
                    copy = copy + 1 if key == (page_id, h, digest) else 0
                    key = (page_id, h, digest)
                    if file and (file.shard != shard or file.bytes >= file_bytes):
                        yield batch_of([file.close()], FILES)
                        file = _File(folder, shard, file.part + 1 if file.shard == shard else 0)
                    file = file or _File(folder, shard, 0)
                    if decided == key and (copy or ref != (page_id, h)):
                        b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                        record = gzip_member(revisit(page_id, h, copy, url, size, b32, record_id(*ref, b32)))
                    elif copy:  # payloads too short to be revisited
                        record = gzip_member(zlib.decompress(record, 31).replace(b":0>\r\n", f":{copy}>\r\n".encode(), 1))
                    file.add(record)
        if file:
            yield batch_of([file.close()], FILES)

    return write


def _mover(folder: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if system.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{path}/{temporary}", f"{path}/{name}")
                elif system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{name} is neither under its temporary nor under its final name")
            yield batch

    return move


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files into an empty folder that driver and executors share; the manifest is returned."""
    from pyarrow import fs

    spark = pages.sparkSession
    rows = _compact(pages)
    compact = rows.drop("html", "url")
    starts = bounds(compact)
    told = decisions(compact, least_bytes).select("page_id", "h", "digest", F.lit(0).alias("kind"), "ref_page", "ref_h", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    none = F.lit(None).cast("long")
    whole = rows.select("page_id", "h", "digest", F.lit(1).alias("kind"), none.alias("ref_page"), none.alias("ref_h"), "url", "html")
    packed = map_slices(whole.union(told), _packer(starts), PACKED, text="html")
    dealt = packed.repartition("shard").sortWithinPartitions("shard", "page_id", "h", "digest", "kind")
    made = stored(dealt.mapInArrow(_writer(folder, file_bytes), FILES))
    made = stored(made.repartition("name").mapInArrow(_mover(folder), FILES))  # by name, so that each file is moved by one task
    made.drop("temporary").write.parquet(f"{folder}/_manifest")
    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
        system.delete_dir(f"{path}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after another; an error where the stream ends inside one."""
    data, gunzip, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                break
        gunzip = gunzip or zlib.decompressobj(31)
        parts.append(gunzip.decompress(data))
        data = gunzip.unused_data
        if gunzip.eof:
            yield b"".join(parts)
            gunzip, parts = None, []
    if gunzip:
        raise ValueError("the archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, whose block digest must be right."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(rest) != n + 4 or f"sha1:{base32_sha1(block)}" != headers["warc-block-digest"]:
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def _page_of(rid: str) -> int | None:
    page = rid.split(":")[2]
    return None if page == "null" else int(page)


def _reader(folder: str, payload: bool):
    schema = RECORDS + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out, held, count = [], 0, 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in members(stream):
                        headers, block = parse_record(member)
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.decode().lower().rpartition("content-length:")[2].split("\r\n")[0])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (size != len(body) or digest != base32_sha1(body)):
                            raise ValueError(f"payload of {headers['warc-record-id']} does not fit its digest")
                        to = headers.get("warc-refers-to")
                        row = (_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, _page_of(to) if to else None, name)
                        out.append((*row, body if kind == "response" else None) if payload else row)
                        count, held = count + 1, held + len(member) * payload
                        if len(out) >= 4000 or held > 4 << 20:
                            yield batch_of(out, schema)
                            out, held = [], 0
                if count != records:
                    raise ValueError(f"{name} has {count} records, its manifest {records}")
                if out:
                    yield batch_of(out, schema)

    return read, schema


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of all files that the folder's manifest names; payload adds the bytes of responses (null for revisits)."""
    read, schema = _reader(folder, payload)
    files = spark.read.parquet(f"{folder}/_manifest").select("name", "records")
    tasks = min(max(1, files.count()), MOST_TASKS)  # stated, as Spark would put such small rows into one task
    return files.repartition(tasks, "name").mapInArrow(read, schema)


def new_folder(spark: SparkSession) -> str:
    """A new folder's path under the shared one, in the form that both Spark and pyarrow take."""
    return f"{shared_dir(spark)}/gavel-{uuid.uuid4().hex}"


#: The query in SQL: the base-32 text of a SHA-1 is read from its hex text, 20 bits at a time.
ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload)::BIGINT as payload_bytes, sha1(payload) as hex from p),
r as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[1 + 5 * (i // 4):5 + 5 * (i // 4)])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') as payload_digest from q),
s as (select *, row_number() over (partition by payload_digest order by page_id desc nulls last) as n, max(page_id) over (partition by payload_digest) as best from r)
select page_id, payload_bytes, payload_digest, case when n = 1 then 'response' else 'revisit' end as record_type, case when n > 1 then best end as refers_to from s"""
