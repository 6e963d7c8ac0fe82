"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id, then by payload digest: the id range is cut into equal cells, a cell that holds more than
a shard is cut again (a single id, or rows without one, by digest), so cells are even however the ids are spread. Cells
are dealt to shards by their bytes, and each shard is written in order by one task as gzip members, rolled to a new file
when its compressed size reaches a limit.
Headers and digests are made anew from the payload. A file is written under a temporary name and renamed when it is
complete; readers take only the files that the manifest lists, and the manifest is renamed last, whereupon what failed
attempts have left is removed. Bytes depend on the
records and parameters alone, so a task that runs again writes the same files.

Of records with equal payloads the one with the largest id is a response, the others revisit it. Payloads move in one
shuffle; which records are revisits is found from digests and joins the payloads in that same shuffle, as rows of the
same table. Files go through pyarrow's file systems, so the folder may be any URI that these know.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: cells of a level, all cells that are cut again taken together
CELLS = 65_536
#: digests are ranges of their first 60 bits
_DIGESTS = 1 << 60
#: a shard holds a 4096th of all bytes, but not less or more than this
SHARD_BYTES = (32 << 20, 1 << 30)
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "manifest.json"
_LEFT = re.compile(r"\.(part-.*|manifest\.json\..*)\.tmp|part-\d+-\d+\.warc\.gz")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def _safe(url: str | None, page_id: int | None) -> str:
    """A header value: controls, spaces and non-ASCII percent-encoded; a null URL gets a name from the id."""
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": date, "WARC-Target-URI": _safe(url, page_id), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers and block; raises ValueError where its digest or length is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or len(rest) != len(block) + 4 or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (len(payload) != size or fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError(f"broken payload {fields['WARC-Record-ID']}")
    return fields | {"payload": payload, "payload_bytes": size}


class _Shard:
    """The files of one shard, in turn."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.turn, self.out = shard, limit, 0, None

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.turn:04d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.bytes, self.records, self.sum = self.files.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.bytes, self.records = self.bytes + len(member), self.records + 1

    def close(self) -> dict:
        self.out.close()
        self.files.move(self.temporary, f"{self.root}/{self.name}")
        done = {"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}
        self.out, self.turn = None, self.turn + 1
        return done


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, url, html, sha, refers, kind) in order -> the files written."""
    shard, revisit = None, {}
    done: list[dict] = []
    for batch in batches:
        for at, page_id, url, html, sha, refers, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                revisit = {(page_id, sha): refers}
                continue
            if shard is None or shard.shard != at:
                if shard is not None and shard.out is not None:
                    done.append(shard.close())
                shard = _Shard(folder, at, limit)
            shard.add(page_id, record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), revisit.get((page_id, sha)), date))
            if shard.bytes >= limit:
                done.append(shard.close())
    if shard is not None and shard.out is not None:
        done.append(shard.close())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))


_STEP = "node int, cell int, shard int, child int, by_id boolean, low decimal(20,0), width decimal(20,0)"


def _step(node: int, cell: int, shard: int | None, child: int | None, specs: dict) -> tuple:
    by_id, low, width = specs[child] if child is not None else (None, None, None)
    return node, cell, shard, child, by_id, None if low is None else Decimal(low), None if width is None else Decimal(width)


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the cell of rows (id, sha, node, by_id, low, width); an id that is null has cell -1 among ids."""
    value = "if(by_id, cast(id as decimal(20,0)), cast(conv(substring(sha, 1, 15), 16, 10) as decimal(20,0)))"
    return rows.withColumn("cell", F.expr(f"coalesce(cast(({value} - low) div width as int), -1)"))


def _root(rows: DataFrame, low: int, width: int) -> DataFrame:
    number = lambda v: F.lit(v).cast("decimal(20,0)")
    return rows.withColumns({"node": F.lit(0), "by_id": F.lit(True), "low": number(low), "width": number(width)})


def _cells(thin: DataFrame, shard_bytes: int | None) -> tuple[list[DataFrame], int, int, int]:
    """Tables of steps that lead from the root to every row's shard, one a level, the root's low and width, and the number
    of shards. ``thin``: id, sha, bytes.

    What comes to the driver is bounded: CELLS sums a level, or two for each cell that holds more than a shard."""
    spark = thin.sparkSession
    least, most, whole = thin.agg(F.min("id"), F.max("id"), F.sum("bytes")).first()
    low, high = least or 0, most or 0
    if shard_bytes is None:
        shard_bytes = min(SHARD_BYTES[1], max(SHARD_BYTES[0], (whole or 0) // 4096))
    width = -(-(high - low + 1) // CELLS)
    levels, specs, rows = [], {0: (True, low, width)}, _root(thin, low, width)
    while True:
        placed = _placed(rows)
        sums = placed.groupBy("node", "cell").agg(F.sum("bytes").alias("bytes")).collect()
        steps, heavy = {}, []
        for r in sums:
            by_id, at, wide = specs[r.node]
            if r.bytes > shard_bytes and (by_id or wide > 1):
                heavy.append((r.node, r.cell))
            steps[r.node, r.cell] = [r.bytes, None]
        each = max(2, CELLS // max(1, len(heavy)))
        following = {}
        for node, cell in sorted(heavy):
            by_id, at, wide = specs[node]
            # a cell of one id, or of none, is cut by digest
            spec = (False, 0, -(-_DIGESTS // each)) if by_id and (cell < 0 or wide == 1) else (by_id, at + cell * wide, -(-wide // each))
            child = len(specs) + len(following)
            following[child] = spec
            steps[node, cell][1] = child
        levels.append(steps)
        if not heavy:
            break
        specs |= following
        # rows of cells that are cut again
        onward = spark.createDataFrame([_step(n, c, None, steps[n, c][1], following) for n, c in heavy], _STEP).drop("shard")
        rows = placed.select("id", "sha", "bytes", "node", "cell").join(F.broadcast(onward), ["node", "cell"]).drop("node", "cell").withColumnRenamed("child", "node")
    below: dict[int, list] = {}
    for steps in levels:
        for (node, cell), step in steps.items():
            below.setdefault(node, []).append((cell, step))
    shard, filled, dealt, stack = 0, 0, {}, [(0, c, s) for c, s in sorted(below.get(0, []), reverse=True)]
    while stack:
        node, cell, (size, child) = stack.pop()
        if child is not None:
            stack += [(child, c, s) for c, s in sorted(below[child], reverse=True)]
            continue
        if filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        dealt[node, cell] = shard
        filled += size
    tables = [spark.createDataFrame([_step(n, c, dealt.get((n, c)), child, specs) for (n, c), (_, child) in steps.items()], _STEP) for steps in levels]
    return tables, low, width, shard + 1


def _dealt(rows: DataFrame, tables: list[DataFrame], low: int, width: int) -> DataFrame:
    """Adds the shard of rows that have id and sha."""
    columns = rows.columns
    rows = _root(rows, low, width).withColumn("shard", F.lit(None).cast("int"))
    for table in tables:
        step = table.select(F.col("node").alias("_n"), F.col("cell").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("shard", "child", "by_id", "low", "width")])
        placed = _placed(rows)
        placed = placed.join(F.broadcast(step), (F.col("node") == F.col("_n")) & (F.col("cell") == F.col("_c")), "left")
        rows = placed.select(*columns, F.coalesce("shard", "_shard").alias("shard"), F.col("_child").alias("node"), *[F.col(f"_{c}").alias(c) for c in ("by_id", "low", "width")])
    return rows.select(*columns, "shard")


def _tidy(files: fs.FileSystem, root: str, listed: set[str]) -> None:
    """Removes archives that the manifest doesn't list and temporary files."""
    for found in files.get_file_info(fs.FileSelector(root)):
        if found.is_file and found.base_name not in listed and _LEFT.fullmatch(found.base_name):
            files.delete_file(found.path)


def write(pages: DataFrame, folder: str, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES, min_payload: int = 0, date: str = DATE, key: str = "page_id", url: str = "url", html: str = "html") -> dict:
    """Writes one record for each row of ``pages`` into ``folder`` (which all executors reach) and returns the manifest.

    A null payload is empty, a null URL is named after the id; a record without an id is a response or a revisit as
    any, but nothing revisits it if its group has an id; rows equal in id and payload are each a response or all
    revisits; payloads below ``min_payload`` bytes are responses. An empty table gives a manifest without files.
    """
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    named = p.withColumn("sha", F.sha1(body))
    thin = stored(named.select("id", "sha", F.octet_length(body).cast("long").alias("size")), "thin")
    known = thin.where(F.col("size") >= min_payload)
    last = known.groupBy("sha").agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").drop("n")
    revisits = known.select("id", "sha").join(last, "sha").where(~F.col("id").eqNullSafe(F.col("refers")))
    revisits = revisits.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "refers", F.lit(0).alias("kind")).distinct()
    rows = named.withColumn("refers", F.lit(None).cast("long")).withColumn("kind", F.lit(1)).unionByName(revisits)
    tables, low, width, shards = _cells(thin.select("id", "sha", (F.col("size") + 600).alias("bytes")), shard_bytes)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = _dealt(rows, tables, low, width).select("shard", "id", "url", "html", "sha", "refers", "kind")
    # one shard, one task; its order is total but for rows equal in all that is written
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "id", "sha", "kind", "url")
    done = rows.mapInArrow(lambda it: _write(it, folder, file_bytes, date), "file string, records long, bytes long, sha256 string").collect()
    manifest = {"format": "WARC/1.1", "files": [r.asDict() for r in sorted(done)]}
    temporary = f"{root}/.{MANIFEST}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(json.dumps(manifest, indent=1).encode())
    files.move(temporary, f"{root}/{MANIFEST}")
    _tidy(files, root, {f["file"] for f in manifest["files"]})
    return manifest


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, held = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 16):
        while chunk:
            held.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(held)
                unpack, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the file ends within a record")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda v: None if v is None else int(v)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=columns)

    for part in batches:
        for name in part.column(0).to_pylist():
            rows, held = [], 0
            with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in _members(stream):
                    r = parse(data)
                    rows.append((number(r.get("WARC-Page-ID")), r["WARC-Target-URI"], r["payload_bytes"], r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"], number(r.get("WARC-Refers-To-Page-ID")), r["payload"] if r["WARC-Type"] == "response" else None))
                    held += len(data)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the manifest, digests checked: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits)."""
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
        names = [f["file"] for f in json.loads(stream.read())["files"]]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return listed.mapInArrow(lambda it: _read(it, folder), schema)
