"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

Some archives are one gzip stream from end to end, so no record can be read without all
before it. The normaliser inflates such a file once, in pieces, writes every record as a gzip
member of its own, and writes a sidecar index of the members' offsets, by which any task can
then read any record alone. Files lie in a folder that all executors reach.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import small_batches, stage, text_bytes
from tallyforge.runtime import scratch_path

LEAST_REVISIT = 1000
PIECE = 1 << 20
LEVEL = 6
# The format's names.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(number) -> str:
    return f"<urn:page:{number}>"


def _record(row: dict) -> bytes:
    """One record; a revisit has no payload, the headers tell its size and digest."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"]
    block = HTTP_HEAD.format(row["payload_bytes"]).encode() + payload
    uri = _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", row["url"] or "urn:unknown")
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": record_id(row["page_id"]) if row["page_id"] is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "X-Payload-Length": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if revisit:
        head["WARC-Profile"] = REVISIT_PROFILE
        head["WARC-Refers-To"] = record_id(row["refers_to"])
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _publish(files, written: str, final: str) -> None:
    """Put a finished file in place; another attempt of the task may have done so before."""
    files.move(written, final)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/{context.partitionId():06d}.warc.gz"
        own = f"{name}.{context.taskAttemptId()}"
        packer, count = zlib.compressobj(LEVEL, wbits=31), 0
        with files.open_output_stream(own, compression=None) as out:
            for batch in batches:
                columns = [c for c in batch.schema.names if c != "payload"]
                payloads = text_bytes(batch.column("payload"))
                for row, payload in zip(batch.select(columns).to_pylist(), payloads, strict=True):
                    out.write(packer.compress(_record(row | {"payload": payload.as_py()})))
                    count += 1
            out.write(packer.flush())
        if not count:
            files.delete_file(own)
            return
        _publish(files, own, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{context.partitionId():06d}.warc.gz"]), pa.array([count])], ["path", "records"]
        )

    return run


def classify(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Among rows of equal payloads of at least ``least`` bytes that with the largest page_id is
    the response, and the others revisit it. A null html is an empty payload.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    large = F.col("payload_bytes") >= least
    latest = (
        rows.where(large).groupBy(F.col("payload_digest").alias("content"))
        .agg(F.max("page_id").alias("latest"))
    )
    # Small payloads find no partner; they are dealt out by row.
    content = F.when(large, F.col("payload_digest")).otherwise(F.format_string("-%d", F.xxhash64("page_id", "url")))
    joined = rows.withColumn("content", content).join(latest, "content", "left")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("latest")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each partition of :func:`classify`'s rows as one gzip stream; (path, records).

    The files are written once; a task that is run again replaces its own. An empty table
    writes none.
    """
    small_batches(records.sparkSession)
    folder = folder or scratch_path(records.sparkSession, "warc")
    return stage(records.mapInArrow(_write(folder), "path string, records long"), "archives")


class Inflated:
    """A gzip file's content, of one member or several, read in pieces."""

    def __init__(self, file, path: str):
        self.file, self.path = file, path
        self.inflater = zlib.decompressobj(wbits=31)
        self.held, self.at, self.over = bytearray(), 0, False

    def _more(self) -> bool:
        data = self.inflater.unconsumed_tail
        if self.inflater.eof:
            data = self.inflater.unused_data or self.file.read(PIECE)
            if not data:
                return False
            self.inflater = zlib.decompressobj(wbits=31)
        elif not data:
            data = self.file.read(PIECE)
            if not data:
                raise ValueError(f"{self.path} ends within a gzip member")
        if self.at > PIECE:
            del self.held[: self.at]
            self.at = 0
        self.held += self.inflater.decompress(data, PIECE)
        return True

    def line(self) -> bytes | None:
        start = self.at
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held) - self.at
            if not self._more():
                if self.at == len(self.held):
                    return None
                raise ValueError(f"{self.path} ends within a record")
            start += self.at
        out = bytes(self.held[self.at : end + 1])
        self.at = end + 1
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError(f"{self.path} ends within a record")
        out = bytes(self.held[self.at : self.at + size])
        self.at += size
        return out


def records_of(content: Inflated) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers by lower-case name, head, block) of each record."""
    while True:
        line = content.line()
        while line is not None and not line.strip():
            line = content.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{content.path} has no record where one should begin")
        head, names = [line], {}
        while (line := content.line()) is not None:
            head.append(line)
            if not line.strip():
                break
            name, _, value = line.decode(errors="replace").partition(":")
            names[name.strip().lower()] = value.strip()
        yield names, b"".join(head), content.take(int(names["content-length"]))


INDEX = (
    "path string, number long, offset long, size long, record_type string, record_id string, "
    "refers_to string, uri string, payload_digest string, payload_bytes long"
)


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, inner = _files(path)
                name = path.rsplit("/", 1)[-1]
                own, rows, offset = f"{name}.{attempt}", [], 0
                with source.open_input_stream(inner, compression=None) as file, files.open_output_stream(
                    f"{root}/{own}", compression=None
                ) as out:
                    for number, (names, head, block) in enumerate(records_of(Inflated(file, path))):
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(head + block + b"\r\n\r\n") + packer.flush()
                        out.write(member)
                        rows.append(
                            {
                                "path": f"{folder}/{name}", "number": number, "offset": offset,
                                "size": len(member), "record_type": names.get("warc-type"),
                                "record_id": names.get("warc-record-id"),
                                "refers_to": names.get("warc-refers-to"),
                                "uri": names.get("warc-target-uri"),
                                "payload_digest": names.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                "payload_bytes": int(names["x-payload-length"]) if "x-payload-length" in names else None,
                            }
                        )
                        offset += len(member)
                found = pa.Table.from_pylist(rows, schema=_index_schema())
                with files.open_output_stream(f"{root}/{own}.idx", compression=None) as out:
                    with pa.ipc.new_file(out, found.schema) as sidecar:
                        sidecar.write_table(found)
                _publish(files, f"{root}/{own}", f"{root}/{name}")
                _publish(files, f"{root}/{own}.idx", f"{root}/{name}.idx")
                yield from found.to_batches()

    return run


def _index_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in INDEX.split(", "))])


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrite each file of ``archives`` (path) record by record; the offset index as rows.

    A file is one task's work, since a gzip stream cannot be entered in the middle; its records
    pass one by one. Beside each new file lies its index (``.idx``, Arrow). A file that is cut
    short or holds something else raises an error; no files give an empty index.
    """
    spark = archives.sparkSession
    folder = folder or scratch_path(spark, "warc-members")
    files = max(1, archives.count())
    paths = archives.select("path").repartition(files)
    return stage(paths.mapInArrow(_normalise(folder), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        payloads: list[bytes | None] = [None] * len(rows)
        by_path: dict[str, list[int]] = {}
        for i, row in enumerate(rows):
            by_path.setdefault(row["path"], []).append(i)
        for path, own in by_path.items():
            files, inner = _files(path)
            with files.open_input_file(inner) as file:
                for i in own:
                    member = file.read_at(rows[i]["size"], rows[i]["offset"])
                    record = zlib.decompress(member, wbits=31)
                    head = record.index(b"\r\n\r\n") + 4
                    block = record[head : len(record) - 4]
                    payloads[i] = block[block.index(b"\r\n\r\n") + 4 :]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(payloads, pa.binary())], [*batch.schema.names, "payload"]
        )


def read_records(index: DataFrame) -> DataFrame:
    """The rows of an index with each record's payload, read by its offset alone."""
    small_batches(index.sparkSession)
    # An index row stands for a whole record: few rows to a batch.
    few = index.repartition(F.col("path"), F.floor(F.col("number") / 256))
    return few.mapInArrow(_read_some, INDEX + ", payload binary")


def _read_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 64):
            yield from _read(iter([batch.slice(low, 64)]))


def page_number(identifier):
    """The page_id in a record's identifier, null where it has none."""
    return F.regexp_extract(identifier, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
