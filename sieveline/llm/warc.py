"""WARC archives: written and read back as Spark jobs.

Writing: records are serialised in Arrow batches, one gzip member each, and written by Spark's text writer with its
commit protocol, so a lost executor leaves no half archive. The writer puts a separator after each row; the last byte
of a gzip member (of its length) is 0 up to 16 MiB, so that byte is left to the separator and the files hold nothing
but gzip members. A larger record is followed by an empty member, which ends in 0 as well.

Reading: a sequential reader inflates an archive bit by bit, splits it at member borders, frames the block by
Content-Length and verifies block and payload digests while they pass: SHA-256, SHA-1 and MD5, in hex or base 32.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import materialize, shared_path, small_batches, table

#: Payloads shorter than this are always stored.
REVISIT_LEAST = 100
#: Payload bytes of one archive file, about; and bytes inflated at a time.
ARCHIVE_BYTES, STEP = 32 << 20, 64 << 10
#: Bits of the filter that tells which payloads may be repeated (16 MiB, whatever the table).
FILTER_BITS = 27
GZIP_LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()

RECORD = "record_type string, record_id string, target_uri string, page_id long, refers_to long, date string, payload_bytes long, payload_digest string, block_bytes long, verified boolean, file string, record_offset long, error string"


def member(data: list[bytes]) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, data), z.flush()])


def _line(value: str | None) -> str:
    """A header value: line breaks would end the field, so control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def record(kind: str, page_id, uri: str | None, payload: bytes, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z", length: int | None = None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the length of the full payload, not the body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    body = b"" if kind == "revisit" else payload
    block = hashlib.sha256(head)
    block.update(body)
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(uri)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{block.hexdigest()}",
    ]
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    top = "\r\n".join([*fields, f"Content-Length: {len(head) + len(body)}", "", ""]).encode("utf-8", "surrogatepass")
    return member([top, head, body, b"\r\n\r\n"])


class _Inflated:
    """The bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, data: memoryview):
        self.data, self.at = data, 0

    def open(self) -> bool:
        """Go to the next member."""
        self.z, self.out = zlib.decompressobj(31), b""
        self.start = self.at
        return self.at < len(self.data)

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if self.at >= len(self.data):
            raise ValueError("the archive ends inside a record")
        piece = self.data[self.at : self.at + STEP]
        self.out += self.z.decompress(piece)
        self.at += len(piece) - len(self.z.unused_data)
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (i := self.out.find(mark)) < 0:
            if len(self.out) > most:
                raise ValueError("a header without end")
            if not self._more():
                raise ValueError("a record without header")
        got, self.out = self.out[:i], self.out[i + len(mark) :]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise ValueError("a block shorter than its Content-Length")
            got, self.out = self.out[:n], self.out[n:]
            n -= len(got)
            yield got

    def rest(self) -> bytes:
        while self._more():
            pass
        return self.out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(urn: str | None) -> int | None:
    got = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got.lstrip("-").isdigit() else None


_ALGORITHMS = {"sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "md5": hashlib.md5}


class _Digest:
    """A digest that a header declares, checked against the bytes that pass; nothing is known where none is declared, or
    one of an algorithm that is not read here."""

    def __init__(self, declared: str | None):
        name, _, self.want = (declared or "").partition(":")
        make = _ALGORITHMS.get(name.strip().lower())
        self.hash = make() if make and self.want.strip() else None

    def update(self, piece: bytes) -> None:
        if self.hash is not None:
            self.hash.update(piece)

    def good(self) -> bool | None:
        if self.hash is None:
            return None
        got, want = self.hash.digest(), self.want.strip()
        if len(want) == 2 * len(got):
            return want.lower() == got.hex()
        try:
            return base64.b32decode(want.upper() + "=" * (-len(want) % 8)) == got
        except (binascii.Error, ValueError):
            return False


def read_archive(content: bytes, file: str = "", payloads: bool = False, strict: bool = True) -> Iterator[dict]:
    """The records of one archive in order. A record whose digests differ comes out with verified false, one that
    declares none with verified null. Where the framing is broken the archive ends with an error; if not strict, the
    error is a row (record_type null) and reading goes on at the next gzip member that can be found."""
    src = _Inflated(memoryview(content))
    while src.open():
        start = src.start
        try:
            yield from _read_record(src, file, payloads)
        except (ValueError, zlib.error) as x:
            if strict:
                raise ValueError(f"{file}: {x}") from x
            yield {"error": f"{type(x).__name__}: {x}", "file": file, "record_offset": start, "payload_bytes": None, "block_bytes": None}
            src.at = content.find(b"\x1f\x8b\x08", start + 1)
            if src.at < 0:
                return


def _read_record(src: _Inflated, file: str, payloads: bool) -> Iterator[dict]:
    offset = src.start
    if not src.out and not src._more() or (src.z.eof and not src.out):
        return  # an empty member
    top = src.until(b"\r\n\r\n")
    if not top.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    f = _fields(top)
    if not f.get("content-length", "").isdigit():
        raise ValueError("a record without Content-Length")
    n = int(f["content-length"])
    block, declared, payload, got, inner, kept = _Digest(f.get("warc-block-digest")), _Digest(f.get("warc-payload-digest")), hashlib.sha256(), 0, b"", []
    http = f.get("content-type", "").startswith("application/http")
    body = not http
    for piece in src.take(n):
        block.update(piece)
        if not body:
            inner += piece
            if (i := inner.find(b"\r\n\r\n")) < 0:
                continue
            inner, piece, body = inner[:i], inner[i + 4 :], True
        payload.update(piece)
        declared.update(piece)
        got += len(piece)
        if payloads:
            kept.append(piece)
    if src.rest() != b"\r\n\r\n":
        raise ValueError("a record not closed by two line breaks")
    kind, told = f.get("warc-type"), f.get("warc-payload-digest")
    checks = [block.good()]
    if kind == "revisit":  # the payload is elsewhere
        length = _fields(inner).get("content-length", "")
        got = int(length) if length.isdigit() else got
    else:
        checks.append(declared.good())
    ok = False if False in checks else None if None in checks else True
    yield {
        "record_type": kind, "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"), "page_id": _page(f.get("warc-record-id")),
        "refers_to": _page(f.get("warc-refers-to")), "date": f.get("warc-date"), "payload_bytes": got, "payload_digest": told.removeprefix("sha256:") if told else payload.hexdigest(),
        "block_bytes": n, "verified": ok, "file": file, "record_offset": offset, "error": None,
    } | ({"payload": b"".join(kept)} if payloads else {})


def read_warc(spark: SparkSession, path: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """The records of all archives under path, one row each (with payload if asked). One task reads an archive from
    its start to its end, as gzip demands; archives are what runs in parallel. No archive may exceed 2 GiB. If not
    strict, what is damaged comes out as rows with an error, and the rest is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")

    def read(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for r in read_archive(content, file, payloads, strict):
                    rows.append(r)
                    size += len(r.get("payload", b"")) + 500
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, dtype=object)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, dtype=object)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARCHIVE_BYTES))

    names = [c.split()[0] for c in RECORD.split(", ")] + (["payload"] if payloads else [])

    def typed(batches):
        for out in read(batches):
            for c in ("page_id", "refers_to", "payload_bytes", "block_bytes"):
                out[c] = out[c].astype("Int64")
            yield out.reindex(columns=names)

    return files.mapInPandas(typed, RECORD + (", payload binary" if payloads else ""))


def _maybe(keys: DataFrame, key: str):
    """A function of a column that is true for every key of keys and for few others: a bitmap of 2^FILTER_BITS bits. It is
    put together from pages of 4 KiB, so the driver gets the bitmap and no more."""
    spark, mask = keys.sparkSession, (1 << FILTER_BITS) - 1
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))

    def page(g: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(4096, np.uint8)
        at = g["h"].to_numpy() & 32767
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"page": [int(g["page"].iat[0])], "bits": [bits.tobytes()]})

    pages = keys.select(place(key).alias("h")).distinct().withColumn("page", F.shiftright("h", 15)).groupBy("page").applyInPandas(page, "page long, bits binary").collect()
    whole = np.zeros(max(1, (mask + 1) >> 15) * 4096, np.uint8)
    for r in pages:
        whole[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    held = spark.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def told(h: pd.Series) -> pd.Series:
        x = h.to_numpy()
        return pd.Series((held.value[x >> 3] >> (x & 7)) & 1 == 1)

    return lambda c: told(place(c))


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_LEAST, few: int = 100_000) -> DataFrame:
    """Rows (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to). Of equal payloads of at least
    so many bytes the one with the smallest page_id is a response and others revisit it (without a payload of their own);
    rows without an id, and rows repeated under the smallest id, are responses too. Repeated digests are broadcast if they
    are few (counted first). Beyond that a filter of a fixed size keeps payloads that are not repeated where they were
    read, and only the others meet their digests by a shuffle."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    many = materialize(
        rows.filter(F.length("payload") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first"),
        "warc-first",
    )
    if many.count() <= few:
        out = rows.join(F.broadcast(many), "payload_digest", "left")
    else:
        told = rows.withColumn("maybe", _maybe(many, "payload_digest")(F.col("payload_digest")))
        out = told.filter("not maybe").drop("maybe").withColumn("first", F.lit(None).cast("long")).unionByName(told.filter("maybe").drop("maybe").join(many.hint("merge"), "payload_digest", "left"))
    revisits = F.coalesce((F.col("page_id") != F.col("first")), F.lit(False))
    return out.select(
        "page_id", "url", F.when(~revisits, F.col("payload")).otherwise(F.lit(b"")).alias("payload"), F.length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write planned records as gzip archives under path. A task begins a new archive as soon as one holds ARCHIVE_BYTES,
    so none is longer than that and its last record, whatever the sizes of payloads are."""

    def members(batches):
        archive, size = 0, 0
        for b in batches:
            out, of = [], []
            for i in range(len(b)):
                page, to = b["page_id"].iat[i], b["refers_to"].iat[i]
                data = record(
                    b["record_type"].iat[i], None if pd.isna(page) else int(page), b["url"].iat[i], b["payload"].iat[i], b["payload_digest"].iat[i], None if pd.isna(to) else int(to),
                    length=int(b["payload_bytes"].iat[i]),
                )
                if data[-1]:
                    data += _EMPTY
                out.append(data[:-1])
                of.append(archive)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    archive, size = archive + 1, 0
            yield pd.DataFrame({"value": out, "archive": of})

    small_batches(records.sparkSession)
    made = records.mapInPandas(members, "value binary, archive int").select(F.col("value").cast("string").alias("value"), "archive")
    made.write.option("lineSep", "\0").partitionBy("archive").text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all pages, read back from the archives; an empty table gives no rows."""
    path = shared_path(spark, "warc")
    write_warc(plan_records(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS verified FROM f
"""
