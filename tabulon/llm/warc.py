"""WARC archives written and read as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exact, work_path

CHUNK = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str, payload: str, url_col: str | None, min_bytes: int) -> DataFrame:
    """Each page with its payload's digest, the page that holds the payload (the largest identifier of equal payloads), and
    which of the rows with one identifier and payload it is. Digests are matched without the payloads, so a payload
    that many pages share is in no join; pages are joined by identifier."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(payload), F.lit("")).alias("body"), url.alias("url"))
    rows = rows.withColumns({"sha1": F.sha1("body"), "bytes": F.octet_length("body").cast("long"), "known": F.col("id").isNotNull(), "id0": F.coalesce("id", F.lit(0))})
    key = ["id0", "known", "sha1", "bytes"]
    about = rows.groupBy(key).agg(F.max("id").alias("m"))
    holders = about.groupBy("sha1", "bytes").agg(F.max("m").alias("holder"))
    plan = about.join(holders, ["sha1", "bytes"]).select(*key, "holder")
    revisit = (F.col("bytes") >= min_bytes) & F.coalesce(F.col("id") < F.col("holder"), F.col("holder").isNotNull())
    nth = F.row_number().over(Window.partitionBy(key).orderBy("id0"))
    return rows.join(plan, key).withColumn("nth", nth).withColumn("revisit", revisit)


def _name(page, sha1: str, nth: int) -> str:
    return f"urn:tabulon:page:{'none' if page is None else int(page)}:{sha1}:{nth}"


def _records(chunk: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """WARC records as text rows: a header block and one chunk of at most `chunk` bytes; a longer record goes on in
        continuation records, as the standard has them. The writer's line separator ends each record."""
        for frame in frames:
            out = []
            for x in frame.itertuples(index=False):
                page = None if x.id is None else int(x.id)
                name = _name(page, x.sha1, x.nth)
                digest = base64.b32encode(bytes.fromhex(x.sha1)).decode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {x.bytes}\r\n\r\n".encode()
                uri = "".join(x.url.split()) if isinstance(x.url, str) and x.url.strip() else f"urn:tabulon:page:{'none' if page is None else page}"
                about = f"WARC-Target-URI: {uri}\r\nWARC-Date: {EPOCH}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
                if x.revisit:
                    head = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <{name}>\r\n{about}WARC-Refers-To: <{_name(x.holder, x.sha1, 1)}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                    block = http
                else:
                    n = max(1, -(-x.bytes // chunk))
                    block = (http if x.k == 0 else b"") + bytes(x.block)
                    head = f"WARC/1.1\r\nWARC-Type: {'continuation' if x.k else 'response'}\r\nWARC-Record-ID: <{name}{f':{x.k + 1}' if x.k else ''}>\r\n{about}"
                    if n > 1:
                        head += f"WARC-Segment-Number: {x.k + 1}\r\n" + (f"WARC-Segment-Origin-ID: <{name}>\r\n" if x.k else "") + (f"WARC-Segment-Total-Length: {len(http) + x.bytes}\r\n" if x.k == n - 1 else "")
                out.append(f"{head}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block)
            yield pd.DataFrame({"record": out})

    return write


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0, chunk: int = CHUNK, url_col: str | None = None) -> None:
    """Gzip-compressed WARC files in the folder `path`, one record per row.

    Of rows with equal payloads of at least min_bytes bytes the one with the largest identifier is a response and the
    others revisit it, by its record's identifier. A payload beyond `chunk` bytes is cut by the engine into rows of a record
    and a chunk number, and goes into continuation records, so no record that is written is longer. A null payload is empty;
    a row without an identifier has a record of its own (a revisit where an identified row has its payload); repeated rows
    have records of their own; an empty table gives an empty folder; other columns play no part. The text writer puts the
    bytes down unchanged: its line separator is the end of a record, and a file is one gzip member."""
    rows = plan_records(pages, id_col, payload, url_col, min_bytes)
    body, last = F.encode("body", "utf-8"), F.greatest(F.ceil(F.col("bytes") / chunk) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(body, i * chunk + 1, F.lit(chunk)))
    blocks = F.when(F.col("revisit"), F.array(F.lit(b""))).when(F.col("bytes") <= chunk, F.array(body)).otherwise(cut)
    chunks = rows.select("id", "url", "sha1", "bytes", "holder", "nth", "revisit", F.posexplode(blocks).alias("k", "block"))
    records = chunks.withColumns({c: F.col(c).cast("string") for c in ("id", "holder")}).mapInPandas(_records(chunk), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of archives, which come as pieces between ends of lines, to chunk rows. At most one record is held; one of a
    single chunk is digested at once, and only the chunks of longer records keep their bytes."""
    cols = ["record", "page", "chunk", "type", "digest", "refers", "stated", "body"]
    pieces = (bytes(x) + END for frame in frames for x in frame["value"])
    rows, held, rest = [], 0, b""
    for piece in pieces:
        data = bytearray(rest + piece)
        lines, _, data = data.partition(END)
        if not lines.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {bytes(lines[:40])!r}")
        head = {a.strip().decode().lower(): b.strip().decode() for a, _, b in (x.partition(b":") for x in lines.split(b"\r\n")[1:])}
        size = int(head["content-length"])
        while len(data) < size + len(END):
            data += next(pieces)
        block, rest = bytes(data[:size]), bytes(data[size + len(END) :])
        if data[size : size + len(END)] != END:
            raise ValueError("a WARC record is longer than it says")
        kind, stated = head["warc-type"], None
        if kind != "continuation":
            http, _, block = block.partition(END)
            stated = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
        record = (head.get("warc-segment-origin-id") or head["warc-record-id"]).strip("<>")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if "warc-segment-number" not in head:
            if kind == "response":
                _match(record, sha1_base32(block), digest, len(block), stated)
            block = None
        rows.append((record, _page(record), int(head.get("warc-segment-number", 1)), kind, digest, _page(head["warc-refers-to"].strip("<>")) if kind == "revisit" else None, stated, block))
        held += len(block or b"") + 200
        if held > 8 << 20:
            yield _frame(rows, cols)
            rows, held = [], 0
    if rows:
        yield _frame(rows, cols)


def _page(name: str) -> int | None:
    page = name.split(":")[3]
    return None if page == "none" else int(page)


def _frame(rows, cols) -> pd.DataFrame:
    columns = dict(zip(cols, zip(*rows)))
    return pd.DataFrame({c: exact(v) if c in ("page", "refers", "stated") else list(v) for c, v in columns.items()})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' chunked record table: record, page, chunk number, type, digest, refers, stated length, body. Archives are
    streamed by the text reader, never whole in memory."""
    pieces = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInPandas(_parse, "record string, page long, chunk int, type string, digest string, refers long, stated long, body binary")


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunk rows, ordered by record and chunk, to one row per record, by a digest that each chunk updates."""
    now = None
    for frame in frames:
        out = []
        for x in frame.itertuples(index=False):
            if x.chunk == 1:
                if now:
                    out.append(_closed(now))
                now = {"x": x._replace(body=None), "sha": hashlib.sha1(), "bytes": 0, "held": False}
            if x.body is not None:
                now["sha"].update(x.body)
                now["bytes"] += len(x.body)
                now["held"] = True
        yield _frame_of(out)
    if now:
        yield _frame_of([_closed(now)])


def _frame_of(rows) -> pd.DataFrame:
    columns = dict(zip(_COLS, zip(*rows))) if rows else {c: () for c in _COLS}
    return pd.DataFrame({c: exact(v) if c in ("page_id", "refers_to") else list(v) for c, v in columns.items()})


_COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _closed(now: dict) -> tuple:
    x = now["x"]
    if now["held"]:
        _match(x.record, base64.b32encode(now["sha"].digest()).decode(), x.digest, now["bytes"], x.stated)
    return None if x.page is None else int(x.page), int(x.stated), x.digest, x.type, int(x.refers) if x.type == "revisit" else None


def _match(record: str, made: str, digest: str, size: int, stated: int) -> None:
    if made != digest or size != stated:
        raise ValueError(f"{record}: the payload doesn't match its record's digest or length")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in `path`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Records of one chunk are digested where they are read; only the chunks of longer records are brought together, in
    order, and digested one after the other, so no record is ever whole in memory. A payload that doesn't match its
    digest is an error."""
    chunks = read_chunks(spark, path).withColumns({c: F.col(c).cast("string") for c in ("page", "refers")})
    return chunks.repartition("record").sortWithinPartitions("record", "chunk").mapInPandas(_whole, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0, url_col: str | None = "url") -> DataFrame:
    """write_warc to the shared folder, then read_warc of it."""
    path = work_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, payload, min_bytes, url_col=url_col if url_col in pages.columns else None)
    return read_warc(pages.sparkSession, path)
