"""WARC archives under Zstandard: a writer of pages and a reader of any such archive.

Layout: a leading skippable frame holds the dictionary (plain or compressed), then each record is one frame. Both ways go
through Spark's text source, which reads and writes raw bytes in any store, commits whole tasks and splits large archives:

* Writing, a task gives its dictionary frame and then a row a record; the line separator is an empty skippable frame, which
  readers of the format pass over.
* Reading, lines are cut at the magic number of a frame, so memory holds a record, not an archive (but for archives whose
  names end in ``.zst``, which the text source would decompress: they are read whole and must fit a task). Compressed bytes may hold
  that number by chance, so frames are put together again from their own headers (`_frame_end`); what lies across the border
  of two splits is gathered by archive and joined. One pass finds the dictionaries, one these remains, the last decodes.

A frame must hold exactly one record; its version, mandatory fields, Content-Length, closing line ends, the length of the HTTP
body and the SHA-1 of the payload are checked, and the first fault is told in ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import HOT_ROWS, HOT_SHARE, folder, stored

# Fixed values of the two formats.
FRAME, SKIPPABLE, DICTIONARY = b"\x28\xb5\x2f\xfd", range(0x184D2A50, 0x184D2A60), b"\x5d\x2a\x4d\x18"
NAMED = r"\.zstd?$"
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")

DATE = "2000-01-01T00:00:00Z"
#: Bounds: what teaches a dictionary, repeated payloads that are broadcast, dictionaries that are broadcast at once.
TEACHERS, TEACHER_BYTES, DICTIONARY_SIZE = 300, 16_384, 65_536
BROADCAST_KEYS, BROADCAST_BYTES = 100_000, 64 << 20
LEVEL, BATCH_BYTES = 3, 1 << 21

RECORD = "archive string, record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"
_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


# Writing ----------------------------------------------------------------------------------------------------------------


def _dictionary(pages: DataFrame) -> bytes | None:
    """Taught by about ``TEACHERS`` pages drawn at random, whole ones of up to ``TEACHER_BYTES``; None if they are too few to teach one."""
    drawn = pages.where(F.rand(1) < TEACHERS / max(1, pages.count())).where(F.length("payload").between(1, TEACHER_BYTES))
    samples = [bytes(r.payload) for r in drawn.select("payload").limit(2 * TEACHERS).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_SIZE, max(256, sum(map(len, samples)) // 10)), samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _encoded(page_id, uri: bytes | None, payload: bytes, first) -> bytes:
    """The record of a page; first: the page_id of the response that it revisits, or None."""
    kept = first is None or first == page_id
    uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], uri or b"") or f"urn:page:{page_id}".encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if kept else b"")
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if kept else b"revisit"), f"WARC-Record-ID: <urn:page:{page_id}>".encode(), f"WARC-Date: {DATE}".encode(), b"WARC-Target-URI: " + uri,
        f"WARC-Payload-Digest: sha1:{_base32(hashlib.sha1(payload).digest())}".encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    if not kept:
        head += [f"WARC-Profile: {REVISIT}".encode(), f"WARC-Refers-To: <urn:page:{first}>".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weigh(row)
        if size > BATCH_BYTES:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _framed(taught: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes]]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(taught)} if taught else {}))
        if taught:
            yield (DICTIONARY + len(taught).to_bytes(4, "little") + taught,)
        for batch in batches:
            for i in range(batch.num_rows):
                yield (pack.compress(_encoded(*(c[i].as_py() for c in batch.columns))),)

    return lambda batches: _batches(frames(batches), [pa.binary()], ["value"], lambda row: len(row[0]))


def with_first(pages: DataFrame, within: str) -> DataFrame:
    """pages with ``first``: the least page_id of the same payload, where more than one row has it.

    Copies are counted by hash before anything is shuffled. Few repeated payloads are broadcast; of more than
    ``BROADCAST_KEYS`` those with very many rows are broadcast (at most ``HOT_SHARE``) and the others joined by hash.
    """
    counts = pages.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    again = stored(counts.where("n > 1"), "copies", within)
    size = again.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if size["keys"] <= BROADCAST_KEYS:
        return pages.join(F.broadcast(again.drop("n")), "key", "left")
    hot = again.where(F.col("n") > max(HOT_ROWS, size["rows"] // HOT_SHARE)).drop("n")
    few = pages.join(F.broadcast(hot), "key")
    return few.unionByName(pages.join(F.broadcast(hot.select("key")), "key", "left_anti").join(again.drop("n"), "key", "left"))


def write_archives(pages: DataFrame, root: str) -> None:
    """pages (page_id, url, html) to archives in a new folder, one a task.

    Of equal payloads the row with the smallest page_id is a response and all others revisit it; rows that repeat that page_id
    are responses too. A null page_id is never the smallest, and without another id all copies are responses. Null html is an empty
    payload; a null or empty url becomes ``urn:page:<page_id>``, blanks and control characters in it are escaped.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    held = pages.select("page_id", F.col("url").cast("binary").alias("uri"), html.alias("payload"), F.sha2(html, 256).alias("key"))
    rows = with_first(held, folder(pages.sparkSession, "warc")).select("page_id", "uri", "payload", "first")
    frames = rows.mapInArrow(_framed(_dictionary(held)), "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", 0).text(root)


# Reading ----------------------------------------------------------------------------------------------------------------


def _frame_end(data: bytes, at: int) -> int | None:
    """Where the frame that begins at ``at`` ends; None if it goes on beyond the data; an error if no frame begins there."""
    try:
        if int.from_bytes(data[at : at + 4], "little") in SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little") if at + 8 <= len(data) else len(data) + 1
            return end if end <= len(data) else None
        if data[at : at + 4] != FRAME:
            if len(data) - at < 4:
                return None
            raise ValueError("no frame begins here")
        says = data[at + 4]
        single, checked = says >> 5 & 1, says >> 2 & 1
        if says & 8:
            raise ValueError("a reserved bit is set")
        at += 5 + (not single) + (0, 1, 2, 4)[says & 3] + (single, 2, 4, 8)[says >> 6]
        last = 0
        while not last:
            block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("a block has no known kind")
            at += 3 + (1 if kind == 1 else size)
        at += 4 * checked
        return at if at <= len(data) else None
    except IndexError:
        return None


def _cut(data: bytes) -> tuple[list[bytes], bytes, str | None]:
    """The whole frames at the beginning of the data, what is left, and why no frame begins there."""
    frames, at = [], 0
    while at < len(data):
        try:
            end = _frame_end(data, at)
        except ValueError as e:
            return frames, data[at:], str(e)
        if end is None:
            break
        frames.append(data[at:end])
        at = end
    return frames, data[at:], None


def _frames(lines: Iterator[tuple[str, int, bytes]], sound: Callable[[str, bytes], bool]) -> Iterator[tuple[str, int, int, bytes]]:
    """(archive, split, kind, bytes) from the lines of splits, in order.

    Kinds: 0 a whole frame, 1 what comes before the first frame of a later split, 2 what is not whole at the end of a split. A later
    split begins with the rest of a frame if a magic number in that frame was taken for an end of line, so its first frame
    is the first that is ``sound``. What is no frame and not at a border has kind 0 too: it is a fault of the archive.
    """
    now, left, starts = None, b"", []  # starts: where the first frame of a later split may begin; empty: it is found
    for archive, start, line in lines:
        if (archive, start) != now:
            if left:
                yield *now, 1 if starts else 2, left
            now, left, starts = (archive, start), line if start == 0 else FRAME + line, [0] if start else []
        else:
            starts = [*starts, len(left)] if starts else starts
            left += FRAME + line
        for at in starts:
            found, _, fault = _cut(left[at:])
            if found and sound(archive, found[0]):
                if at:
                    yield *now, 1, left[:at]
                left, starts = left[at:], []
                break
        if starts:
            continue
        whole, left, fault = _cut(left)
        for frame in whole:
            yield *now, 0, frame
        if fault:
            yield *now, 0, left
            left = b""
    if left:
        yield *now, 1 if starts else 2, left


def _payload(kind: bytes, fields: dict[bytes, bytes], block: bytes) -> tuple[bytes, int]:
    """The payload of a record and the length of the full one."""
    if kind not in (b"response", b"revisit") or not fields.get(b"content-type", b"").startswith(b"application/http"):
        return block, len(block)
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    if kind == b"response":
        if told and int(told[1]) != len(payload) and not re.search(rb"(?im)^transfer-encoding:", head):
            raise ValueError("the HTTP length is another")
        return payload, len(payload)
    if payload:
        raise ValueError("a revisit has a payload")
    return payload, int(told[1]) if told else 0


def _record(data: bytes) -> tuple:
    """(record_id, record_type, uri, refers_to, payload_digest, payload_bytes, payload) of a record; an error names the first fault."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    if any(b":" not in x for x in lines):
        raise ValueError("a field has no name")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(b":") for x in lines)}
    if missing := [x.decode() for x in MANDATORY if not fields.get(x)]:
        raise ValueError(f"{missing[0]} is missing")
    if not fields[b"content-length"].isdigit() or len(rest) != int(fields[b"content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the record's length is another")
    kind = fields[b"warc-type"].lower()
    payload, size = _payload(kind, fields, rest[:-4])
    scheme, _, digest = fields.get(b"warc-payload-digest", b"").partition(b":")
    if kind == b"response" and scheme == b"sha1" and digest.decode(errors="replace") != _base32(hashlib.sha1(payload).digest()):
        raise ValueError("the payload's digest is another")
    text = lambda x: x.decode(errors="replace") if x else None
    plain = lambda x: text(x.strip(b"<>")) if x else None
    return plain(fields[b"warc-record-id"]), text(kind), text(fields.get(b"warc-target-uri")), plain(fields.get(b"warc-refers-to")), text(digest), size, payload


def _opened(frame: bytes, packs: dict, taught: bytes | None) -> tuple:
    """The record of a frame; what is wrong with it in place of that."""
    if taught not in packs:
        packs[taught] = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(taught)} if taught else {}))
    try:
        opened = packs[taught].decompressobj()
        record = opened.decompress(frame)
        if not opened.eof:
            raise ValueError("the frame is not whole")
        return *_record(record), None
    except (zstandard.ZstdError, ValueError) as e:
        return *[None] * 7, str(e)


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        archive, start, value = batch.columns
        for i in range(batch.num_rows):
            yield archive[i].as_py(), start[i].as_py(), value[i].as_py()


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """(archive, start, value): the lines of each split. Spark's text source would decompress names that end in ``.zst``, so those are read whole."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", FRAME.decode("latin-1")).text(root)
    lines = lines.where(~F.col("_metadata.file_name").rlike(NAMED)).select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zst,zstd}").load(root)
    return lines.unionByName(whole.select(F.col("_metadata.file_path").alias("archive"), F.lit(0).cast("long").alias("start"), F.col("content").alias("value")))


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading dictionary frames, from the first splits."""

    def found() -> Iterator[tuple]:
        begun = None
        for archive, _, _, data in _frames(_split_rows(batches), lambda *_: True):
            if archive != begun and data.startswith(DICTIONARY):
                yield archive, data
            begun = archive

    return _batches(found(), [pa.string(), pa.binary()], ["archive", "data"], lambda row: len(row[1]))


def _plain(frame: bytes) -> bytes:
    """The dictionary in a skippable frame."""
    return zstandard.ZstdDecompressor().decompressobj().decompress(frame[8:]) if frame[8:12] == FRAME else frame[8:]


def read_archives(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """(archive, record_id, record_type, uri, refers_to, payload_digest, payload_bytes, payload, error): a row a record.

    Frames that are no valid record have an ``error`` and nulls. ``payload_bytes`` of a revisit is the length that its HTTP
    header tells; ``payload`` is null if not asked for. Archives without a dictionary frame are read without one. Dictionaries are
    broadcast, up to ``BROADCAST_BYTES`` at once: with more of them the archives are read in groups.
    """
    lines, within = _lines(spark, root), folder(spark, "warc")
    heads = stored(lines.where("start = 0").mapInArrow(_dictionaries, "archive string, data binary"), "dictionaries", within).withColumn("digest", F.sha2("data", 256))
    names = {r.archive: r.digest for r in heads.select("archive", "digest").collect()}
    sizes = heads.groupBy("digest").agg(F.max(F.length("data")).alias("size")).orderBy("digest").collect()
    groups: list[list[str]] = [[]]
    used = 0
    for r in sizes:
        if groups[-1] and used + r.size > BROADCAST_BYTES:
            groups.append([])
            used = 0
        groups[-1].append(r.digest)
        used += r.size
    out = None
    for k, digests in enumerate(groups):
        own = {a: d for a, d in names.items() if d in digests}
        found = heads.where(F.col("digest").isin(digests)).groupBy("digest").agg(F.first("data").alias("data")).collect() if digests else []
        taught = spark.sparkContext.broadcast((own, {r.digest: _plain(bytes(r.data)) for r in found}))
        mine = F.lit(True) if len(groups) == 1 else F.col("archive").isin([*own]) | (F.lit(k == 0) & ~F.col("archive").isin([*names]))  # the first group has those without a dictionary
        own_lines = lines.where(mine)
        torn = stored(own_lines.mapInArrow(_torn(taught), "archive string, start long, kind int, data binary"), "torn", within)
        part = own_lines.mapInArrow(_decoded(taught, payload), RECORD).unionByName(torn.groupBy("archive").applyInPandas(_joined(taught, payload), RECORD))
        out = part if out is None else out.unionByName(part)
    return out


def _row(archive: str, frame: bytes, packs: dict, taught: tuple[dict, dict], payload: bool) -> tuple:
    names, dictionaries = taught
    *most, body, error = _opened(frame, packs, dictionaries.get(names.get(archive)))
    return archive, *most, body if payload else None, error


def _held(batches: Iterator[pa.RecordBatch], taught, packs: dict) -> Iterator[tuple[str, int, int, bytes]]:
    return _frames(_split_rows(batches), lambda archive, frame: _row(archive, frame, packs, taught.value, False)[-1] is None)


def _torn(taught) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is not whole inside a split."""
    kinds, names = [pa.string(), pa.int64(), pa.int32(), pa.binary()], ["archive", "start", "kind", "data"]
    return lambda batches: _batches((x for x in _held(batches, taught, {}) if x[2]), kinds, names, lambda row: len(row[3]))


def _decoded(taught, payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        packs: dict = {}
        for archive, _, kind, frame in _held(batches, taught, packs):
            if kind == 0 and int.from_bytes(frame[:4], "little") not in SKIPPABLE:
                yield _row(archive, frame, packs, taught.value, payload)

    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
    return lambda batches: _batches(records(batches), kinds, _COLUMNS, lambda row: len(row[7] or b""))


def _joined(taught, payload: bool) -> Callable:
    """The frames of an archive that lay across splits."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, packs, out, left = rows.sort_values(["start", "kind"]), {}, [], b""
        for r in rows.itertuples():
            whole, left, fault = _cut(left + bytes(r.data))
            if fault:
                whole, left = [*whole, left], b""
            out += [_row(r.archive, x, packs, taught.value, payload) for x in whole if int.from_bytes(x[:4], "little") not in SKIPPABLE]
        if left:  # the archive ends inside a frame
            out.append((rows.archive.iloc[0], *[None] * 7, "the archive ends inside a frame"))
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages that were written to archives and read back; a record with a fault ends the query."""
    spark = pages.sparkSession
    root = f"{folder(spark, 'warc')}/archives"
    write_archives(pages, root)
    kind = pages.schema["page_id"].dataType
    own = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    number = lambda c: F.when(own(c) != "", own(c)).cast(kind)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_type"))
    return read_archives(spark, root, payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), number("refers_to").alias("refers_to"))
