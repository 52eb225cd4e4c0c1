"""Legacy archive converter: ARC files (versions 1 and 2) to WARC.

An ARC file opens with a version block that says how its record lines are laid
out; every record is one such line and as many bytes as the line declares.
From these the converter synthesises what WARC asks for: record ids, dates,
types and digests.  Records whose payload another record has already (the one
with the smallest key) become revisit records without payload.

Archives are written by Spark's text writer, whose line separator is the end
of a record, and read whole, one file at a time, from any store Spark reads.
Files are of a bounded size, as records are dealt to them by a hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.exact_dedup import decisions

#: Bytes of one archive, about; payloads from LEAST bytes on are stored once.
FILE_BYTES, LEAST = 16 << 20, 100
#: Date and address of pages that come without.
DATE, ADDRESS = "20000101000000", "0.0.0.0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Record-Key"

# The record lines of the two versions.
LAYOUT = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def _uri(url: Column) -> Column:
    """The url without characters that would end a field; null is ``-``."""
    for c, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(c), F.lit(code))
    return F.when(url == "", "-").otherwise(F.coalesce(url, F.lit("-")))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              file_bytes: int = FILE_BYTES) -> None:
    """Write pages as gzipped ARC files below ``path``, version 1 and 2 in turn.

    The key travels in an HTTP header, which a null key doesn't get.  A null
    page is an empty payload.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    total = pages.agg(F.sum(F.octet_length(body) + 300)).first()[0] or 0
    files = max(2, -(-total // file_bytes))
    key = F.coalesce(F.concat(F.lit(f"{KEY}: "), F.col(id_col).cast("string"), F.lit("\r\n")), F.lit(""))
    doc = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), key,
                   F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    version = (F.col("file") % 2 + 1).cast("int")
    lines = (pages.select(_uri(F.col(url_col)).alias("url"), doc.alias("doc"),
                          F.pmod(F.xxhash64(id_col, url_col, html_col), F.lit(files)).cast("int").alias("file"))
             .withColumn("n", F.octet_length("doc").cast("string")))
    one = F.concat_ws(" ", "url", F.lit(ADDRESS), F.lit(DATE), F.lit("text/html"), "n")
    two = F.concat_ws(" ", "url", F.lit(ADDRESS), F.lit(DATE), F.lit("text/html"), F.lit("200"), F.md5(F.col("doc").cast("binary")),
                      F.lit("-"), F.lit("0"), F.concat(F.lit("file-"), F.col("file").cast("string")), "n")
    records = lines.select("file", F.lit(1).alias("at"), F.concat(F.when(version == 1, one).otherwise(two), F.lit("\n"), F.col("doc")).alias("value"))
    about = F.concat(version.cast("string"), F.lit(" 0 tessera\n"), F.when(version == 1, LAYOUT[1]).otherwise(LAYOUT[2]), F.lit("\n"))
    name = F.concat(F.lit("filedesc://file-"), F.col("file").cast("string"))
    first = F.concat_ws(" ", name, F.lit(ADDRESS), F.lit(DATE), F.lit("text/plain"))
    first = F.when(version == 1, first).otherwise(F.concat_ws(" ", first, F.lit("200 - - 0"), F.concat(F.lit("file-"), F.col("file").cast("string"))))
    heads = pages.sparkSession.range(files).select(F.col("id").cast("int").alias("file"))
    heads = heads.select("file", F.lit(0).alias("at"), F.concat(first, F.lit(" "), F.octet_length(about).cast("string"), F.lit("\n"), about).alias("value"))
    (records.unionByName(heads).repartition(files, "file").sortWithinPartitions("file", "at").select("file", "value")
     .write.partitionBy("file").option("lineSep", "\n").option("compression", "gzip").text(path))


def unzipped(data: bytes) -> bytes:
    """The file's bytes; gzip files may hold one member or one for each record."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        data = z.unused_data
    return b"".join(out) if out else data


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, the version block first; raises where a line or length is wrong."""
    at, layout = 0, None
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the record line at byte {at}")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if layout is None:
            # the version block's own line has the layout that the block declares
            if not line.startswith("filedesc://"):
                raise ValueError("the file does not begin with a version block")
            block = data[end + 1:end + 4096].split(b"\n", 2)
            version = int(block[0].split(b" ")[0])
            layout = block[1].decode("ascii").split()
            if version not in LAYOUT or layout != LAYOUT[version].split():
                raise ValueError(f"unknown version or record line: {version} {layout}")
        parts = line.rsplit(" ", len(layout) - 1)  # a url may hold spaces
        if len(parts) != len(layout) or not parts[-1].isdigit():
            raise ValueError(f"bad record line at byte {at}: {line[:200]!r}")
        fields = dict(zip(layout, parts, strict=True))
        n = int(fields["Archive-length"])
        if end + 1 + n > len(data):
            raise ValueError(f"the record at byte {at} declares {n} bytes; the file ends before")
        fields["doc"], fields["version"] = data[end + 1:end + 1 + n], version
        yield fields
        at = end + 1 + n


def http_parts(doc: bytes) -> tuple[bytes, bytes]:
    """Header (with its empty line) and payload; a document that isn't an HTTP response is all payload."""
    if not doc.startswith(b"HTTP/"):
        return b"", doc
    cuts = [(i, len(s)) for s in (b"\r\n\r\n", b"\n\n") if (i := doc.find(s)) >= 0]
    if not cuts:
        return doc, b""
    i, n = min(cuts)
    return doc[:i + n], doc[i + n:]


def header_value(header: bytes, name: str) -> str | None:
    for line in header.split(b"\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon and k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


def _batches(rows: Iterator[tuple], kinds: list, names: list[str], weight) -> Iterator[pa.RecordBatch]:
    """Record batches of about 4 MB."""
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += weight(row) + 100
        if size > 4 << 20:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files below ``path``: uri, ip, date, mime, version, header, payload, digest, record_key."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                def rows(name=name, content=content):
                    try:
                        for r in arc_records(unzipped(content.as_py())):
                            header, payload = http_parts(r["doc"])
                            yield (r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], r["version"], header, payload,
                                   hashlib.sha256(payload).hexdigest(), header_value(header, KEY))
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                yield from _batches(rows(), [pa.string()] * 4 + [pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()],
                                    ["uri", "ip", "date", "mime", "version", "header", "payload", "digest", "record_key"], lambda r: len(r[6]))

    return _files(spark, path).mapInArrow(run, "uri string, ip string, date string, mime string, version int, header binary, payload binary, digest string, record_key string")


def record_id(key: Column, date: Column, digest: Column) -> Column:
    """A name-based UUID (version 8 layout) of key, date and payload digest."""
    h = F.md5(F.concat_ws("|", F.coalesce(key, F.lit("")), date, digest).cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def convert(records: DataFrame, least: int = LEAST) -> DataFrame:
    """One WARC record (column value, without its last two line ends) for each ARC record.

    Types: the version block gives warcinfo; an HTTP response gives response,
    or revisit if an equal payload of at least ``least`` bytes has a smaller
    key; anything else gives resource.  Records without a key, and records that
    repeat a key with its payload, are responses.
    """
    large = (F.length("payload") >= least) & (F.length("header") > 0) & F.col("record_key").isNotNull()
    keys = records.where(large).select(F.col("record_key").cast("bigint").alias("id"), "digest")
    first = decisions(keys, "id", digest=F.col("digest"))
    first = materialise(first.select(F.col("id").alias("key_"), F.col("text_sha256").alias("digest_"), "keep_id")
                        .where("key_ <> keep_id").distinct(), "revisits")
    d = records.join(first, (F.col("record_key").cast("bigint") == F.col("key_")) & (F.col("digest") == F.col("digest_")) & large, "left")
    info = F.col("uri").startswith("filedesc://")
    kind = (F.when(info, "warcinfo").when(F.col("keep_id").isNotNull(), "revisit")
            .when(F.length("header") > 0, "response").otherwise("resource"))
    d = d.withColumn("kind", kind).withColumn("http", F.col("header").cast("string")).withColumn("body", F.col("payload").cast("string"))
    block = F.when(F.col("kind") == "revisit", F.col("http")).otherwise(F.concat("http", "body"))
    date = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3T$4:$5:$6Z")
    mime = F.when(info, "application/arc-version-block").when(F.length("header") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))
    plain = F.col("kind") != "warcinfo"
    keep = F.col("keep_id").cast("string")

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise("")

    d = d.withColumn("block", block)
    revisit = F.col("kind") == "revisit"
    return d.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", record_id(F.col("record_key"), F.col("date"), F.col("digest"))),
        line("WARC-Date", date), line("WARC-Target-URI", F.col("uri"), plain), line("WARC-Filename", F.col("uri"), ~plain),
        line("WARC-IP-Address", F.col("ip"), plain), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"), plain),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.col("block").cast("binary"), 256))),
        line("WARC-Refers-To", F.coalesce(record_id(keep, F.col("date"), F.col("digest")), F.lit("")), revisit),
        line("WARC-Profile", F.lit(PROFILE), revisit), line("X-Refers-To-Key", F.coalesce(keep, F.lit("")), revisit),
        line("Content-Type", mime), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write converted records as gzipped WARC files; each record ends with two line ends."""
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of every record; raises where the form or a length is wrong."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4:end + 4 + n]
        at = end + 8 + n
        if len(block) < n or data[at - 4:at] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} does not end where its length says")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path``: record_key, record_id, record_type, uri, payload_bytes,
    payload_digest, refers_to (the key referred to) and payload (null in a revisit).

    Block and payload digests are recomputed; a difference raises.
    """
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                def rows(name=name, content=content):
                    try:
                        for f, block in warc_records(unzipped(content.as_py())):
                            if f["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                                raise ValueError(f"{f['warc-record-id']}: the block differs from its digest")
                            kind, header, payload = f["warc-type"], b"", block
                            if kind in ("response", "revisit"):
                                header, payload = http_parts(block)
                            digest = hashlib.sha256(payload).hexdigest()
                            size = len(payload)
                            if kind == "revisit":
                                digest, payload = f["warc-payload-digest"].removeprefix("sha256:"), None
                                size = int(header_value(header, "Content-Length") or 0)
                            elif kind != "warcinfo" and f["warc-payload-digest"] != f"sha256:{digest}":
                                raise ValueError(f"{f['warc-record-id']}: the payload differs from its digest")
                            yield header_value(header, KEY), f["warc-record-id"], kind, f.get("warc-target-uri"), size, digest, f.get("x-refers-to-key"), payload
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                yield from _batches(rows(), [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()],
                                    ["record_key", "record_id", "record_type", "uri", "payload_bytes", "payload_digest", "refers_to", "payload"],
                                    lambda r: len(r[7] or b""))

    return _files(spark, path).mapInArrow(run, "record_key string, record_id string, record_type string, uri string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
