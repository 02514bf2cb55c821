"""WARC archives with revisit resolution.

Of the records with equal payloads of at least MIN_BYTES bytes, the one with the smallest id is the response; the others become
revisit records of it, without payload. Only headers are shuffled by payload digest to find these: (id, url, digest), pre-aggregated per digest. The
decisions are stored and joined to the pages by id and digest, so that copies of one page are spread over the tasks; a page that repeats with its id can be
split by adaptive execution, as both sides of the join are plain. The archives are written
by the tasks, a gzip member per record, into the shared folder, with fresh headers. A file that a lost or repeated task
leaves behind is named nowhere: only the manifest, which Spark commits once, says which files are archives.
Archives are read back by as many tasks as there are files, record by record, so memory follows the largest payload. Revisit records are joined to the original
responses by payload digest, which gives their payload's size and the page they refer to.

Null html: an empty payload. A null id is never the smallest: where all of a group's are null, all are responses; else those are revisits.
Rows that repeat the smallest id of their payload are responses too. A null url writes no target header. An empty table gives an empty result.
Only id, url and payload are archived; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import discard, key_filter, materialize, new_path, plain, read, with_maybe

MIN_BYTES = 100
#: An archive file is closed, and the next one begun, from this size on.
FILE_BYTES = 1 << 30
#: Pages have no date of their own; the records of a run carry this one.
CAPTURED = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs


def decisions(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, original, original_url) of the pages that become revisits, stored; original is the page to refer to."""
    html = F.coalesce(F.col(plain(payload)), F.lit(""))
    headers = pages.where(F.octet_length(html) >= min_bytes).select(F.col(plain(id_column)).alias("page_id"), F.col(plain(url)).alias("url"), F.sha2(html, 256).alias("digest"))
    headers = materialize(headers, "warc-digests")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    originals = headers.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    originals = materialize(originals.select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "warc-originals")
    revisits = headers.select("page_id", "digest").join(originals, "digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    out = materialize(revisits.distinct(), "warc-decisions")
    discard(headers, originals)
    return out


def resolve(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, digest, original, original_url): original is the page to refer to, null for responses. Only pages that a filter of the decisions (of bounded size) can't clear are shuffled."""
    html = F.coalesce(F.col(plain(payload)), F.lit(""))
    rows = pages.select(F.col(plain(id_column)).alias("page_id"), F.col(plain(url)).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    made = decisions(pages, id_column, url, payload, min_bytes).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "original", "original_url")
    bits = materialize(key_filter(made, F.xxhash64("id", "of")), "warc-filter")
    marked = with_maybe(rows, F.xxhash64("page_id", "digest"), bits)
    kinds = {f.name: f.dataType for f in made.schema}
    clear = marked.where("NOT __tm_maybe").select(*rows.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in ("original", "original_url")))
    maybe = marked.where("__tm_maybe").select(*rows.columns)
    return clear.union(maybe.join(made, maybe["page_id"].eqNullSafe(made["id"]) & (maybe["digest"] == made["of"]), "left").select(*rows.columns, "original", "original_url"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def _header(pairs: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in pairs if v is not None) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, original_url: str | None) -> bytes:
    """A WARC record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if original is not None else http + payload
    pairs = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", CAPTURED), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", page_id)]
    if original is not None:
        pairs += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(original, digest)), ("WARC-Refers-To-Target-URI", original_url), ("WARC-Refers-To-Date", CAPTURED)]
    pairs += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return _header(pairs) + block + b"\r\n\r\n"


def write_archives(resolved: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of resolve() under folder; the manifest, stored: path, records, bytes."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        out, path, n, size = None, "", 0, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None), 0, 0
                page_id, original = (None if pd.isna(x) else int(x) for x in (row.page_id, row.original))
                data = gzip.compress(record(page_id, row.url, row.html.encode(), row.digest, original, row.original_url), 6, mtime=0)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    texts = resolved.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("original").cast("string"), "original_url")  # ids as strings: pandas has no long with nulls
    return materialize(texts.mapInPandas(write, "path string, records bigint, bytes bigint"), "warc-manifest")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        yield head, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """A task per file. The headers of the archives' records: page_id, record_type, digest, payload_bytes (null for revisits), whole: the payload has its digest."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for path in frame["path"]:
                store, place = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        response = head["warc-type"] == "response"
                        rows.append((head.get("warc-page-id"), head["warc-type"], digest, str(len(payload)) if response else None, hashlib.sha256(payload).hexdigest() == digest if response else True))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "record_type", "digest", "payload_bytes", "whole"]
    files = manifest.count()
    found = manifest.select("path").repartitionByRange(max(1, files), "path").mapInPandas(scan, "page_id string, record_type string, digest string, payload_bytes string, whole boolean")
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "payload_bytes": F.col("payload_bytes").cast("long")})


def resolved_records(headers: DataFrame) -> DataFrame:
    """Each record's page_id, payload_bytes, payload_digest, record_type and refers_to; revisits get theirs from the response. headers: stored, of read_archives()."""
    broken = F.assert_true(F.col("whole"), "a payload doesn't have its digest")
    headers = headers.where(broken.isNull())
    revisits, responses = headers.where("record_type = 'revisit'"), headers.where("record_type = 'response'")
    # Stored, so that the join with the many revisits of one response can be split.
    originals = materialize(responses.groupBy("digest").agg(F.min("page_id").alias("original"), F.first("payload_bytes").alias("size")), "warc-responses")
    known = revisits.select("page_id", "digest", "record_type").join(originals, "digest").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("original").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(known)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(resolve(read(spark, sf_dir, "pages")), new_path(spark, "warc"))
    return resolved_records(materialize(read_archives(manifest), "warc-headers"))


QUERIES = {"op3_warc": op3_warc}

ORACLE_SQL = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
}
