r"""WARC archives: a deterministic sharded writer, and a reader.

Every row becomes a WARC/1.1 record whose headers and digests are made anew from the row.
Of rows with equal payloads of `least_bytes` or more, the one with the largest id is a
response, the others are revisits that name it and carry no payload again.

Which rows those are is found from (digest, length, id) alone: equal digests are counted and
their largest id kept, partial sums first, and the few that occur twice are joined back as
narrow rows. Payloads move once: they and the narrow verdicts go through one range partition
by id, and meet as neighbours in the sorted rows of a task.

A task writes its range in id order, each record a gzip member, and begins a new file when
the file's compressed size passes `roll_bytes`. Files are written under temporary names; the
task's rows report them. Only reported files are renamed (an attempt that was lost leaves
none), then the report is written as the manifest, by which readers find the files. The same
rows give the same bytes, as record ids and dates derive from the id and `date`.

Results of the odd cases: null html is an empty payload; rows with a null id sort first, and
are revisits where their payload has another row's id, else responses; repeated rows are
written once each, those with the largest id of their payload all as responses; an empty
table gives no file and no row. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, staged, table

LEAST_BYTES, ROLL_BYTES, DATE = 1000, 64 << 20, "2026-01-01T00:00:00Z"
LINE_END = b"\r\n"
MANIFEST = "temporary string, file string, part int, roll int, n_records long, first_id long, last_id long, n_bytes long, sha256 string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record: a response with its payload, or (refers_to) a revisit without."""
    sha1 = hashlib.sha1(payload).digest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return b"WARC/1.1\r\n" + lines + LINE_END + block + LINE_END + LINE_END


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, a gzip member each."""
    at, step = 0, 1 << 16
    while at < len(raw):
        unzip, data = zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= len(raw):
                raise ValueError("the archive ends within a record")
            data.append(unzip.decompress(raw[at : at + step]))
            at = min(at + step, len(raw)) - len(unzip.unused_data)
        head, _, rest = b"".join(data).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("this is no WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        yield fields, rest[: int(fields["Content-Length"])]


def checked(fields: dict[str, str], block: bytes) -> tuple[int | None, str, int, str, str, int | None]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a record whose
    digests hold."""
    if fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    n = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).digest() != digest or len(payload) != n:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return number(fields["X-Page-ID"]), fields["WARC-Target-URI"], n, digest.hex(), fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID"))


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the rows that repeat another row's payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    facts = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least_bytes)
    first = facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest", "refers_to")
    found = facts.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, n_shards: int, least_bytes: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of pages (page_id, url, html) in folder; the committed manifest."""
    again = revisits(pages, least_bytes)
    rows = pages.select("page_id", F.lit(1).alias("is_page"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    verdicts = again.select("page_id", F.lit(0).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    placed = rows.union(verdicts).repartitionByRange(n_shards, "page_id").sortWithinPartitions("page_id", "digest", "is_page", "url")
    placed = placed.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # numbers with nulls would be floats in pandas

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        made: list[tuple] = []
        out = sha = name = verdict = None
        n = size = 0
        first = last = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, f"{base}/pages-{part:06d}-{len(made):04d}.warc.gz", part, len(made), n, first, last, size, sha.hexdigest()))
                out = None

        for batch in batches:
            for page_id, is_page, url, html, digest, refers_to in batch.itertuples(index=False, name=None):
                page_id = None if page_id is None else int(page_id)
                if not is_page:  # of the rows behind it with this id and digest
                    verdict = (page_id, digest, int(refers_to))
                    continue
                target = verdict[2] if verdict and verdict[:2] == (page_id, digest) else None
                if out is None:
                    name = f"{base}/_tmp-{part:06d}-{len(made):04d}-{attempt}"
                    out, sha, n, size, first = store.open_output_stream(name), hashlib.sha256(), 0, 0, page_id
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = zipper.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), target)) + zipper.flush()
                out.write(member)
                sha.update(member)
                n, size, last = n + 1, size + len(member), page_id
                if size >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(made, columns=["temporary", "file", "part", "roll", "n_records", "first_id", "last_id", "n_bytes", "sha256"]).astype({"first_id": "Int64", "last_id": "Int64"})

    made = staged(placed.mapInPandas(run, MANIFEST), "warc-report")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for a, b in zip(batch["temporary"], batch["file"], strict=True):
                if store.get_file_info(a).type != fs.FileType.NotFound:  # else an earlier attempt has renamed it
                    store.move(a, b)
            yield batch

    return staged(made.mapInPandas(commit, made.schema).drop("temporary"), "warc-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the manifest's files, every digest checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha256 in zip(batch["file"], batch["sha256"], strict=True):
                with store.open_input_stream(name, compression=None) as f:
                    raw = f.read()
                if hashlib.sha256(raw).hexdigest() != sha256:
                    raise ValueError(f"{name} is not what the manifest says")
                rows = []
                for fields, block in records(raw):
                    rows.append(checked(fields, block))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.select("file", "sha256").repartition(max(1, manifest.count()), "file").mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, n_shards: int | None = None, least_bytes: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    manifest = write(pages, folder, n_shards or int(spark.conf.get("spark.sql.shuffle.partitions")), least_bytes, roll_bytes)
    return read(manifest, folder)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM m
"""
