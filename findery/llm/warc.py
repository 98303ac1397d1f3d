"""Operator 1: Merkle fixity audit of WARC replicas.

A replica is a table of records: archive, offset, length and digest (SHA-256 of the
record's bytes).  Per archive, records whose offset is in the same range of
``RANGE`` bytes form a node, hashed over (offset, length, digest) in order of
offset; ``FANOUT`` neighbouring ranges form a node of the next level, up to one root
per archive.  A node holds a bounded number of children, whatever the archive's
size, and no record needs its rank.

The audit compares roots and descends only into nodes that differ, down to the
records that are corrupt, missing or extra.  Each level is written once and read by
a semi-join with the differing parents.

``serialise`` makes WARC/1.0 response records of pages and lays them out in
archives of ``PAGES`` pages by id, in order of (page_id, url, digest), nulls first.
Pages without an id are dealt by a hash to archives of their own, of about ``PAGES`` each.  A NULL url or
html is empty.  Pages that repeat an id, and repeated pages, are records of their own.  ``read_warc`` makes the index of WARC files that exist.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.llm.common import Scratch, table

RANGE, FANOUT, PAGES = 65_536, 16, 512
READ, PEEK, MOST_HEAD, NEXT = 1 << 20, 1024, 1 << 20, b"\r\n\r\nWARC/"
LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n")


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = [F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url]
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def serialise(pages: DataFrame, *more: Column) -> DataFrame:
    """(archive, page_id, url, length, digest, ..., offset): the index of the archives that hold the pages.

    Bodies become lengths and digests before anything is shuffled, whatever their size.  Columns
    besides page_id, url and html are not looked at.
    """
    without = pages.filter(F.col("page_id").isNull()).count()
    lost = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(max(1024, without // PAGES)))
    archive = F.coalesce(F.floor(F.col("page_id") / PAGES), lost).cast("long").alias("archive")
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    sized = pages.select(archive, "page_id", "url", F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"), *more)
    before = W.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def next_member(held: bytes, end: bool) -> int:
    """Where the first gzip member begins that holds a WARC record; -1 if none does, or (before the end) too little of it is there."""
    at = -1
    while (at := held.find(b"\x1f\x8b\x08", at + 1)) >= 0:
        if not end and len(held) - at < PEEK:
            return -1
        try:
            if zlib.decompressobj(31).decompress(held[at : at + PEEK], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
    return -1


def member_bounds(parts: Iterator[bytes]) -> Iterator[tuple[int, int, str]]:
    """(offset, length, SHA-256) of the members of a gzip stream, over the stored bytes.

    A damaged member reaches to the next one that holds a WARC record, or to the end of the file.
    """
    at, size, sha, member, held, broken = 0, 0, hashlib.sha256(), zlib.decompressobj(31), b"", False
    for data in itertools.chain(parts, [None]):
        held, end = held + (data or b""), data is None
        while held:
            ended = False
            if broken:
                found = next_member(held, end)
                ended = found >= 0
                used = found if ended else len(held) if end else max(0, len(held) - PEEK)
            else:
                try:
                    todo = held
                    while todo:  # what it holds is not kept
                        member.decompress(todo, READ)
                        todo = member.unconsumed_tail
                    ended = member.eof
                    used = len(held) - len(member.unused_data)
                except zlib.error:
                    broken, used = True, 1
            size += used
            sha.update(memoryview(held)[:used])
            held = held[used:]
            if ended:
                yield at, size, sha.hexdigest()
                at, size, sha, member, broken = at + size, 0, hashlib.sha256(), zlib.decompressobj(31), False
            elif broken and used != 1:
                break  # until there is more
    if size:
        yield at, size, sha.hexdigest()


def record_bounds(parts: Iterator[bytes]) -> Iterator[tuple[int, int, str]]:
    """(offset, length, SHA-256) of the records of a plain WARC stream.

    A record whose head or length can't be followed reaches to the next
    ``WARC/`` after an empty line, or to the end of the file.
    """
    held, pos, at, end = b"", 0, 0, False

    def more() -> bool:
        nonlocal held, pos, end
        data = next(parts, b"")
        held, pos, end = held[max(0, pos - 4) :] + data, min(pos, 4), not data
        return not end

    while pos < len(held) or more():
        sha, size = hashlib.sha256(), 0

        def take(n: int) -> None:
            nonlocal pos, size
            n = min(n, len(held) - pos)
            sha.update(memoryview(held)[pos : pos + n])
            pos, size = pos + n, size + n

        while (head := held.find(NEXT[:4], pos)) < 0 and len(held) - pos < MOST_HEAD and more():
            pass
        known = LENGTH.search(held, pos, head + 2) if head >= 0 and held.startswith(NEXT[4:], pos) else None
        if known:
            left = head - pos + 4 + int(known[1]) + 4
            while left > len(held) - pos:
                left -= len(held) - pos
                take(len(held))
                if not more():
                    break
            else:
                take(left)
        else:
            take(1)
        while (found := held.find(NEXT, max(0, pos - 4))) < 0 and not end:  # at once, if all is well
            take(max(0, len(held) - pos - 8))
            more()
        take(found + 4 - pos if found >= 0 else len(held))
        yield at, size, sha.hexdigest()
        at += size


def read_warc(spark: SparkSession, paths: str, tasks: int | None = None) -> DataFrame:
    """(archive, page_id, offset, length, digest) of every record of the WARC files, plain or gzipped, that ``paths`` names.

    Each file is read once, as a stream in one task, through pyarrow's filesystems;
    memory does not grow with files or records.  ``archive`` is the file's path below the folder
    that ``paths`` names (of a pattern, the part before the first wildcard), so replicas in two
    folders can be audited against each other; ``page_id`` is NULL.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")  # the content is not read
    plain = re.split(r"[*?\[{]", urlsplit(paths).path, maxsplit=1)
    root = (plain[0] if len(plain) == 1 else plain[0].rpartition("/")[0]).rstrip("/") + "/"
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            fs, name = FileSystem.from_uri(path)
            with fs.open_input_stream(name, compression=None) as f:
                first = f.read(READ)
                parts = itertools.chain([first], iter(lambda: f.read(READ), b"")) if first else iter(())
                found = member_bounds(parts) if first.startswith(b"\x1f\x8b") else record_bounds(parts)
                while rows := list(itertools.islice(found, 10_000)):
                    archive = [name.removeprefix(root) if name != root[:-1] else name.rsplit("/", 1)[-1]] * len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([archive, [None] * len(rows), *map(list, zip(*rows))], schema)], schema=schema)

    return files.repartition(tasks or spark.sparkContext.defaultParallelism, "path").mapInArrow(run, "archive string, page_id long, offset long, length long, digest string")


def levels(records: DataFrame, height: int, scratch: Scratch) -> list[DataFrame]:
    """The tree, from the records (level 0) to the roots: (archive, node, parent, digest, ...)."""
    leaf = records.select("archive", "page_id", "offset", "length", "digest", F.floor(F.col("offset") / RANGE).cast("long").alias("parent"))
    out = [scratch.keep(leaf, "level0")]
    for k in range(1, height + 1):
        order = ["offset", "length", "digest"] if k == 1 else ["node", "digest"]
        inner = F.array_sort(F.collect_list(F.struct(*order)))
        digest = F.sha2(F.concat_ws("\n", F.transform(inner, lambda x: F.concat_ws(" ", *(x[c].cast("string") for c in order)))).cast("binary"), 256)
        up = out[-1].groupBy("archive", F.col("parent").alias("node")).agg(digest.alias("digest"))
        out.append(scratch.keep(up.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")), f"level{k}"))
    return out


def height_for(*replicas: DataFrame) -> int:
    """Levels above the records, so that the top one has a single node for each archive."""
    most, k = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // RANGE, 1
    while most:
        most, k = most // FANOUT, k + 1
    return k


def audit(primary: DataFrame, replica: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(archive, page_id, offset, length, verdict, digest, replica_digest): the records that differ.

    Both have archive, page_id, offset, length, digest; other columns play no part.  ``verdict``: corrupt, missing
    (in the replica) or extra.  Records are the same if offset, length and digest are; a
    record that one replica repeats more often than the other differs too.  There is one row for
    each archive and offset, NULL being a value like others.  Equal replicas and empty tables give no rows;
    if only one is empty, each record of the other is missing or extra.
    """
    scratch = scratch or Scratch(primary.sparkSession)
    ours = scratch.keep(primary.select("archive", "page_id", "offset", "length", "digest"), "primary")
    theirs = scratch.keep(replica.select("archive", "page_id", "offset", "length", "digest"), "replica")
    height = height_for(ours, theirs)
    a, b = levels(ours, height, scratch), levels(theirs, height, scratch)
    differing = None
    for k in range(height, 0, -1):
        sides = [t[k].select("archive", "node", "parent", "digest", F.lit(i).alias("side")) for i, t in enumerate((a, b))]
        nodes = sides[0].unionByName(sides[1])
        if differing is not None:
            nodes = _below(nodes, differing)
        digests = [F.max(F.when(F.col("side") == i, F.col("digest"))) for i in (0, 1)]
        differing = scratch.keep(nodes.groupBy("archive", "node").agg(digests[0].alias("d"), digests[1].alias("e")).filter(~F.col("d").eqNullSafe(F.col("e"))).select("archive", "node"), f"differing{k}")
    names = ("archive", "page_id", "offset", "length", "digest")
    sides = [_below(t[0], differing).select(*names, F.lit(i).alias("side")) for i, t in enumerate((a, b))]
    # records that one replica has more often than the other, then one row for each place
    held = [F.sum((F.col("side") == i).cast("int")) for i in (0, 1)]
    odd = sides[0].unionByName(sides[1]).groupBy("archive", "offset", "length", "digest").agg(held[0].alias("n"), held[1].alias("m"), F.min("page_id").alias("page_id")).filter("n <> m")
    one = F.struct("page_id", "length", "digest")
    found = odd.groupBy("archive", "offset").agg(F.min(F.when(F.col("n") > F.col("m"), one)).alias("x"), F.min(F.when(F.col("n") < F.col("m"), one)).alias("y"))
    verdict = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return found.select(
        "archive", F.coalesce("x.page_id", "y.page_id").alias("page_id"), "offset", F.coalesce("x.length", "y.length").alias("length"),
        verdict.alias("verdict"), F.col("x.digest").alias("digest"), F.col("y.digest").alias("replica_digest"),
    )


def _below(nodes: DataFrame, differing: DataFrame) -> DataFrame:
    """The nodes or records whose parent differs."""
    same = F.col("x.archive").eqNullSafe(F.col("p.archive")) & F.col("x.parent").eqNullSafe(F.col("p.node"))
    return nodes.alias("x").join(differing.alias("p"), same, "left_semi")


def faulty_digest() -> Column:
    """For trials, the digest of a page's record in a bad replica: by page_id, a wrong first character, an erased body, none (NULL), or the right one."""
    kind = F.pmod(F.col("page_id") * 37, F.lit(101))
    html = F.when(kind == 0, F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).when(kind == 1, F.regexp_replace("html", r"[\s\S]", "0")).otherwise(F.col("html"))
    digest = F.sha2(record_bytes(F.col("page_id"), F.col("url"), html).cast("binary"), 256)
    return F.when(kind.isNull() | (kind != 2), digest)


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a copy with planted faults."""
    scratch = Scratch(spark)
    records = scratch.keep(serialise(table(spark, sf_dir, "pages"), faulty_digest().alias("copy")), "records")
    replica = records.filter(F.col("copy").isNotNull()).withColumn("digest", F.col("copy"))
    return audit(records, replica, scratch)


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, (page_id // 512)::BIGINT AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
         (page_id * 37) % 101 AS kind
  FROM pages),
r AS (
  SELECT *, head || strlen(coalesce(html, ''))::VARCHAR || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2) AS rec,
         CASE kind WHEN 0 THEN '~' || substr(html, 2) WHEN 1 THEN repeat('0', length(html)) ELSE html END AS bad
  FROM p),
o AS (
  SELECT *, strlen(rec)::BIGINT AS length, sha256(rec) AS digest,
         coalesce(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id, url, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
         sha256(head || strlen(coalesce(bad, ''))::VARCHAR || repeat(chr(13) || chr(10), 2) || coalesce(bad, '') || repeat(chr(13) || chr(10), 2)) AS other
  FROM r)
SELECT archive, page_id, "offset", length, CASE kind WHEN 2 THEN 'missing' ELSE 'corrupt' END AS verdict, digest,
       CASE WHEN kind <> 2 THEN other END AS replica_digest
FROM o WHERE kind <= 2 AND (kind = 2 OR digest <> other)
"""
