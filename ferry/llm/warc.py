"""WARC archives: written by Spark's text writer, read back by boundary chains.

Writing. Each page is one record; of records with equal payloads the one with
the largest page_id is the response and the others are revisits that refer to
it. A record is one string, and the writer's line separator is the blank lines
that end a record, so a part file is a plain concatenation of records, written
in parallel through Spark's commit protocol to any store Spark can write.

Reading. The record magic may also occur inside payloads, and splits start
anywhere. Spark's text reader, with the magic as its line separator, cuts the
files at every occurrence in parallel splits, and each piece is a *candidate*
record. A task emits per candidate its offset and the offset of its successor
(end of its declared length). Only candidates on the chain that starts at
offset 0 of a file are records:

1. inside a split the task follows successors and gives every candidate its
   exit, the first offset at or behind the split's end;
2. pointer jumping over these exits (doubling the step every round, so about
   log2(splits per file) rounds) marks where the chain of a file enters each
   split;
3. from that entry a walk over the split's candidates keeps the reachable
   ones; the rest is magic inside payloads and is dropped.

Offsets come from the pieces' lengths: sums per split, then a running sum over
the splits of each file. A payload that lies in one piece is digested where it
is read; one with magic inside is put together from its pieces by offset, also
across splits, and only such pieces are shuffled with their bytes.

Defined cases: null html is the empty payload; a null page_id is written with
an empty id, is never preferred as a response, and comes back null; rows that
repeat both id and payload are each a response; a null or odd url is percent-encoded; an empty table gives an
archive without records and an empty result; a file whose chain breaks (bad
length, cut-off record) raises ``ValueError`` instead of losing records; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.common import scratch_path, ship, staged, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: payloads from this size on are deduplicated
MIN_REVISIT_BYTES = 0
#: duplicated digests (about 60 bytes each) up to this count are broadcast
BROADCAST_DIGESTS = 200_000


def sha1_base32(hex_digest):
    """Bare upper-case base32 of a SHA-1 given in hex, as a column."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 2), 40, "0")
                      for i in range(4)])
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(*[F.substring(F.lit(letters), (F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10)
                                                   .cast("int") + 1), F.lit(1)) for i in range(32)])


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: response)."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"),
                     F.octet_length(html).cast("long").alias("payload_bytes"),
                     F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    keys = staged(p.select("page_id", "payload_bytes", "sha"), "warc-keys")
    twice = keys.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha") \
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").select(F.col("sha").alias("s"), "first_id")
    twice = staged(twice, "warc-twice")
    if twice.count() <= BROADCAST_DIGESTS:
        twice = F.broadcast(twice)
    p = p.join(twice, F.col("sha") == F.col("s"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return p.select("page_id", "url", "html", "payload_bytes",
                    sha1_base32(F.col("sha")).alias("payload_digest"), refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write one record per page below ``path``; returns ``path``."""
    r = with_roles(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                         F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.url_encode(F.coalesce("url", F.lit("")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            field("Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(F.lit("")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")))
    r.select(record.alias("value")).write.option("lineSep", END).text(path)
    return path


PIECE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("rel", T.LongType()),
    T.StructField("size", T.LongType()),           # bytes of the piece without the magic before it
    T.StructField("body", T.LongType()),           # bytes of its header, if it is a candidate
    T.StructField("span", T.LongType()),           # bytes from its magic to its successor
    T.StructField("record", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("refers", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("found", T.StringType())])       # digest of the payload, if it lies in this piece


def _parse(head: bytes):
    """The fields of a record header, or None if it is none."""
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    if not (size.isascii() and size.isdigit()) or b"warc-type" not in fields:
        return None
    return fields, int(size)


def _urn(value: str) -> str:
    return value.removeprefix("<urn:page:").removesuffix(">")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between two occurrences of the magic, in file order."""
    ship(spark)

    def scan(batches):
        import pyarrow as pa
        magic = len(MAGIC)
        last, seq, rel = None, 0, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
                key = (file.as_py(), block.as_py())
                if key != last:
                    last, seq, rel = key, 0, 0
                data = value.as_buffer().to_pybytes()
                row = [*key, seq, rel, len(data), None, None, None, None, None, None, None, None]
                head, blank, payload = data.partition(b"\r\n\r\n")
                parsed = _parse(head) if blank and not (seq == 0 and key[1] == 0) else None
                if parsed:
                    fields, size = parsed
                    body = len(head) + 4
                    span = magic + body + size + 4
                    kind = fields[b"warc-type"]
                    row[5:12] = [body, span, _urn(fields.get(b"warc-record-id", "")), kind,
                                 fields.get(b"warc-payload-digest", "").removeprefix("sha1:"),
                                 _urn(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None,
                                 int(fields.get(b"payload-length", size)) if kind == "revisit" else size]
                    if span == magic + len(data) and payload.endswith(b"\r\n\r\n"):
                        row[12] = base64.b32encode(hashlib.sha1(payload[:-4]).digest()).decode()
                rows.append(row)
                seq += 1
                rel += magic + len(data)
            cols = list(zip(*rows)) if rows else [[]] * len(PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64())
                 for c, f in zip(cols, PIECE)], PIECE.names)

    return _pieces(spark, path).mapInArrow(scan, PIECE)


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``at``, the offset of the magic before the piece (the piece that
    starts a file has none and lies at -len(magic)), and the end of its split."""
    magic = len(MAGIC)
    splits = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + magic).alias("bytes"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("bytes").over(order), F.lit(0)) - magic
    splits = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), base.alias("base"),
                           (base + F.col("bytes")).alias("stop"))
    return pieces.join(splits, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))) \
        .withColumn("at", F.col("base") + F.col("rel")).drop("f", "b", "base", "rel")


def _exits(pdf):
    """Within one split: where each candidate's chain leaves it."""
    pdf = pdf.sort_values("at", ascending=False)
    out, exit_of = [], {}
    for at, span, stop in zip(pdf["at"], pdf["span"], pdf["stop"]):
        if span == span:  # a candidate
            to = int(at + span)
            exit_of[at] = exit_of.get(to) if to < stop else to
        else:
            exit_of[at] = None
        out.append(exit_of[at])
    return pdf.assign(leaves=out)[["file", "block", "at", "leaves"]]


def _walk(pdf):
    """Within one split: the candidates on the chain from its entry."""
    pdf = pdf.sort_values("at")
    spans = dict(zip(pdf["at"], pdf["span"]))
    at, kept = int(pdf["entry"].iloc[0]), set()
    while at in spans and spans[at] == spans[at]:
        kept.add(at)
        at = int(at + spans[at])
    return pdf[pdf["at"].isin(kept)][["file", "at"]]


def chain(pieces: DataFrame) -> DataFrame:
    """(file, at) of the candidates reachable from the start of their file.

    ``pieces`` must be staged; the loop joins only one row per split and round.
    """
    small = pieces.select("file", "block", "at", "span", "stop")
    exits = staged(small.groupBy("file", "block").applyInPandas(
        lambda pdf: _exits(pdf), "file string, block long, at long, leaves long"), "warc-exits")
    # only chain entries matter: offset 0 and where other chains arrive
    targets = exits.select("file", F.col("leaves").alias("at")).distinct()
    step = staged(exits.join(targets, ["file", "at"], "left_semi")
                  .unionByName(exits.filter("at = 0")).distinct()
                  .select("file", "at", F.col("leaves").alias("to")), "warc-steps")
    reached = step.filter("at = 0").select("file", "at").distinct()
    # pointer jumping: after round k every step spans 2^k splits and the marked
    # entries are those within 2^k splits of the start
    while True:
        landed = reached.join(step, ["file", "at"]).filter("to IS NOT NULL") \
            .select("file", F.col("to").alias("at"))
        known = step.select("file", "at")
        grown = staged(reached.unionByName(landed.join(known, ["file", "at"], "left_semi")).distinct(),
                       "warc-reached")
        if grown.count() == reached.count():
            break
        reached = grown
        onward = step.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        step = staged(step.join(onward, ["file", "to"], "left")
                      .select("file", "at", F.col("further").alias("to")), "warc-steps")
    entries = reached.select(F.col("file").alias("f"), F.col("at").alias("entry"))
    homes = exits.join(entries, (F.col("file") == F.col("f")) & (F.col("at") == F.col("entry"))) \
        .select(F.col("file").alias("f"), F.col("block").alias("b"), "entry")
    return small.join(homes, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))) \
        .drop("f", "b").groupBy("file", "block").applyInPandas(lambda pdf: _walk(pdf), "file string, at long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    The digest of a response is computed from its payload, not taken from its header.
    """
    pieces = staged(with_offsets(candidates(spark, path)), "warc-pieces")
    kept = staged(chain(pieces), "warc-kept")
    records = pieces.join(kept, ["file", "at"])
    broken = pieces.groupBy("file").agg(F.max("stop").alias("end")) \
        .join(records.groupBy("file").agg(F.max(F.col("at") + F.col("span")).alias("reach")), "file", "left") \
        .filter("end > 0 AND (reach IS NULL OR reach <> end)")
    bad = broken.limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: the record chain breaks before the end of the file")
    whole = records.filter("kind <> 'response' OR found IS NOT NULL") \
        .withColumn("digest", F.when(F.col("kind") == "response", F.col("found")).otherwise(F.col("digest")))
    split = records.filter("kind = 'response' AND found IS NULL")
    out = [whole.select("record", "length", "digest", "kind", "refers")]
    if split.limit(1).count():
        out.append(_joined(spark, path, pieces, split))
    result = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return result.select(F.when(F.col("record") != "", F.col("record")).cast("long").alias("page_id"),
                         F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                         F.col("kind").alias("record_type"), F.col("refers").cast("long").alias("refers_to"))


def _joined(spark, path, pieces, split) -> DataFrame:
    """Responses whose payload holds the magic: joined from their pieces."""
    starts = split.select("file", "at", F.col("at").alias("start"), F.col("span").alias("long"),
                          "body", "record", "length", "kind", "refers")
    # each piece belongs to the last record start before it
    marked = pieces.select("file", "block", "seq", "at").join(
        starts.select("file", "at", "start", "long"), ["file", "at"], "left")
    back = Window.partitionBy("file").orderBy("at")
    marked = marked.withColumn("start", F.last("start", True).over(back)) \
        .withColumn("long", F.last("long", True).over(back)) \
        .filter("start IS NOT NULL AND at < start + long").select("file", "block", "seq", "at", "start")
    ship(spark)

    def number(batches):
        import pyarrow as pa
        last, seq = None, 0
        for batch in batches:
            seqs = []
            for file, block in zip(batch.column(0), batch.column(1)):
                key = (file.as_py(), block.as_py())
                seq = seq + 1 if key == last else 0
                last = key
                seqs.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64())],
                                             ["file", "block", "value", "seq"])

    texts = _pieces(spark, path).mapInArrow(number, "file string, block long, value string, seq long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))),
                                    lambda x: x["value"]), MAGIC)
    whole = texts.join(marked, ["file", "block", "seq"]).groupBy("file", "start").agg(text.alias("text"))
    payload = F.substring(F.encode("text", "UTF-8"), F.col("body").cast("int") + 1, F.col("length").cast("int"))
    return whole.join(starts.drop("at", "long"), ["file", "start"]) \
        .select("record", "length", sha1_base32(F.sha1(payload)).alias("digest"), "kind", "refers")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(spark, path)


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS sha
  FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(20), lambda i:
              lpad(bin(('0x' || substr(sha, (1 + 2 * i)::INT, 2))::INT), 8, '0')), '') AS bits
  FROM p),
e AS (
  SELECT *, array_to_string(list_transform(range(32), lambda j:
              substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     (1 + 16 * substr(bits, (5 * j + 1)::INT, 1)::INT + 8 * substr(bits, (5 * j + 2)::INT, 1)::INT
                        + 4 * substr(bits, (5 * j + 3)::INT, 1)::INT + 2 * substr(bits, (5 * j + 4)::INT, 1)::INT
                        + substr(bits, (5 * j + 5)::INT, 1)::INT)::INT, 1)), '') AS payload_digest
  FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS best FROM e)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM m
"""
