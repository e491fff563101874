"""Token counts: flat token files without an index, scanned for end-of-document identifiers.

A token file is the tokens of its documents one after the other, each document closed by one end-of-document identifier,
as little-endian unsigned integers; nothing says where documents begin. `write_token_files` writes such files through
Spark's text sink, whose line separator is the identifier's bytes: one file a task, and beside it one of the documents'
ids in the same order. `scan_files` reads files of any size through Spark's text source, which cuts them at a single byte
(the identifier's highest that isn't 0) wherever splits fall; put together again, the pieces are the file's bytes. They are
searched block by block, by one vectorised comparison for each place where the first token of a block may begin, and a
prefix scan over what each block holds (bytes, identifiers, its first and last bytes) stitches the blocks of a file, so
that a document, or a token, may begin in one block and end in a later one. `scan` does the same for blocks that are rows.

Defined results: an empty text is a document of 0 tokens; a null text counts as empty; tokens after a shard's last
identifier are a last, unclosed document (closed = false), bytes beyond the last whole token are left out; blocks may have
any length, and null payloads count as empty; a shard without tokens gives no row. Repeated documents stay repeated; their
ids may be null.
"""

from __future__ import annotations

import base64
import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.taskcontext import TaskContext

from plumbline.llm._common import exists, folder, small_batches, written
from plumbline.llm._workers import tidied

TOKENIZERS = "/opt/tokenizers"
#: Bytes of a file that are searched at a time.
BLOCK_BYTES = 1 << 20
#: A text is tokenised in pieces of at most this many characters, cut where a space follows other text.
PIECE_CHARS = 1 << 16
EOD = 50256
#: The pre-tokenizer's pattern that belongs to the public byte-level vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def encoder(vocabulary: str):
    """Byte-level BPE from a file of base64 tokens and ranks; one copy a worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def encode_text(enc, text: str) -> list[int]:
    """enc's tokens of a whole text. Long texts go piece by piece, cut before a single space between two other characters, where the pattern always cuts."""
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                end = len(text)
            elif not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace():
                break
            else:
                end += 1
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def _width(eod: int) -> int:
    return 2 if eod < 1 << 16 else 4


@contextlib.contextmanager
def _concurrent_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Each task keeps n files open, so that rows needn't be sorted by file and stay in their order."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, eod: int = EOD, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Flat token files path/kind=tokens/shard=N/*, one a task, and path/kind=ids/shard=N/*: the ids of the documents in the file's order, as text, empty for null."""
    vocabulary = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    kind = f"<u{_width(eod)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for doc, text in zip(part.column(0).to_pylist(), (x.as_py() for x in part.column(1)), strict=True):
                    rows += [np.array(encode_text(enc, text or ""), kind).tobytes(), b"" if doc is None else str(doc).encode()]
                n = len(rows) // 2
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([shard] * 2 * n, pa.int32()), pa.array(["tokens", "ids"] * n)], names=["value", "shard", "kind"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInArrow(tidied(run), "value binary, shard int, kind string")
    with small_batches(docs.sparkSession), _concurrent_writers(docs.sparkSession, 2):
        out = rows.select(F.col("value").cast("string").alias("value"), "shard", "kind")
        separator = eod.to_bytes(_width(eod), "little").decode("latin-1")
        out.write.partitionBy("kind", "shard").option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def _pieces_of(spark: SparkSession, path: str, separator: bytes) -> DataFrame:
    """(file, start, size, value binary, piece) of the files under a path, cut at a byte sequence; start: of the split, size: of the file. Rows of a split come in order."""
    rows = spark.read.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    return rows.select(*meta, F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("piece"))


def _search(data: bytes, eod: int, width: int) -> list[np.ndarray]:
    """For each place below width where the first token may begin: where identifiers end."""
    out = []
    for first in range(width):
        tokens = np.frombuffer(data, f"<u{width}", max(0, (len(data) - first) // width), min(first, len(data)))
        out.append((np.flatnonzero(tokens == eod) + 1) * width + first)
    return out


_FOUND = "at long, part long, size long, n long, head binary, tail binary, ends array<array<long>>"


def _found(shard: object, shard_type: pa.DataType, at: int, part: int, size: int | None, data: bytes, eod: int, width: int) -> pa.RecordBatch:
    """What one block holds. size: bytes of its shard, None where the blocks tell them."""
    kinds = (shard_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())))
    row = (shard, at, part, size, len(data), data[: width - 1], data[max(0, len(data) - width + 1) :], _search(data, eod, width))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["shard", "at", "part", "size", "n", "head", "tail", "ends"])


def scan_files(spark: SparkSession, path: str, eod: int = EOD, width: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """scan() of the flat token files under a path; shard is the file's path. Splits of a file are read by different tasks."""
    width = width or _width(eod)
    cut = eod.to_bytes(width, "little").rstrip(b"\0")[-1:] or b"\0"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        held: list[bytes] = []
        size = part = 0

        def block() -> pa.RecordBatch:
            return _found(now[0], pa.string(), now[1], part, now[2], cut.join(held) + cut, eod, width)

        for batch in batches:
            for *split, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (tuple(split) != now or size >= block_bytes):
                    yield block()
                    part = part + 1 if tuple(split) == now else 0
                    held, size = [], 0
                now = tuple(split)
                held.append(value)
                size += len(value) + 1
        if held:
            yield block()

    pieces = _pieces_of(spark, path, cut).select("file", "start", "size", "value")
    return _stitched(pieces.mapInArrow(tidied(run), "shard string, " + _FOUND), eod, width)


def scan(blocks: DataFrame, eod: int = EOD, width: int | None = None) -> DataFrame:
    """(shard, ordinal long, token_start long, n_tokens long, closed boolean): the documents of each shard in order, from blocks (shard, block_no, payload)."""
    width = width or _width(eod)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _found(shard, batch.schema.field(0).type, number, 0, None, payload or b"", eod, width)

    shard_type = blocks.schema["shard"].dataType.simpleString()
    return _stitched(blocks.select("shard", "block_no", "payload").mapInArrow(tidied(run), f"shard {shard_type}, {_FOUND}"), eod, width)


def _stitched(found: DataFrame, eod: int, width: int) -> DataFrame:
    """What scan() returns, from what each block holds. The prefix scan sees a few numbers a block; identifiers come back by a join."""
    rows = written(found.filter("n > 0"), "blocks")
    w = Window.partitionBy("shard").orderBy("at", "part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tops = F.transform("ends", lambda e: F.slice(e, F.greatest(F.size(e) - 1, F.lit(1)), F.lit(2)))
    told = rows.select("shard", "at", "part", "n", "size", "head", "tail", F.transform("ends", F.size).alias("counts"), tops.alias("tops"))
    tails = [F.coalesce(F.lag("tail", k).over(w), F.lit(b"")) for k in range(width - 1, 0, -1)]
    based = told.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "gone": F.concat(*tails), "final": F.lead("at").over(w).isNull()})
    based = based.withColumn("need", F.pmod(-F.col("base"), F.lit(width)).cast("int"))  # bytes that complete a token begun before
    # a file's last piece may have no separator after it: ends beyond the file's size aren't there
    based = based.withColumn("limit", F.least("n", F.coalesce(F.col("size") - F.col("base"), F.col("n"))))
    seam = F.expr(f"need > 0 AND limit >= need AND concat(substring(gone, need - {width}), substring(head, 1, need)) = X'{eod.to_bytes(width, 'little').hex()}'")
    top = F.filter(F.get("tops", F.col("need")), lambda e: e <= F.col("limit"))
    lost = F.size(F.get("tops", F.col("need"))) - F.size(top)
    based = based.withColumn("seam", seam)
    based = based.withColumn("held", F.get("counts", F.col("need")) - lost + F.col("seam").cast("int"))
    last = F.coalesce(F.try_element_at(top, F.lit(-1)), F.when(F.col("seam"), F.col("need").cast("long")))
    based = based.withColumn("last", F.floor((F.col("base") + last) / width))
    based = based.withColumns({"first": F.coalesce(F.sum("held").over(before), F.lit(0)), "carried": F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(0)), "tokens": F.floor((F.col("base") + F.col("limit")) / width)})
    keys = ["shard", "at", "part"]
    joined = based.select(*keys, "base", "need", "limit", "seam", "last", "first", "carried", "tokens", "final").join(rows.select(*keys, "ends"), keys)
    own = F.filter(F.get("ends", F.col("need")), lambda e: e <= F.col("limit"))
    ends = F.when(F.col("seam"), F.concat(F.array(F.col("need").cast("long")), own)).otherwise(own)
    joined = joined.withColumn("stops", F.transform(ends, lambda e: F.floor((F.col("base") + e) / width)))
    docs = F.expr("transform(stops, (e, i) -> struct(first + i AS ordinal, if(i = 0, carried, stops[i - 1]) AS token_start, e - 1 AS stop, true AS closed))")
    rest_from = F.coalesce("last", "carried")
    rest = F.when(
        F.col("final") & (F.col("tokens") > rest_from),
        F.array(F.struct((F.col("first") + F.size("stops")).alias("ordinal"), rest_from.alias("token_start"), F.col("tokens").alias("stop"), F.lit(False).alias("closed"))),
    ).otherwise(F.expr("cast(array() AS array<struct<ordinal: bigint, token_start: bigint, stop: bigint, closed: boolean>>)"))
    out = joined.select("shard", F.explode(F.concat(docs, rest)).alias("d"))
    return out.select("shard", F.col("d.ordinal").alias("ordinal"), F.col("d.token_start").alias("token_start"), (F.col("d.stop") - F.col("d.token_start")).alias("n_tokens"), F.col("d.closed").alias("closed"))


def read_ids(spark: SparkSession, path: str, eod: int = EOD) -> DataFrame:
    """(shard int, ordinal long, doc_id) of the files of ids that write_token_files wrote: places in a split, and a prefix scan over the splits of a file."""
    pieces = _pieces_of(spark, path, eod.to_bytes(_width(eod), "little"))
    splits = pieces.groupBy("file", "start").agg(F.min("piece").alias("zero"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "zero", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(splits, ["file", "start"])
    shard = F.regexp_extract("file", r"shard=(\d+)", 1).cast("int")
    return placed.select(shard.alias("shard"), (F.col("base") + F.col("piece") - F.col("zero")).alias("ordinal"), F.col("value").cast("string").try_cast("long").alias("doc_id"))


def count_document_tokens(docs: DataFrame, vocabulary: str | None = None, eod: int = EOD) -> DataFrame:
    """(doc_id, shard, ordinal, token_start, n_tokens): documents written to flat token files, then counted by the scan."""
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    write_token_files(docs, path, vocabulary, eod)
    if not exists(spark, f"{path}/kind=tokens"):  # no documents, no files
        return spark.createDataFrame([], "doc_id long, shard int, ordinal long, token_start long, n_tokens long")
    counts = scan_files(spark, f"{path}/kind=tokens", eod).withColumn("shard", F.regexp_extract("shard", r"shard=(\d+)", 1).cast("int"))
    return counts.join(read_ids(spark, f"{path}/kind=ids", eod), ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "token_start", "n_tokens")
