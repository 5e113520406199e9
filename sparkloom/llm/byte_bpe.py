"""Byte-level BPE encoding and decoding.

Each match of the pattern is a word of bytes. Its merges are folded by rank: of all adjacent
pieces whose concatenation has a rank, those with the lowest are joined, the leftmost first,
until none is left. Decoding concatenates the pieces of the identifiers.

Spark's higher-order functions do this for a table of distinct words, with the ranks as an
array of maps that a scalar subquery gives (`encode_words`). A corpus has new words without end, so a table of all of them would
grow with it, and joining it back would shuffle a row for each word of the corpus. So `encode`
folds the words that are most frequent in a bounded draw of documents in that way, at most
FOLDED of them, and sends the table to the workers. There each document is split, and its words
are looked up; the words that the table lacks are folded on the spot, by the same rule. Results
do not depend on which words were folded where.

`encode_folded` folds and decodes all distinct words of up to LONG bytes by the higher-order functions. So that it
doesn't shuffle a row for each word of the corpus, documents are split in blocks: each is a sequence of numbers of the
block's distinct words, and only these are joined with the folded ones.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, partitions

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that a worker keeps at most beyond the table.
KEPT = 300_000
#: Words of the table at most, and documents that it is drawn from.
FOLDED, DRAWN = 20_000, 4_000
#: Longer words go by a heap instead of passes over all pairs.
LONG = 48
BUCKETS = 4096
#: A block ends with the document that brings it to so many characters or distinct words.
BLOCK_CHARS, BLOCK_WORDS = 16_000_000, 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word."""
    if word in ranks:
        return [word]
    pieces = [word[i : i + 1] for i in range(len(word))]
    if len(word) > LONG:
        return _fold_long(pieces, ranks)
    get, none = ranks.get, len(ranks) + 1
    costs = [get(a + b, none) for a, b in zip(pieces, pieces[1:], strict=False)]
    while costs and (least := min(costs)) < none:
        i = costs.index(least)
        pieces[i : i + 2] = [joined := pieces[i] + pieces[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = get(joined + pieces[i + 1], none)
        if i:
            costs[i - 1] = get(pieces[i - 1] + joined, none)
    return pieces


def _fold_long(pieces: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    n = len(pieces)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(pieces[i] + pieces[i + 1])) is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if not pieces[i] or j >= n or ranks.get(pieces[i] + pieces[j]) != rank:
            continue
        pieces[i], pieces[j] = pieces[i] + pieces[j], b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(pieces[i] + pieces[k])) is not None:
                heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get(pieces[h] + pieces[i])) is not None:
            heappush(heap, (r, h))
    return [p for p in pieces if p]


class Encoder(dict):
    """Word: its identifiers as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, table: dict[str, bytes]):
        super().__init__(table)
        self.table = table
        self.ranks = read_ranks(path)
        self.pieces = {r: p for p, r in self.ranks.items()}
        self.words = regex.compile(pattern)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT + len(self.table):
            self.clear()
            self.update(self.table)
        ranks = self.ranks
        self[word] = ids = b"".join([ranks[p].to_bytes(4, "little") for p in fold(word.encode("utf-8", "surrogatepass"), ranks)])
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The encoder of a worker's present query, by a name that the query gives it.
_CURRENT: dict[str, Encoder] = {}


def _encoder(name: str, path: str, pattern: str, table) -> Encoder:
    if name not in _CURRENT:
        _CURRENT.clear()
        rows = pa.ipc.open_stream(table.value).read_all()
        ids = rows.column("ids").to_pylist()
        _CURRENT[name] = Encoder(path, pattern, {w: np.array(i, "<u4").tobytes() for w, i in zip(rows.column("text").to_pylist(), ids, strict=True)})
    return _CURRENT[name]


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", most: int = FOLDED, drawn: int = DRAWN) -> DataFrame:
    """word (string) and its bytes: the most frequent words of a draw of documents by their texts' hash."""
    rows = max(1, docs.count())
    share = min(1.0, drawn / rows)
    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    # (?U): white space and letters by Unicode, as in the pattern's own library.
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))).alias("text"))
    top = words.where(F.octet_length("text").between(1, LONG)).groupBy("text").count().orderBy(F.desc("count"), "text").limit(most)
    return top.repartition("text").select("text", F.encode("text", "UTF-8").alias("word"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = True, digests: bool = True, table_words: int = FOLDED) -> DataFrame:
    """One row for each row of docs: id, n_tokens and, as asked for, ids (array of int), decoded
    (binary) or the SHA-256 of the identifiers as little-endian 32-bit integers and of the
    decoded bytes.

    A null text counts as empty and has no tokens. Special strings are ordinary text. Texts
    are never cut. path and pattern: by default those of the public package, at the same place on
    the driver and the workers. table_words: size of the table of frequent words at most; with 0
    there is none."""

    import public_tokenizers

    spark = docs.sparkSession
    place, split = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    if table_words:
        folded = encode_words(frequent_words(docs, split, text_col, table_words), place).select("text", "ids").toArrow()
    else:
        folded = pa.table({"text": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, folded.schema) as out:
        out.write_table(folded)
    table = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del folded, sink
    name = uuid.uuid4().hex

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name, place, split, table)
        for batch in batches:
            coded = [e.encode(t.as_py() or "") for t in batch.column(1)]
            cols = _columns(batch.column(0), coded, [e.decode(c) for c in coded], ids, digests)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(encoded, _schema(docs, id_col, ids, digests)).withColumnRenamed("id", id_col)


def _columns(names, coded: list[bytes], decoded: list[bytes], ids: bool, digests: bool) -> dict:
    cols = {"id": names, "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64())}
    if ids:
        cols["ids"] = pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32()))
        cols["decoded"] = pa.array(decoded, pa.binary())
    if digests:
        cols["ids_sha256"] = pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string())
        cols["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
    return cols


def _schema(docs: DataFrame, id_col: str, ids: bool, digests: bool) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    return f"id {kind}, n_tokens long" + ", ids array<int>, decoded binary" * ids + ", ids_sha256 string, decoded_sha256 string" * digests


def split_blocks(docs: DataFrame, id_col: str, text_col: str, pattern: str, block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document, with its block, id and sequence (the numbers of its words in the block, packed), and
    one for each distinct word of a block, with the block, the number and the word's bytes. Blocks are made of the rows
    that a task meets, so the table must be written before it is used twice."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall

        def rows(ids, seqs):
            n = len(seqs)
            cols = [pa.array([block] * n, pa.string()), ids, pa.array(seqs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "id", "seq", "k", "word"])

        def words(kind):
            listed = list(numbers)
            for at in range(0, len(listed), 20_000):
                some = [w.encode("utf-8", "surrogatepass") for w in listed[at : at + 20_000]]
                n = len(some)
                cols = [pa.array([block] * n, pa.string()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(range(at, at + n), pa.int32()), pa.array(some, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "id", "seq", "k", "word"])

        def begin():
            fresh = defaultdict()
            fresh.default_factory = fresh.__len__
            return uuid.uuid4().hex, fresh, 0

        block, numbers, chars = begin()
        kind = pa.null()
        for batch in batches:
            kind, start, seqs = batch.column(0).type, 0, []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                seqs.append(zlib.compress(np.fromiter(map(numbers.__getitem__, find(text)), "<u4").tobytes(), 1))
                chars += len(text)
                if chars >= block_chars or len(numbers) >= block_words:
                    yield rows(batch.column(0).slice(start, len(seqs)), seqs)
                    yield from words(kind)
                    block, numbers, chars = begin()
                    start, seqs = i + 1, []
            if seqs:
                yield rows(batch.column(0).slice(start, len(seqs)), seqs)
        yield from words(kind)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(split, f"block string, id {docs.schema[id_col].dataType.simpleString()}, seq binary, k int, word binary")


def encode_folded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = True, digests: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `encode`. Every distinct word of at most LONG bytes is folded and decoded once by `encode_words` and
    `decode_words`; longer ones, for which passes over all pairs take time by the square of their length or more, go by
    the heap in a worker. Workers split the documents and put the words' identifiers and bytes in line.

    Nulls, special strings, repeated rows and empty tables as in `encode`; other columns of docs don't matter. Two
    tables are written on the way: the documents as sequences with the words of their blocks, and the folded words."""

    import public_tokenizers

    spark = docs.sparkSession
    place, split = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    blocks = materialise(split_blocks(docs, id_col, text_col, split, block_chars), "bpe-blocks")
    words = blocks.where(F.col("word").isNotNull()).select("block", "k", "word")
    short = words.where(F.octet_length("word") <= LONG)
    # Written by itself, so that the fold is planned and run once.
    distinct = short.select("word").repartition(partitions(spark), "word").distinct()
    folded = materialise(decode_words(encode_words(distinct, place)).select("word", "ids", "decoded"), "bpe-words")

    def by_heap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = {}
        for batch in batches:
            ranks = ranks or read_ranks(place)
            pieces = [fold(w.as_py(), ranks) for w in batch.column(2)]
            coded = pa.array([[ranks[p] for p in ps] for ps in pieces], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), coded, pa.array([b"".join(ps) for ps in pieces], pa.binary())], names=["of", "k", "ids", "decoded"])

    found = short.join(folded, "word").select(F.col("block").alias("of"), "k", "ids", "decoded")
    found = found.unionByName(words.where(F.octet_length("word") > LONG).mapInArrow(by_heap, found.schema))

    def in_line(rows: pa.Table, known: pa.Table) -> pa.Table:
        coded, decoded = [b""] * known.num_rows, [b""] * known.num_rows
        for batch in known.to_batches():
            part, ends = batch.column("ids"), batch.column("ids").offsets.to_numpy() * 4
            values = np.asarray(part.values, "<u4").tobytes()
            for k, a, b, d in zip(batch.column("k").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), batch.column("decoded").to_pylist(), strict=True):
                coded[k], decoded[k] = values[a:b], d
        seqs = [np.frombuffer(zlib.decompress(s), "<u4").tolist() for s in rows.column("seq").to_pylist()]
        lines = [[b"".join(map(of.__getitem__, s)) for s in seqs] for of in (coded, decoded)]
        return pa.table(_columns(rows.column("id"), *lines, ids, digests))

    rows = blocks.where(F.col("seq").isNotNull()).select("block", "id", "seq")
    schema = _schema(docs, id_col, ids, digests)
    return rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(in_line, schema).withColumnRenamed("id", id_col)


def _rank_table(spark: SparkSession, path: str) -> DataFrame:
    """One row, which a worker makes. ranks: an array of maps from hexadecimal pieces to ranks, a map for
    each remainder of the piece's checksum, as a lookup in one map takes time in proportion to it."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps: list[list[tuple[str, int]]] = [[] for _ in range(BUCKETS)]
            for piece, rank in read_ranks(path).items():
                maps[zlib.crc32(piece) % BUCKETS].append((piece.hex().upper(), rank))
            kind = pa.list_(pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([maps] * batch.num_rows, kind)], names=["ranks"])

    return spark.range(0, 1, 1, 1).mapInArrow(table, "ranks array<map<string,int>>")


def encode_words(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """words (distinct, binary) with pieces (array of binary) and ids (array of int), by higher-order
    functions alone. The fold runs once for each byte but one and stops joining when no pair has a rank.
    A null word has null pieces, an empty one none.

    The ranks are a scalar subquery. As literals, they made a plan's text 2.1 MB long, which the driver renders for each
    event of a query. Spark refuses a subquery that is written within a higher-order function, but puts a column
    that is used once in its place, so no row carries the ranks."""
    rank_in = lambda table, piece: F.get(table, (F.crc32(piece) % BUCKETS).cast("int"))[F.hex(piece)]
    word = F.col(word_col)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    pairs = lambda table, acc: F.transform(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), lambda p, i: rank_in(table, F.concat(p, F.get(acc, i + 1))))
    join_at = lambda acc, at: F.concat(F.slice(acc, 1, at - 1), F.array(F.concat(F.get(acc, at - 1), F.get(acc, at))), F.slice(acc, at + 2, F.size(acc)))
    step = lambda table: lambda acc, _: let(pairs(table, acc), lambda r: F.when(F.array_min(r).isNull(), acc).otherwise(join_at(acc, F.array_position(r, F.array_min(r)).cast("int"))))
    n = F.octet_length(word)
    bytes_of = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))).otherwise(F.when(n == 0, F.array().cast("array<binary>")))
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    ids = lambda table, pieces: F.transform(pieces, lambda p: rank_in(table, p))
    coded = lambda table: let(F.aggregate(steps, bytes_of, step(table)), lambda pieces: F.struct(pieces.alias("pieces"), ids(table, pieces).alias("ids")))
    out = words.withColumn("__ranks", _rank_table(words.sparkSession, path).scalar()).withColumn("__coded", let(F.col("__ranks"), coded))
    return out.select(*words.columns, "__coded.pieces", "__coded.ids")


def decode_words(words: DataFrame, pieces_col: str = "pieces") -> DataFrame:
    """words with decoded: its binary pieces concatenated."""
    empty = F.lit(b"")
    return words.withColumn("decoded", F.aggregate(pieces_col, empty, lambda acc, p: F.concat(acc, p)))
