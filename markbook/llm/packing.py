"""Best-fit packing of tokenized documents into sequences of one length, by minimum bin slack."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markbook.llm.common import settled, text_of, worker_memory

CAPACITY = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
#: whether this machine writes numbers as the ids are wanted, 32 bits with the lowest byte first
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: words whose ids a Python worker remembers, twice so many at most: when they are full, those not met since the last time go
REMEMBERED = 150_000
#: pieces of one length are numbered in parts, at least so many, each of at most about so many pieces
SALTS, NUMBERED = 64, 1 << 18


# --- tokens --------------------------------------------------------------------------------------------------
class Fresh(dict):
    """Words met lately; another word is looked up by ``learn``."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        return self.learn(word)


class WordIds:
    """Ids of a stretch of text without white space, as little-endian 32-bit numbers.

    The vocabulary drops white space and never joins across it, so the ids of a text are those of its words in turn. Words
    of Latin-1 letters, and ASCII signs after them, go straight to the merges: nothing else in the tokenizer changes them
    but lower case and the spelling of bytes. Every other stretch goes through the whole tokenizer.
    """

    def __init__(self, path: str | None = None) -> None:
        import re

        import public_tokenizers
        from tokenizers import Tokenizer

        self.fresh, self.older = Fresh(self.learn), {}
        self.whole = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.merges = self.whole.model.tokenize
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
        # the byte spelling of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.spelled = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}

    def direct(self, letters: str) -> list[int]:
        if not letters.isascii():  # printable ASCII is spelled as itself
            letters = letters.encode().decode("latin-1").translate(self.spelled)
        return [t.id for t in self.merges(letters)]

    def encode(self, word: bytes) -> bytes:
        text = word.decode()
        found = None if len(text) > 64 or word.isalpha() else self.plain(text)
        if len(text) <= 64 and word.isalpha():
            ids = self.direct(text.lower())
        elif found and b"<|" not in word:
            ids = self.direct(found[1].lower()) + (self.direct(found[2]) if found[2] else [])
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def learn(self, word: bytes) -> bytes:
        ids = self.older.get(word) or self.encode(word)
        if len(word) <= 64:
            if len(self.fresh) >= REMEMBERED:
                self.older, self.fresh = self.fresh, Fresh(self.learn)
            self.fresh[word] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        # special tokens are matched before letters are lowered
        words = (text if b"<|" in text else text.lower()).split()
        known = self.fresh
        return b"".join([known[w] for w in words])


def word_ids(path: str | None) -> WordIds:
    """The memory of this Python worker: it outlives a task."""
    known, key = worker_memory("packing"), f"words {path}"
    if key not in known:
        known[key] = WordIds(path)
    return known[key]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): the tokens of each text and an end mark, cut where longer than ``capacity``.

    ids holds little-endian unsigned 32-bit numbers. A null or blank text is one piece, the end mark. Whole texts are read,
    however long; rows that repeat a doc_id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            rows, size = ([], [], [], [], []), 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = known.text(text.as_py()) + END.to_bytes(4, "little")
                for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, no, at // 4, len(part) // 4, part), strict=True):
                        column.append(value)
                    size += len(part)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, TYPES, strict=True)], names)
                    rows, size = ([], [], [], [], []), 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, TYPES, strict=True)], names)

    TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("t")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


# --- the plan ------------------------------------------------------------------------------------------------
def fullest(counts: np.ndarray, room: int, largest: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the greatest sum within ``room``: [(length, how many)].

    Subset sums as bits of one number: bit s is set if some items sum to s. Lengths are added from ``largest`` down, each as
    often as there are items; the search ends when the room can be filled. Walking back takes few items of each length.
    """
    reach, steps, within = 1, [], (1 << (room + 1)) - 1
    for length in range(min(room, largest), 0, -1):
        many = min(int(counts[length]), room // length)
        if not many:
            continue
        before = reach
        for _ in range(many):
            wider = (reach | reach << length) & within
            if wider == reach:
                break
            reach = wider
        if reach != before:
            steps.append((length, before))
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        many = 0
        while not before >> total & 1:
            total -= length
            many += 1
        if many:
            taken.append((length, many))
    return taken[::-1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, how many)])]: minimum bin slack over counts per length.

    A bin takes a largest item that is left, which must lie in some bin, and the fullest combination for its room. That bin
    is repeated as long as its items last, so one search serves many bins and their number follows the lengths, not the
    items.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, many in histogram.items():
        counts[length] = many
    found, largest = [], capacity
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return found
        counts[largest] -= 1
        rest = dict(fullest(counts, capacity - largest, largest))
        counts[largest] += 1
        rest[largest] = rest.get(largest, 0) + 1
        bins = min(int(counts[length]) // many for length, many in rest.items())
        for length, many in rest.items():
            counts[length] -= bins * many
        found.append((bins, sorted(rest.items(), reverse=True)))


class Places:
    """Where the r-th piece of a length goes: arrays of the plan's ranges, at most a few for each length and bin kind."""

    def __init__(self, table: np.ndarray) -> None:
        self.length, self.first, self.many, self.sequence, self.offset = table.T
        self.begin = np.searchsorted(self.length, np.arange(CAPACITY_LIMIT + 2))

    @staticmethod
    def ranges(planned: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for bins, items in planned:
            offset = 0
            for length, many in items:
                rows.append((length, used.get(length, 0), many, sequence, offset))
                used[length] = used.get(length, 0) + bins * many
                offset += length * many
            sequence += bins
        return np.array(sorted(rows), np.int64).reshape(-1, 5)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        for one in np.unique(length):
            lo, hi = self.begin[one], self.begin[one + 1]
            mine = length == one
            at[mine] = lo + np.searchsorted(self.first[lo:hi], rank[mine], "right") - 1
        within = rank - self.first[at]
        return self.sequence[at] + within // self.many[at], self.offset[at] + within % self.many[at] * length


CAPACITY_LIMIT = 1 << 17


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a settled table of pieces (doc_id, piece, start, length, ...); ids are not needed.

    Only counts per length, at most ``capacity`` rows, come to the driver; the plan made from them goes to the tasks and is
    bounded by the lengths as well. Pieces of one length are numbered in parts by hash of their document, as many as the number of
    pieces asks for, so a length with a third of all pieces is no hot group. Lengths are 1 to ``capacity``. An empty table gives no rows.
    """
    if capacity > CAPACITY_LIMIT:
        raise ValueError(f"sequences of at most {CAPACITY_LIMIT} tokens")
    salts = max(SALTS, cut.count() // NUMBERED)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = settled(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    ranges = cut.sparkSession.sparkContext.broadcast(Places.ranges(plan(histogram, capacity)))
    before = counts.select(
        F.col("length"),
        "_salt",
        (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start"))
    ranked = salted.withColumn("_in", inside).join(before, ["length", "_salt"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_in") - 1).alias("_rank"))
    at = ranked.columns.index("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(ranges.value)
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                names = [n for i, n in enumerate(batch.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def digested(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces with the digest of their ids instead of the ids, settled: each text is tokenized once."""
    cut = pieces(docs, path=path)
    return settled(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")


def sequences(docs: DataFrame, placed: DataFrame, path: str | None = None) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves, for writing to a training store."""
    parts = pieces(docs, path=path).select("doc_id", "piece", "ids")
    rows = parts.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    items = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    return rows.groupBy("sequence_id").agg(items.alias("_i")).select(
        "sequence_id",
        F.unhex(F.array_join("_i.ids", "")).alias("ids"),
        F.col("_i.doc_id").alias("doc_ids"),
        F.col("_i.offset").alias("offsets"),
    )
