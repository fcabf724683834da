"""Alignment of two tokenizers on the same texts: groups of tokens that span the same bytes, and the pairs they link."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import joined_back, settled, text_of, worker_memory

BYTES_A, PIECES_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: an id pair is one number, id of A times this plus id of B
RADIX = 1 << 20
#: stretches of text whose ids a Python worker remembers, twice so many at most, and the longest of them in characters
REMEMBERED, LONGEST = 250_000, 48
#: numbers of linked pairs that a task holds before it passes on what it counted
HELD_PAIRS = 4_000_000
#: pairs that are sent to every task (24 bytes each), those with the highest counts; rarer ones are joined
SENT_PAIRS = 1 << 21
#: a group with more token pairs than this is counted by distinct ids
LISTED = 4_096


class Aligner:
    """Aligns texts by the two tokenizers.

    Neither tokenizer joins anything across a single space that stands between two characters that are no white space: A splits
    there before it merges, and B has no piece with a space mark after another character. So the tokens of a text are those of
    its stretches between such spaces, one after another, and the ids of a stretch seen before are remembered.
    """

    def __init__(self, path_a: str | None = None, path_b: str | None = None) -> None:
        import re

        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a or public_tokenizers.path(BYTES_A))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b or public_tokenizers.path(PIECES_B))
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.odd = re.compile(r" \s|[^\S ] |^\s|\s\Z").search  # else every space stands between two such characters
        self.fresh: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}
        # the byte spelling of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        spelled = {chr(c): b for b, c in [*zip(printable, printable, strict=True), *((b, 256 + i) for i, b in enumerate(others))]}
        words = self.a.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes_a[i] = word.encode() if word in special else bytes(spelled[c] for c in word)
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in pieces
        ]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        # each id as text: inside its side of a group, and as the last of it
        self.texts = [b"%d%s" % (i, end) for i in range(len(self.bytes_a)) for end in (b",", b"|")]
        self.texts += [b"%d%s" % (i, end) for i in range(len(self.bytes_b)) for end in (b",", b";")]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(ids of " " + text by A, of text by B, which sets the space itself, whether both give the bytes back)."""
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        raw = b" " + text.encode()
        same = b"".join([self.bytes_a[i] for i in ids_a]) == raw == b"".join([self.bytes_b[i] for i in ids_b])
        return np.array(ids_a, np.int32), np.array(ids_b, np.int32), same

    def learn(self, stretches: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """The ids of stretches that are not among the fresh ones: remembered, or of all others in one go."""
        found = {s: self.older[s] for s in stretches if s in self.older}
        new = [s for s in dict.fromkeys(stretches) if s not in found]
        plain = [s for s in new if not s[:1].isspace() and not s[-1:].isspace() and s]
        a, b, same = self.encoded(" ".join(plain)) if plain else (None, None, False)
        if same:
            ends = np.cumsum([len(s.encode()) + 1 for s in plain])
            to_a = (np.searchsorted(self.sizes_a[a].cumsum(), ends) + 1).tolist()
            to_b = (np.searchsorted(self.sizes_b[b].cumsum(), ends) + 1).tolist()
            raw_a, raw_b = a.tobytes(), b.tobytes()
            for s, i, k, j, m in zip(plain, [0, *to_a], to_a, [0, *to_b], to_b, strict=False):
                found[s] = raw_a[4 * i : 4 * k], raw_b[4 * j : 4 * m], True
        for s in new:
            if s not in found:
                a, b, same = self.encoded(s)
                found[s] = a.tobytes(), b.tobytes(), same
        if len(self.fresh) >= REMEMBERED:
            self.older, self.fresh = self.fresh, {}
        self.fresh.update((s, ids) for s, ids in found.items() if len(s) <= LONGEST)
        return found

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        stretches = self.cut(text) if self.odd(text) else text.split(" ")
        parts = [*map(self.fresh.get, stretches)]
        if None in parts:
            found = self.learn([s for s, p in zip(stretches, parts, strict=True) if p is None])
            parts = [p or found[s] for s, p in zip(stretches, parts, strict=True)]
        of_a, of_b, same = zip(*parts, strict=True)
        return np.frombuffer(b"".join(of_a), np.int32).astype(np.int64), np.frombuffer(b"".join(of_b), np.int32).astype(np.int64), all(same)

    def __call__(self, text: str) -> tuple[tuple[int, ...], str, np.ndarray, np.ndarray] | None:
        """((n_a, n_b, n_groups, n_links), digest of the groups, linked pairs, how often each); None: no tokens."""
        if not text:
            return None
        a, b, same = self.tokens(text)
        if not same:
            return None
        ends_a, ends_b = self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum()
        # a token is the last of a group where a token of the other side ends as well; both sides end with the text
        last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
        last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        links = in_a * in_b

        # every token of A with those of B in its group; very long groups by distinct ids
        many = np.where(links <= LISTED, in_b, 0)[group_a]
        first = (in_b.cumsum() - in_b)[group_a]
        place = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many) + np.repeat(first, many)
        pairs, times = np.unique(np.repeat(a, many) * RADIX + b[place], return_counts=True)
        long = [(pairs, times)]
        for g in np.flatnonzero(links > LISTED):
            (p, n), (q, m) = np.unique(a[group_a == g], return_counts=True), np.unique(b[group_b == g], return_counts=True)
            long.append(((p[:, None] * RADIX + q).ravel(), (n[:, None] * m).ravel()))
        if len(long) > 1:
            pairs, at = np.unique(np.concatenate([p for p, _ in long]), return_inverse=True)
            times = np.bincount(at, np.concatenate([t for _, t in long]), len(pairs)).astype(np.int64)

        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        written = np.concatenate((2 * a + last_a, 2 * (len(self.bytes_a) + b) + last_b))[order]
        groups = b"".join([self.texts[i] for i in written.tolist()])[:-1]
        return (len(a), len(b), len(in_a), int(links.sum())), hashlib.sha256(groups).hexdigest(), pairs, times


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """The aligner of this Python worker."""
    known, key = worker_memory("crosstok"), f"aligner {path_a} {path_b}"
    if key not in known:
        known[key] = Aligner(path_a, path_b)
    return known[key]


def aligned_texts(texts: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(key, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of (key, copies, text): one row each.

    pairs are the distinct linked id pairs of a text as little-endian 64-bit numbers in ascending order, times how many links each has.
    """
    names = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    types = [pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        rows, size = [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for key, copies, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = align(text.as_py())
                if found is None:
                    rows.append((key, copies, 0, 0, 0, 0, "", b"", b""))
                    continue
                counts, groups, pairs, times = found
                packed = pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()
                rows.append((key, copies, *counts, groups, *packed))
                size += len(packed[0]) + len(packed[1])
                if size > 8_000_000:
                    yield flushed()
                    rows, size = [], 0
        if rows:
            yield flushed()

    counts = "n_a long, n_b long, n_groups long, n_links long"
    return texts.select("key", "copies", "text").mapInArrow(
        run, f"key binary, copies long, {counts}, groups_sha256 string, pairs binary, times binary"
    )


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether that is the most that its A id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            pairs = np.concatenate([p for p, _ in held])
            copies = np.repeat([c for _, c in held], [len(p) for p, _ in held])
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
            sums = np.add.reduceat(copies[order], first) if len(first) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(sums.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for pairs, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((np.frombuffer(pairs, "<i8"), copies))
                size += len(pairs) // 8
                if size >= HELD_PAIRS:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    part = texts.select("pairs", "copies").mapInArrow(run, "pair long, n long")
    counts = settled(part.groupBy("pair").agg(F.sum("n").alias("n")), "crosstok-counts")
    most = counts.groupBy(F.shiftright("pair", 20).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 20)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


MEASURES = {"copies": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def _scored(texts: DataFrame, counts: DataFrame, sent: int) -> DataFrame:
    """``texts`` with n_best and count_sum instead of pairs: sums over links, from a table that may be larger than a task."""
    levels = counts.groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, room = 4097, sent
    for level in levels:
        room -= level["count"]
        if room < 0:
            break
        least = level["n"]
    table = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known = texts.sparkSession.sparkContext.broadcast([table.column(c).to_numpy()[order] for c in ("pair", "n", "best")])

    def met(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the sent table, whether there)"""
        sent_pairs = known.value[0]
        if not len(sent_pairs):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(sent_pairs, pairs), len(sent_pairs) - 1)
        return at, sent_pairs[at] == pairs

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            yield np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i4").astype(np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, total = [], []
            for pairs, times in unpacked(batch):
                at, there = met(pairs)
                best.append(int(times[there] @ known.value[2][at[there]]))
                total.append(int(times[there] @ known.value[1][at[there]]))
            arrays = [*[batch.column(c) for c in names], pa.array(best, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, (pairs, times) in zip(batch.column("key").to_pylist(), unpacked(batch), strict=True):
                rare = ~met(pairs)[1]
                if rare.any():
                    keys = pa.array([key] * int(rare.sum()), pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(pairs[rare]), pa.array(times[rare])], ["key", "pair", "times"])

    names = ["key", *MEASURES]
    schema = ", ".join(f"{n} {t}" for n, t in MEASURES.items())
    found = texts.mapInArrow(sums, f"key binary, {schema}, n_best long, count_sum long")
    if room >= 0:
        return found
    rare = texts.select("key", "pairs", "times").mapInArrow(others, "key binary, pair long, times long")
    rare = rare.join(counts.where(F.col("n") < least), "pair")
    rare = rare.select("key", *[F.lit(None).cast(t).alias(n) for n, t in MEASURES.items()], (F.col("best").cast("long") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    sums_of = [F.max(n).alias(n) for n in MEASURES] + [F.sum(n).alias(n) for n in ("n_best", "count_sum")]
    return found.unionByName(rare).groupBy("key").agg(*sums_of)


def alignments(
    docs: DataFrame, id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, sent: int = SENT_PAIRS
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text with a space before it is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Where tokens of both end, the
    bytes are cut into groups; all tokens of A and B in a group are linked. An id pair counts in how many documents it is linked;
    n_best are links whose count is the highest of their A id, count_sum is the sum of counts over links.

    Equal texts are one: texts are shuffled by the whole text and counted, before that within each task, so a text with a third
    of all rows is one row by then. Each distinct text is tokenized and aligned once, and its pairs count as often as it has
    copies. Texts meet the counts of their pairs in their own task, up to ``sent`` pairs; a larger table is joined for the
    rest, rows that only rare pairs have. Measures return to the documents by the digest of their text.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte (B reads U+2581 as a space), have no
    tokens: zeros and an empty digest. Whole texts are read, however long. Rows that repeat an id are documents of their own. No
    documents give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    keyed = settled(rows.select("doc_id", digest.alias("key")), "crosstok-keys")
    distinct = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(digest.alias("key"), "copies", "text")
    texts = settled(aligned_texts(distinct, path_a, path_b), "crosstok-texts")
    counts = settled(pair_counts(texts), "crosstok-pairs")
    found = settled(_scored(texts, counts, sent), "crosstok-measures")
    return joined_back(keyed, found, "key", "copies").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
