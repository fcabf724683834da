"""Repeated passages: removal of every byte covered by a string that also starts in an earlier document.

How a suffix array of the corpus is cut into pieces that tasks can hold:

* Every WINDOW-byte string contains, at the same place in each of its occurrences, the Q-gram with the smallest hash, and
  beyond it SIDE bytes on the left or more than SIDE on the right. The gram with these is its anchor: 33 or 34 bytes, which
  different texts share seldom, however many they are. Strings with different anchors are different, so each anchor has a
  suffix array of its own, and anchors found in one document only need none. Neighbouring windows with one anchor travel
  together, as a run.
* Within the runs that remain, windows are told apart by bucket-pointer refinement: suffixes start in the bucket of their
  first eight bytes; a bucket is split by sorting on the buckets at a later offset, and the buckets made so are used again
  at twice the depth. Buckets of one suffix are final and are not sorted again.

The text is copied once into the shared folder, in chunks. Tasks read chunks there, so texts are never shuffled; what is
shuffled are four bytes an anchor, and the text of runs whose anchor occurs in two documents. A document whose whole text
an earlier one has is settled by that (SHA-256): all of it goes, and the earlier one has its strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import filesystem, joined_back, settled, text_of, work_dir

WINDOW = 50
Q = 16
SPAN = WINDOW - Q + 1
SIDE = SPAN // 2
#: documents in a chunk
CHUNK_DOCS = 4096
#: an anchor in more documents than this is dealt out by window, not by anchor
HOT_DOCS = 10_000
#: bytes of text that are hashed at once, and bytes of runs that are refined at once: what a processor's cache holds
PIECE = 250_000
#: bytes of text for a bucket of anchors
BUCKET_BYTES = 8_000_000
#: places of a suffix that fit into a third of a 64-bit number
PLACE_BITS = 21
#: the rank of a null doc_id, before all others
NULL_RANK = -(1 << 63)


# --- anchors -------------------------------------------------------------------------------------------------
def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``data`` ends in at least eight spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def _hashed(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each place on."""
    eights = _eights(data)
    x = eights[:-8] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += eights[8:]
    for factor in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
    return x


def _joined(*hashes: np.ndarray) -> np.ndarray:
    x = hashes[0].copy()
    for other in hashes[1:]:
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x += other
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _runs_of_piece(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    begin = ends - size
    grams = _hashed(np.frombuffer(b"".join(texts) + bytes(WINDOW + 16), np.uint8))
    least, width = grams, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])[: ends[-1]]
    edges = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, begin[size > 0])
    doc = np.searchsorted(begin, edges, "right") - 1  # of places that are equal, an empty text's is not the last
    last = (begin + np.maximum(size - WINDOW + 1, 0))[doc]
    many = np.minimum(np.append(edges[1:], ends[-1]), last) - edges
    some = many > 0
    at, doc, many = edges[some], doc[some], many[some]
    parts = (many + SPAN - 1) // SPAN
    if parts.max(initial=1) > 1:  # one gram again and again
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, doc, many = np.repeat(at, parts) + SPAN * nth, np.repeat(doc, parts), np.minimum(np.repeat(many, parts) - SPAN * nth, SPAN)
    # the first place in a window whose gram is the least one, by half of its hash; after it the rest is a run, which is seldom
    halves = grams.astype(np.uint32)
    views, done = np.lib.stride_tricks.sliding_window_view(halves, SPAN), []
    while len(at):
        offset = (views[at] == least[at].astype(np.uint32)[:, None]).argmax(axis=1)
        taken = np.minimum(many, offset + 1)
        done.append((at, doc, taken, at + offset))
        rest = many > taken
        at, doc, many = (at + taken)[rest], doc[rest], (many - taken)[rest]
    if not done:
        return np.zeros(0, np.uint64), at, at, at
    at, doc, many, gram = (np.concatenate(x) for x in zip(*done, strict=True))
    if len(done) > 1:
        order = np.argsort(at)
        at, doc, many, gram = at[order], doc[order], many[order], gram[order]
    # windows that begin SIDE bytes before the gram or earlier, and the others
    left = np.clip(gram - at - SIDE + 1, 0, many)
    a, b = np.flatnonzero(left), np.flatnonzero(left < many)
    g, h = gram[a], gram[b]
    pieces = (left > 0).astype(np.int64) + (left < many)
    first = np.cumsum(pieces) - pieces
    key, start, windows = np.empty(pieces.sum(), np.uint64), np.repeat(at - begin[doc], pieces), np.repeat(many, pieces)
    key[first[a]], windows[first[a]] = _joined(grams[g], grams[g - 1], grams[g - SIDE]), left[a]
    b_at = first[b] + (left[b] > 0)
    key[b_at], windows[b_at] = _joined(grams[h] + np.uint64(1), grams[h + Q], grams[h + SIDE + 1]), (many - left)[b]
    start[b_at] += left[b]
    return key, np.repeat(doc, pieces), start, windows


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, start, windows) of all runs of neighbouring windows with one anchor, at most SPAN windows each."""
    none = np.zeros(0, np.int64)
    found, first, size = [(np.zeros(0, np.uint64), none, none, none)], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE or (size and i == len(texts) - 1):
            anchor, doc, start, many = _runs_of_piece(texts[first : i + 1])
            found.append((anchor, doc + first, start, many))
            first, size = i + 1, 0
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _content_key(content: bytes, buckets: int) -> int:
    """The key of a window that is dealt out by itself."""
    import xxhash

    mixed = xxhash.xxh64_intdigest(content)
    return mixed % buckets << 32 | mixed >> 32


def _keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an anchor and 32 more bits of it. Two anchors with one key cost some shuffled text, no wrong result."""
    return (anchor >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)


def _in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order and the places they had; of equal keys the first place comes first."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << np.uint64(bits) | np.arange(len(key)).astype(np.uint64))  # four times as fast as to sort places
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


# --- bucket-pointer refinement -------------------------------------------------------------------------------
def _split(order: np.ndarray, same: np.ndarray, base: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Give sorted suffixes the place where their bucket begins; return those that share one.

    same: whether a suffix has the key of the one before; base: the bucket they were in, as its first place.
    """
    index = np.arange(len(order))
    outer = np.ones(len(order), bool)
    outer[1:] = base[1:] != base[:-1]
    first = np.maximum.accumulate(np.where(~same, index, 0))
    rank[order] = base + first - np.maximum.accumulate(np.where(outer, index, 0))
    alone = ~same & ~np.append(same[1:], False)
    return order[~alone]


def refined(data: np.ndarray, windows: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each suffix of ``data`` that begins at one of ``windows`` a number, equal for equal first ``depth`` bytes.

    ``data`` ends in at least ``depth`` spare bytes; depth is 16 to 64. Where a place has PLACE_BITS at most, the buckets of a
    suffix and its place are one number, which is sorted without an index; those begin with five bytes, not eight.
    """
    eights = _eights(data)
    n = len(eights)
    rank = np.zeros(n + depth, np.int64)
    small = n < 1 << PLACE_BITS
    if small:
        known, low = 5, (1 << PLACE_BITS) - 1
        key = np.sort((eights & np.uint64((1 << 40) - 1)).astype(np.int64) << PLACE_BITS | np.arange(n))
        order = key & low
        key >>= PLACE_BITS
    else:
        known = 8
        order = np.argsort(eights)
        key = eights[order]
    same = np.append(False, key[1:] == key[:-1])
    shared = _split(order, same, np.zeros(n, np.int64), rank)
    while known < depth and len(shared):
        step = min(known, depth - known)
        if step < known or 2 * known >= depth:  # the last depth is asked for windows only
            wanted = np.zeros(n, bool)
            wanted[windows] = True
            shared = shared[wanted[shared]]
        if small:
            key = np.sort((rank[shared] << PLACE_BITS | rank[shared + step]) << PLACE_BITS | shared)
            order = key & low
            key >>= PLACE_BITS
        else:
            key = rank[shared] * (n + 1) + rank[shared + step]
            by = np.argsort(key)
            order, key = shared[by], key[by]
        base = rank[order]
        same = np.append(False, key[1:] == key[:-1]) if len(key) else np.zeros(0, bool)
        shared = _split(order, same, base, rank) if len(order) else order
        known += step
    return rank[windows]


def repeated(contents: list[bytes], earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the byte ranges, from its start, that windows cover which also occur in a run of an earlier document.

    In order of the runs. ``earliest`` is the smallest document of each run; runs are different from each other.
    """
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.cumsum(size) - size
    many = size - WINDOW + 1
    run = np.repeat(np.arange(len(contents)), many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    data = np.frombuffer(b"".join(contents) + bytes(WINDOW + 16), np.uint8)
    kind = refined(data, begin[run] + inside)
    lowest = np.full(len(data), np.iinfo(np.int64).max)
    np.minimum.at(lowest, kind, earliest[run])
    covered = lowest[kind] < earliest[run]
    edge = np.flatnonzero(covered & np.append(True, ~covered[:-1] | (inside[1:] == 0)))
    stop = np.flatnonzero(covered & np.append(~covered[1:] | (inside[1:] == 0), True))
    return run[edge], inside[edge], inside[stop] + WINDOW


def repeated_by_key(contents: list[bytes], keys: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``repeated`` finds; runs of different ``keys`` share no window, so whole keys are refined by PIECE bytes."""
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(np.fromiter((len(contents[i]) for i in order.tolist()), np.int64, len(order)))
    new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))  # where a key begins
    piece = (np.append(0, ends)[new] // PIECE)
    cut = new[np.append(True, piece[1:] != piece[:-1])]
    found = []
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        part = order[a:b]
        if len(part) > 1:  # the windows of one run have one document
            run, start, end = repeated([contents[i] for i in part.tolist()], earliest[part])
            found.append((part[run], start, end))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    run, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(run, kind="stable")
    return run[order], start[order], end[order]


# --- what tasks send -----------------------------------------------------------------------------------------
def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        found.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return found


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches by their first column, one group after the other."""
    now, rows = None, []
    for batch in batches:
        name = batch.schema.names[key]
        for row in batch.to_pylist():
            if rows and row[name] != now:
                yield now, rows
                rows = []
            now = row[name]
            rows.append(row)
    if rows:
        yield now, rows


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return _packed(row.astype(np.int32), start.astype(np.int64), end.astype(np.int64))


@dataclass(frozen=True)
class Corpus:
    """The chunks of a copied table: (chunk, path, copies: rows whose text an earlier document has), and how tasks read them."""

    manifest: DataFrame
    folder: str
    buckets: int
    #: tasks of each step: what they are sent is small next to what they read and do, so its size does not decide
    tasks: int


def _copies(rows: DataFrame) -> DataFrame:
    """(path, copies): the rows of a chunk, by their place, whose whole text a document with a smaller doc_id has."""
    rows = rows.where(F.col("size") >= WINDOW).select(
        "digest", F.coalesce("doc_id", F.lit(NULL_RANK)).alias("_rank"), "path", F.col("place").cast("int").alias("place")
    )
    firsts = settled(
        rows.groupBy("digest").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "substring-firsts"
    )
    return joined_back(rows, firsts, "digest", "_n").where("_rank > _first").groupBy("path").agg(F.collect_list("place").alias("copies"))


def copied(docs: DataFrame, chunk_docs: int = CHUNK_DOCS) -> Corpus:
    """Copy doc_id and text into chunks of the shared folder. Files Spark has committed are the chunks."""
    spark = docs.sparkSession
    folder = work_dir(spark, "substrings")
    text = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    rows = text.select("doc_id", "text", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", chunk_docs).parquet(folder)
    read = spark.read.schema(rows.schema).parquet(folder)
    narrow = read.select("doc_id", "size", "digest", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
    chunks = narrow.groupBy("path").agg(F.sum("size").alias("bytes")).withColumn("chunk", F.monotonically_increasing_id())
    manifest = settled(chunks.join(settled(_copies(narrow), "substring-copies"), "path", "left"), "substring-chunks")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = manifest.agg(F.sum("bytes")).head()[0] or 0
    return Corpus(manifest.select("chunk", "path", "copies"), folder, max(64, 2 * partitions, size // BUCKET_BYTES), partitions)


def _chunk_rows(folder: str, path: str, copies: list[int] | None = None, most: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of a chunk in its order, in parts of about ``most`` bytes. Texts of the rows ``copies`` are given as empty."""
    import pyarrow.parquet as pq

    store, _ = filesystem(folder)
    from urllib.parse import unquote

    left_out = set(copies or ())
    with store.open_input_file(filesystem(unquote(path))[1]) as file:
        ids, texts, size, place = [], [], 0, 0
        for batch in pq.ParquetFile(file).iter_batches(batch_size=256, columns=["doc_id", "text"]):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc)
                texts.append(b"" if place in left_out else text.as_py())
                place += 1
                size += len(texts[-1])
                if size >= most:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _shared_anchors(corpus: Corpus, hot_docs: int) -> DataFrame:
    """(chunk, bucket, flags): for each anchor key of a chunk, in order, whether other chunks have it and whether it is hot."""
    buckets, folder = corpus.buckets, corpus.folder

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, path, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, numbers, seen = [], [], 0
                for _, texts in _chunk_rows(folder, path, copies):
                    anchor, doc, _, _ = runs_of(texts)
                    keys.append(_keys(anchor, buckets))
                    numbers.append(doc + seen)
                    seen += len(texts)
                key, order = _in_order(np.concatenate(keys))
                if not len(key):  # no text of the chunk has a window
                    continue
                doc = np.concatenate(numbers)[order]
                first = np.append(True, key[1:] != key[:-1])
                at = np.flatnonzero(first)
                every, docs = key[at], np.add.reduceat(first | np.append(True, doc[1:] != doc[:-1]), at, dtype=np.int64)
                level = np.ceil(np.log2(docs)).astype(np.uint8)
                bucket = (every >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                stop = np.append(cut[1:], len(bucket))
                data = [_packed(every[a:b].astype(np.uint32), level[a:b]) for a, b in zip(cut, stop, strict=True)]
                yield _batch({
                    "bucket": (bucket[cut], pa.int64()), "chunk": ([chunk] * len(cut), pa.int64()), "data": (data, pa.binary()),
                })

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            parts = [_unpacked(r["data"], "u4", "u1") for r in rows]
            _, place, chunks = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
            docs = np.zeros(len(chunks), np.int64)
            np.add.at(docs, place, np.int64(1) << np.concatenate([p[1] for p in parts]).astype(np.int64))
            flags = (chunks[place] > 1).astype(np.uint8) | (docs[place] > hot_docs).astype(np.uint8) << 1
            cuts = np.cumsum([0] + [len(p[0]) for p in parts])
            data = [_packed(np.packbits(flags[a:b] & 1), np.packbits(flags[a:b] >> 1)) for a, b in zip(cuts, cuts[1:])]
            yield _batch({
                "chunk": ([r["chunk"] for r in rows], pa.int64()), "bucket": ([bucket] * len(rows), pa.int64()),
                "flags": (data, pa.binary()),
            })

    sent = corpus.manifest.repartition(corpus.tasks).mapInArrow(send, "bucket long, chunk long, data binary")
    return (
        sent.repartition(corpus.tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(compare, "chunk long, bucket long, flags binary")
    )


def _candidate_runs(corpus: Corpus, flags: DataFrame) -> DataFrame:
    """(bucket, chunk, data): runs whose anchor is in two documents, one per text and chunk; bucket < 0: settled ranges."""
    buckets, folder = corpus.buckets, corpus.folder

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _groups(batches):
            path, copies = next((r["path"], r["copies"]) for r in rows if r["path"] is not None)
            marks = {r["bucket"]: _unpacked(r["flags"], "u1", "u1") for r in rows if r["flags"] is not None}
            ids, texts, parts = [], [], []
            for part_ids, part_texts in _chunk_rows(folder, path, copies):
                anchor, doc, start, many = runs_of(part_texts)
                parts.append((anchor, doc + len(ids), start, many))
                ids += part_ids
                texts += part_texts
            anchor, doc, start, many = (np.concatenate([p[i] for p in parts]) for i in range(4))
            if not len(anchor):
                continue
            key = _keys(anchor, buckets)
            ordered, order = _in_order(key)
            at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            many_of = np.diff(np.append(at, len(ordered)))
            # runs come in order of their documents
            local = doc[order[at]] != doc[order[at + many_of - 1]]
            bucket = (ordered[at] >> np.uint64(32)).astype(np.int64)
            known, sizes = np.unique(bucket, return_counts=True)
            remote, hot = (
                np.concatenate([np.unpackbits(marks[b][i], count=n) for b, n in zip(known.tolist(), sizes.tolist(), strict=True)]).astype(bool)
                for i in (0, 1)
            )
            hot_run = np.zeros(len(key), bool)
            hot_run[order] = np.repeat(hot, many_of)
            chosen = np.sort(order[np.repeat(remote | local, many_of)])
            rank = np.array([NULL_RANK if i is None else i for i in ids], np.int64)
            chosen = chosen[np.argsort(rank[doc[chosen]], kind="stable")]
            by_window = hot_run[chosen]
            pieces = np.where(by_window, many[chosen], 1)  # a run, or each of its windows
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            by_window, chosen = np.repeat(by_window, pieces), np.repeat(chosen, pieces)
            row, begin = doc[chosen], start[chosen] + nth
            size = np.where(by_window, 1, many[chosen]) + WINDOW - 1
            contents = [texts[r][a:b] for r, a, b in zip(row.tolist(), begin.tolist(), (begin + size).tolist(), strict=True)]
            first = rank[row]
            seen: dict[bytes, int] = {}
            # an earlier document of this chunk may have all of a content
            later = np.fromiter(map(seen.setdefault, contents, first.tolist()), np.int64, len(contents)) < first
            sent_key = key[chosen]
            for i in np.flatnonzero(by_window & ~later).tolist():
                sent_key[i] = _content_key(contents[i], buckets)
            to = (sent_key >> np.uint64(32)).astype(np.int64)
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(to[mine], kind="stable")]
            cut = np.flatnonzero(np.append(True, np.diff(to[mine]) != 0)) if len(mine) else mine
            found = {"bucket": ([], pa.int64()), "chunk": ([], pa.int64()), "data": ([], pa.binary())}
            for at in np.split(mine, cut[1:]) if len(mine) else []:
                text = np.frombuffer(b"".join([contents[i] for i in at.tolist()]), np.uint8)
                data = _packed(row[at].astype(np.int32), first[at], begin[at], size[at].astype(np.int32), sent_key[at].astype(np.uint32), text)
                for column, value in zip(found.values(), (int(to[at[0]]), chunk, data), strict=True):
                    column[0].append(value)
            if later.any():
                done = _ranges(row[later], begin[later], (begin + size)[later])
                for column, value in zip(found.values(), (-1 - chunk, chunk, done), strict=True):
                    column[0].append(value)
            if found["bucket"][0]:
                yield _batch(found)

    empty = F.lit(None)
    rows = flags.select(
        "chunk", "bucket", "flags", empty.cast("string").alias("path"), empty.cast("array<int>").alias("copies")
    ).unionByName(
        corpus.manifest.select("chunk", empty.cast("bigint").alias("bucket"), empty.cast("binary").alias("flags"), "path", "copies")
    )
    return (
        rows.repartition(corpus.tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(send, "bucket long, chunk long, data binary")
    )


def _covered(runs: DataFrame, tasks: int) -> DataFrame:
    """(chunk, data): byte ranges to remove, by chunk."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            if bucket < 0:
                yield _batch({"chunk": ([r["chunk"] for r in rows], pa.int64()), "data": ([r["data"] for r in rows], pa.binary())})
                continue
            kind: dict[bytes, int] = {}
            cid, first, place, where, length, source, keys = [], [], [], [], [], [], []
            for r in rows:
                row, doc, start, size, key, data = _unpacked(r["data"], "i4", "i8", "i8", "i4", "u4", "u1")
                text, stops = data.tobytes(), np.cumsum(size).tolist()
                cid += [kind.setdefault(text[a:b], len(kind)) for a, b in zip([0, *stops], stops)]
                for column, value in zip((first, place, where, length, keys), (doc, row, start, size, key), strict=True):
                    column.append(value)
                source.append(np.full(len(row), r["chunk"]))
            cid, first, place, where, length, source, keys = np.array(cid), *map(np.concatenate, (first, place, where, length, source, keys))
            earliest = np.full(len(kind), np.iinfo(np.int64).max)
            np.minimum.at(earliest, cid, first)
            key_of = np.zeros(len(kind), np.uint32)
            key_of[cid] = keys
            later = first > earliest[cid]  # an equal run is in an earlier document
            run, a, b = repeated_by_key(list(kind), key_of, earliest)
            out = [(source[later], place[later], where[later], where[later] + length[later])]
            mine = np.flatnonzero(~later)
            many = np.bincount(run, minlength=len(kind))
            times = many[cid[mine]]
            i = np.repeat(mine, times)
            at = np.repeat((np.cumsum(many) - many)[cid[mine]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            out.append((source[i], place[i], where[i] + a[at], where[i] + b[at]))
            chunk, row, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(chunk, kind="stable")
            chunk, row, start, end = chunk[order], row[order], start[order], end[order]
            cut = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
            stop = np.append(cut[1:], len(chunk))
            if len(cut):
                data = [_ranges(row[a:b], start[a:b], end[a:b]) for a, b in zip(cut, stop, strict=True)]
                yield _batch({"chunk": (chunk[cut], pa.int64()), "data": (data, pa.binary())})

    return runs.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, "chunk long, data binary")


def _removed(corpus: Corpus, ranges: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document of the copy."""
    folder = corpus.folder
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            path, copies = next((r["path"], set(r["copies"] or ())) for r in rows if r["path"] is not None)
            parts = [_unpacked(r["data"], "i4", "i8", "i8") for r in rows if r["data"] is not None]
            row, start, end = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            at, number = 0, 0
            for ids, texts in _chunk_rows(folder, path):
                spans, kept = [], []
                for text in texts:
                    mine: list[list[int]] = [[0, len(text)]] if number in copies else []
                    while at < len(row) and row[at] == number:
                        if mine and start[at] <= mine[-1][1]:
                            mine[-1][1] = max(mine[-1][1], int(end[at]))
                        else:
                            mine.append([int(start[at]), int(end[at])])
                        at += 1
                    number += 1
                    edges = [0, *(e for m in mine for e in m), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in mine])
                yield _batch({
                    "doc_id": (ids, pa.int64()), "n_bytes": ([len(t) for t in texts], pa.int64()), "spans": (spans, span),
                    "kept": (kept, pa.binary()),
                })

    empty = F.lit(None)
    rows = ranges.select("chunk", "data", empty.cast("string").alias("path"), empty.cast("array<int>").alias("copies")).unionByName(
        corpus.manifest.select("chunk", empty.cast("binary").alias("data"), "path", "copies")
    )
    return (
        rows.repartition(corpus.tasks, "chunk").sortWithinPartitions("chunk")
        .mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    )


def without_repeats(docs: DataFrame, chunk_docs: int = CHUNK_DOCS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed byte ranges, maximal), kept (the remaining bytes).

    Removed is each byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id; strings are
    judged on the input, may overlap, and never cross documents. Equal runs are compared as bytes, windows by refinement; only
    whole documents count as copies by their SHA-256.

    Copies cost little: of equal runs a chunk sends one, that of its smallest document, and settles the others. An anchor in
    more than ``hot_docs`` documents is dealt out by window instead of by anchor, so a passage in a third of all documents
    spreads over the tasks; both ways find the same.

    Null texts count as empty; texts below WINDOW bytes stay as they are; long texts are read whole. Rows that repeat a doc_id
    are documents of equal rank, none earlier than the other; null ids come before all others. An empty table gives no rows.
    Other columns are not read.
    """
    corpus = copied(docs, chunk_docs)
    flags = settled(_shared_anchors(corpus, hot_docs), "substring-anchors")
    ranges = settled(_covered(_candidate_runs(corpus, flags), corpus.tasks), "substring-ranges")
    return _removed(corpus, ranges)


def digests(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
