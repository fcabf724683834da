"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import bits_table, buckets_for, drop_ids, maybe_in, settled, text_of
from markbook.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: a bucket of more fingerprints is cut finer; both tables are exact for RADIUS differing bits
BUCKET_ROWS = 8192
#: (parts, equal parts): RADIUS differing bits touch at most RADIUS parts, so the others are equal
COARSE, FINE = (4, 2), (8, 6)


# --- fingerprints --------------------------------------------------------------------------------------------
def shingle_hashes(text: bytes, width: int, step: int = 50_000) -> Iterator[np.ndarray]:
    """Hashes of all shingles of ``width`` words, repeats included, as rows of eight bytes; long texts in pieces."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only, splits at the ASCII white space only
    if not words:
        return
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), step):
        pairs = zip(starts[at : at + step].tolist(), ends[at : at + step].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(whole[a:b], SEED) for a, b in pairs]), np.uint8).reshape(-1, 8)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """64 bits, each set if over half of the hashes have it; 0 without hashes."""
    counts, many = np.zeros(64, np.int64), 0
    for part in hashes:
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        many += len(part)
    return int(np.packbits(counts * 2 > many).view(">u8")[0])


def fingerprint(text: bytes) -> int:
    return majority(shingle_hashes(text, SHINGLE))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("t")).mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison -----------------------------------------------------------------------------------
def linked_pairs(fps: np.ndarray, last: np.ndarray, radius: int = RADIUS, chunk: int = 16_384):
    """Yield (i, j) arrays, i < j, of rows within ``radius`` bits; row i is compared with rows up to ``last[i]``, excluded.

    Rows are stored as bit planes: word w of plane b has bit b of rows 64 w to 64 w + 63. A (row, word) pair adds plane after
    plane to carry-save counter words, 64 distances at once. Counters start so that they overflow at the first difference
    beyond the radius; lanes that overflow are marked, and pairs whose lanes are all marked are given up, every eight planes.
    """
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    packed = np.packbits(bits.reshape(words, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(packed).view("<u8")[:, :, 0]
    own = bits[:n].T.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)  # plane by row: all ones where the bit is set
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = radius.bit_length()
    offset = (1 << digits) - 1 - radius
    begin, end = np.arange(n) // 64, (last - 1) // 64 + 1
    rows = np.flatnonzero(last > np.arange(n) + 1)
    many = (end - begin)[rows]
    upto = np.cumsum(many)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
        part, count = rows[at:stop], many[at:stop]
        at = stop
        i = np.repeat(part, count)
        w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[i]
        # lanes before row i + 1 or from last[i] on are marked from the start
        low, high = np.clip(i + 1 - 64 * w, 0, 64), np.clip(last[i] - 64 * w, 0, 64)
        over = ~(_lanes(high) & ~_lanes(low))
        counters = [np.full(len(i), ones if offset >> k & 1 else np.uint64(0)) for k in range(digits)]
        for b in range(64):
            carry = planes[b, w] ^ own[b, i]
            for k in range(digits):
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
            over |= carry
            if b % 8 == 7:
                stay = over != ones
                if not stay.all():
                    i, w, over, counters = i[stay], w[stay], over[stay], [c[stay] for c in counters]
                if not len(i):
                    break
        if len(i):
            lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            yield i[k], w[k] * 64 + lane


def _lanes(count: np.ndarray) -> np.ndarray:
    """Words whose lowest ``count`` bits are set."""
    count = count.astype(np.uint64)
    full = count >= 64
    return np.where(full, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.where(full, np.uint64(0), count)) - np.uint64(1))


def smallest_linked(n: int, pairs) -> np.ndarray:
    """For each of ``n`` rows the smallest row reachable by the given pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (jumped := root[root]).tobytes() != root.tobytes():
                root = jumped
    return root


# --- candidates ----------------------------------------------------------------------------------------------
def _keys(scheme: tuple[int, int]):
    """Expression of one struct (no, key) per choice of equal parts: the fingerprint below the mask of these parts."""
    parts, equal = scheme
    width = 64 // parts
    masks = [
        sum(((1 << width) - 1) << (64 - width * (p + 1)) for p in chosen) for chosen in combinations(range(parts), equal)
    ]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.array(
        *[F.struct(F.lit(no).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for no, m in enumerate(signed)]
    )


def _compare(rows: DataFrame, scheme: tuple[int, int], most: int | None) -> DataFrame:
    """Per bucket of rows (fp, rep): (a, b, fp) with b null for rows of a bucket larger than ``most``, else edges a - b."""

    def flush(fps: list, reps: list, runs: list) -> pa.RecordBatch:
        fp, rep = np.concatenate(fps), np.concatenate(reps)
        length = np.concatenate(runs)
        last = np.repeat(np.cumsum(length), length)
        root = smallest_linked(len(fp), linked_pairs(fp, last))
        low = rep.copy()
        np.minimum.at(low, root, rep)
        to = low[root]
        link = to != rep
        return _batch(rep[link], to[link], fp[link].view(np.int64))

    def _batch(a, b, fp) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(fp)], ["a", "b", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide, key_before = [], False, None  # the bucket that may go on in the next batch
        fps, reps, runs, n = [], [], [], 0

        def close() -> None:
            nonlocal n
            if held and not wide and sum(map(len, (h[0] for h in held))) > 1:
                fps.extend(h[0] for h in held)
                reps.extend(h[1] for h in held)
                runs.append(np.array([sum(len(h[0]) for h in held)]))
                n += runs[-1][0]
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            no, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp, rep = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            cut = np.flatnonzero((no[1:] != no[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            if key_before != (no[0], key[0]):
                close()
                wide = False
            # the first run may continue, the last may go on; those between are whole
            for at in (0, *([len(starts) - 1] if len(starts) > 1 else [])):
                s, e = starts[at], ends[at]
                if at:
                    close()
                    wide = False
                    inner = np.arange(1, len(starts) - 1)
                    long = (ends - starts)[inner]
                    for k in inner[long > most] if most else ():
                        yield _batch(rep[starts[k] : ends[k]], pa.nulls(ends[k] - starts[k], pa.int64()), fp[starts[k] : ends[k]].view(np.int64))
                    good = inner[(long > 1) & (long <= most if most else True)]
                    if len(good):
                        take = np.zeros(len(fp) + 1, np.int64)
                        np.add.at(take, starts[good], 1)
                        np.add.at(take, ends[good], -1)
                        take = np.cumsum(take[:-1]) > 0
                        fps.append(fp[take])
                        reps.append(rep[take])
                        runs.append((ends - starts)[good])
                        n += int(runs[-1].sum())
                held.append((fp[s:e], rep[s:e]))
                if most and (wide or sum(len(h[0]) for h in held) > most):
                    wide = True
                    for f, r in held:
                        yield _batch(r, pa.nulls(len(r), pa.int64()), f.view(np.int64))
                    held.clear()
            key_before = (no[-1], key[-1])
            if n >= 20_000:
                yield flush(fps, reps, runs)
                fps, reps, runs, n = [], [], [], 0
        close()
        if n:
            yield flush(fps, reps, runs)

    keyed = rows.select("fp", "rep", F.explode(_keys(scheme)).alias("k")).select("k.no", "k.key", "fp", "rep")
    return keyed.repartition("no", "key").sortWithinPartitions("no", "key").mapInArrow(run, "a long, b long, fp long")


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest doc_id reachable, itself included.

    Equal fingerprints are one node, so copies cost an aggregate and no comparison. Two linked fingerprints agree in at least
    two of four 16-bit parts: six buckets each. Inside a bucket the comparison is bit-sliced, and what leaves it is one edge
    per fingerprint to the smallest document of its local component, never the pairs. A bucket of more than ``bucket_rows``
    different fingerprints is not compared: its fingerprints go by six of eight parts of 8 bits, whose buckets hold 65,536
    at most, by the same comparison. Both ways lose no link.

    Null and blank texts have fingerprint zero and link like others. Rows that repeat a doc_id stay rows. Null ids take part
    in no component but their own fingerprint's. Very long texts are hashed in pieces. An empty table gives no rows.
    """
    return _linked(settled(fingerprints(docs), "simhash-prints"), bucket_rows)


def _linked(prints: DataFrame, bucket_rows: int) -> DataFrame:
    reps = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    known = reps.where("rep is not null")
    coarse = settled(_compare(known, COARSE, bucket_rows), "simhash-coarse")
    wide = coarse.where("b is null").select("fp", F.col("a").alias("rep")).distinct()
    fine = settled(_compare(wide, FINE, None), "simhash-fine")
    edges = coarse.where("b is not null").select("a", "b").union(fine.select("a", "b"))
    found = settled(components(edges, "simhash-components"), "simhash-components")
    named = settled(
        reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
            "fp", F.coalesce("component", "rep").alias("component_id")
        ),
        "simhash-named",
    )
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


# --- documents alike -----------------------------------------------------------------------------------------
#: shingles of five words; texts are alike if so much of what either has is common to both
WORDS, ALIKE = 5, 0.8
#: smallest hashes of a text, one per function: two alike texts share none with probability (1 - ALIKE) ** MINIMA
MINIMA = 4
#: bits of the parity sketches that bound what two sets have in common: one goes with each row of a bucket, the wider one is
#: made where whole sets are at hand. The bound holds for all sets; a narrow sketch only leaves more sets to compare
BITS, WIDE = 1024, 4096
#: documents of a bucket that meet in one task; larger buckets are cut into tiles that meet pairwise
TILE = 4096


def _minima(hashes: np.ndarray) -> list[int]:
    found = []
    for k in range(1, MINIMA + 1):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        found.append(int((x ^ x >> np.uint64(32)).min()) if len(x) else 0)
    return found


def _shingle_set(text: bytes) -> np.ndarray:
    parts = [np.ascontiguousarray(p).view(">u8")[:, 0].astype(np.uint64) for p in shingle_hashes(text, WORDS)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The set as it is compared: the upper halves of the hashes."""
    return np.unique(hashes >> np.uint64(32)).astype(np.uint32)


def _parity(short: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits as words: for each remainder, whether an odd number of the set leaves it."""
    return np.packbits((np.bincount(short & np.uint32(width - 1), minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def _within(size: np.ndarray, bits: np.ndarray, own_size: int, own: np.ndarray) -> np.ndarray:
    """Which sets may have ALIKE in common with one; those left out certainly have not.

    A bit that differs stands for an element that only one of the sets has, and sets with ALIKE of their union in common
    have (1 - ALIKE) / (1 + ALIKE) of their summed sizes or fewer of these.
    """
    differing = np.bitwise_count(bits ^ own).sum(axis=1, dtype=np.int64)
    return differing <= (size + own_size) * (1 - ALIKE) / (1 + ALIKE) + 1e-6


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, many, bits, minima, same): the fingerprint; of the set of five-word shingles size, parities, smallest
    hashes and a digest. How often a shingle is repeated plays no part in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one in batch.column(1).cast(pa.binary()):
                text = one.as_py()
                every = _shingle_set(text)
                short = _short(every)
                minima = np.array(_minima(every), np.uint64).view(np.int64).tolist()
                same = xxhash.xxh3_128_digest(every.tobytes())
                rows.append((fingerprint(text), len(short), _parity(short, BITS).tobytes(), minima, same))
            fp, many, bits, minima, same = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(fp, np.uint64).view(np.int64)),
                    pa.array(many, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(minima, pa.list_(pa.int64())),
                    pa.array(same, pa.binary()),
                ],
                ["doc_id", "fp", "many", "bits", "minima", "same"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("t")).mapInArrow(
        run, "doc_id long, fp long, many long, bits binary, minima array<long>, same binary"
    )


def _tiles(nodes: DataFrame, tile: int) -> DataFrame:
    """(no, key, i, j, rep, many, bits): the rows of each bucket of two or more, dealt to tasks that each pair of rows meets in."""
    rows = nodes.select("rep", "many", "bits", F.posexplode("minima").alias("no", "key"))
    counts = settled(rows.groupBy("no", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "alike-buckets")
    many = F.ceil(F.col("_n") / tile).cast("int")
    own = F.pmod(F.xxhash64("rep"), many).cast("int")
    met = rows.join(counts, ["no", "key"]).withColumn("_t", own).withColumn("_o", F.explode(F.sequence(F.lit(0), many - 1)))
    return met.select("no", "key", F.least("_t", "_o").alias("i"), F.greatest("_t", "_o").alias("j"), "rep", "many", "bits")


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to each tile, a task's rows of it as one table of Arrow batches."""
    keys = ["no", "key", "i", "j"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([batch.column(k).to_numpy() for k in keys])
            cut = [0, *(np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1).tolist(), len(table)]
            for a, b in zip(cut, cut[1:]):
                if now is not None and now != tuple(table[a]):
                    yield from run(pa.Table.from_batches(held))
                    held = []
                now = tuple(table[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def _partners(tiles: DataFrame) -> DataFrame:
    """The rows of tiles that may be alike to another one there, by the bound of their sizes and parities."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        size = rows.column("many").to_numpy()
        order = np.argsort(size, kind="stable")
        size = size[order]
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(size), -1)[order]
        end = np.searchsorted(size, size / ALIKE + 1e-6, "right")
        found = np.zeros(len(size), bool)
        for i in range(len(size) - 1):
            near = np.arange(i + 1, end[i])
            near = near[~found[near]] if found[i] else near
            near = near[_within(size[near], bits[near], size[i], bits[i])]
            if len(near):
                found[i] = found[near] = True
        yield from rows.take(np.sort(order[found])).drop_columns(["many", "bits"]).combine_chunks().to_batches()

    return _by_tile(tiles, run, "no int, key long, i int, j int, rep long")


def _verified(tiles: DataFrame) -> DataFrame:
    """(a, b): per tile, edges that join the documents whose shingle sets are alike. Pairs already joined are not asked again."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("shingles")]
        size = np.array([len(x) for x in sets])
        order = np.argsort(size, kind="stable")
        sets, size, rep = [sets[k] for k in order], size[order], rows.column("rep").to_numpy()[order]
        wide = np.array([_parity(x, WIDE) for x in sets])
        bits = np.bitwise_xor.reduce(wide.reshape(len(sets), WIDE // BITS, -1), axis=1)
        end = np.searchsorted(size, size / ALIKE + 1e-6, "right")
        root, edges = np.arange(len(rep)), []
        for i in range(len(rep) - 1):
            near = np.arange(i + 1, end[i])
            near = near[root[near] != root[i]]  # pairs already joined need no look
            for every in (bits, wide):
                near = near[_within(size[near], every[near], size[i], every[i])]
            for j in near.tolist():
                if root[i] != root[j] and alike(sets[i], sets[j]):
                    root[root == root[j]] = root[i]
                    edges.append((rep[i], rep[j]))
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_tile(tiles, run, "a long, b long")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have ALIKE of their union in common; two empty ones have."""
    small, large = sorted((len(a), len(b)))
    if small < ALIKE * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= ALIKE * (small + large - common)


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents in ``wanted`` (rep); other texts are passed over in the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_short(_shingle_set(t.as_py())).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    buckets = buckets_for(wanted.count(), 1 << 26)
    bits = settled(bits_table(wanted, "rep", buckets), "alike-bits")
    rows = maybe_in(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("t")), F.col("doc_id"), bits, buckets)
    found = rows.where("_maybe").select("doc_id", "t").mapInArrow(run, "rep long, shingles binary")
    return found.groupBy("rep").agg(F.min("shingles").alias("shingles"))  # rows that repeat an id


def alike_documents(docs: DataFrame, tile: int = TILE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, component_id): documents linked by their fingerprints, or by ALIKE of their five-word shingles in common.

    The links of ``near_duplicates`` are all kept. Texts with a smaller likeness differ in more bits than any choice of equal
    parts allows, so their candidates are those that share one of MINIMA smallest hashes. Inside such a bucket the sizes and
    parities of the sets rule out pairs that cannot be alike, and no others; the rest is verified on whole shingle sets, which
    are only made for documents with such a pair. Buckets of more than ``tile`` documents are cut into tiles that meet pairwise, so no task holds
    more than two tiles and no pair is left out. Edges join what is alike; pairs already joined are not emitted.

    Documents with equal shingle sets are one node. Null and blank texts are alike. Documents without a doc_id link with
    nothing. An empty table gives no rows.
    """
    known = settled(signatures(docs), "alike-signatures")
    by_print = _linked(known.select("doc_id", "fp"), bucket_rows).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    reps = settled(known.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("many").alias("many"), F.min("bits").alias("bits"), F.min("minima").alias("minima")), "alike-nodes")
    equal = known.select("doc_id", "same").join(reps.select("same", "rep"), "same").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    partners = settled(_partners(_tiles(reps.where("rep is not null"), tile)), "alike-partners")
    sets = settled(_shingle_sets(docs, partners.select("rep").distinct()), "alike-sets")
    verified = settled(_verified(partners.join(sets, "rep")), "alike-edges")
    found = settled(components(by_print.union(equal).union(verified), "alike-components"), "alike-components")
    return known.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one, that of the smallest doc_id, of each component of ``alike_documents``; columns unchanged."""
    found = alike_documents(docs)
    return drop_ids(docs, settled(found.where("doc_id <> component_id").select("doc_id"), "simhash-dropped"))
