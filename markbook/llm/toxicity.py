"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import bits_table, buckets_for, drop_ids, maybe_in, settled, text_of, worker_memory

THRESHOLD = 0.3
#: words that are sent to every task, those with most contexts; a larger model is joined for the others
SENT_WORDS = 1 << 22
#: labels that are sent to every task (13 bytes each); more of them are joined, which shuffles the texts of labelled documents
SENT_LABELS = 1 << 23
#: tokens a task holds before it passes on which pairs of words it saw
HELD_TOKENS = 1 << 17
#: contexts taken from each count and given to the backoff distribution: that of these which fits the labels best
DISCOUNTS = (0.75, 2.0, 4.0)
#: expressions are runs of so many words; a document is as toxic as its most toxic expression
SPANS = (2, 4, 8, 16)
#: the classifier over the likelihoods is fitted on so many labelled documents at most, those first by hash
CALIBRATION_ROWS = 20_000
FEATURES = len(SPANS) + 4

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word: runs of letters, digits and bytes above ASCII, A-Z in lower case."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.translate(_SPLIT).split()
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def counted(labelled: DataFrame) -> DataFrame:
    """(word, seen, rest0, rest1, rest, all0, all1, all): different left-hand neighbours of each word, exactly.

    Rows (text, toxic, sampled). ``rest`` counts what rows outside the sample show, ``all`` what all rows show; with 0 and 1
    in the class, without in either. The table has a row per word hash of 64 bits, so it grows with the corpus.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("toxicity")  # what other operators left in this worker goes
        held, n = [], 0

        def seen() -> pa.RecordBatch:
            word, left, mark = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((mark, left, word))
            word, left, mark = word[order], left[order], mark[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (left[1:] != left[:-1]) | (mark[1:] != mark[:-1])
            found = [pa.array(word[new].view(np.int64)), pa.array(left[new].view(np.int64)), pa.array(mark[new])]
            return pa.RecordBatch.from_arrays(found, ["word", "left", "mark"])

        for batch in pick(batches) if pick else batches:
            columns = [batch.column(n) for n in ("text", "toxic", "sampled")]
            rows = zip(columns[0].cast(pa.binary()), columns[1].to_pylist(), columns[2].to_pylist(), strict=True)
            for text, toxic, sampled in rows:
                hashes = word_hashes(text.as_py())
                left = np.concatenate((np.zeros(min(1, len(hashes)), np.uint64), hashes[:-1]))
                held.append((hashes, left, np.full(len(hashes), 1 << toxic + 2 * sampled, np.int32)))
                n += len(hashes)
                if n >= HELD_TOKENS:
                    yield seen()
                    held, n = [], 0
        if n:
            yield seen()

    # labels that are sent are looked up in the same Python worker that counts: a second one per task would double the memory
    source, pick = getattr(labelled, "source_and_pick", None) or (labelled.select("text", "toxic", "sampled"), None)
    marks = source.mapInArrow(pairs, "word long, left long, mark int")
    once = marks.groupBy("word", "left").agg(F.bit_or("mark").alias("mark"))
    any_of = {"rest0": 1, "rest1": 2, "rest": 3, "all0": 5, "all1": 10, "all": 15}
    sums = [F.count_if(F.col("mark").bitwiseAND(F.lit(m)) != 0).alias(name) for name, m in any_of.items()]
    return once.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), *sums)


def rated(words: DataFrame) -> DataFrame:
    """(word, seen, r0, r1, r2, a0, a1, a2): per discount log P(word | toxic) - log P(word | ordinary), of rest and of all.

    A word's count in a class is the number of different contexts it follows there, as Kneser-Ney takes it, so that copies of
    one document count once. Each class gives ``discount`` of each count, and both the same share of their mass, to one backoff
    distribution made of the contexts of both classes: a word rare in both has the same probability in both.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for g in ("rest", "all") for c in (g, f"{g}0", f"{g}1")]
    sums += [F.count_if(F.col(g) > 0).alias(f"{g}_words") for g in ("rest", "all")]
    over = lambda c, d: F.greatest(F.col(c) - F.lit(d), F.lit(0.0))
    for g in ("rest", "all"):
        sums += [F.coalesce(F.sum(over(f"{g}{k}", d)), F.lit(0.0)).alias(f"{g}{k}_{i}") for k in (0, 1) for i, d in enumerate(DISCOUNTS)]
    total = words.agg(*sums).head()
    found = []
    for g in ("rest", "all"):
        shared = (F.col(g) + 0.5) / F.lit(float(total[g] + 0.5 * (total[f"{g}_words"] + 1)))
        for i, discount in enumerate(DISCOUNTS):
            kept = [total[f"{g}{k}_{i}"] / max(total[f"{g}{k}"], 1) for k in (0, 1)]
            backoff = min(1.0, max(1 - k for k in kept))
            p = [
                over(f"{g}{k}", discount) / max(total[f"{g}{k}"], 1) / max(kept[k], 1e-12) * (1 - backoff) + shared * backoff
                for k in (0, 1)
            ]
            found.append(F.log(p[1] / p[0]).cast("float").alias(f"{g[0]}{i}"))
    return words.select("word", "seen", *found)


def with_ratios(rows: DataFrame, model: DataFrame, names: list[str], finish: Callable, sent: int) -> DataFrame:
    """(doc_id, toxic, x): ``finish`` of the ratios of each row's words, an array of words by ``names``; 0 for unknown words.

    Rows (doc_id, toxic, text). The words with most contexts, about ``sent``, go to every task. Where the model has more, the
    other words meet their ratios in a join, which then has no word that many rows share. Labels that are sent are looked up
    in the Python worker that asks for the ratios, as in ``counted``.
    """
    levels = model.groupBy(F.least("seen", F.lit(1000)).alias("seen")).count().orderBy(F.desc("seen")).collect()
    least, room = 1001, sent
    for level in levels:
        room -= level["count"]
        if room < 0:
            break
        least = level["seen"]
    whole = room >= 0
    table = model.where(F.col("seen") >= (0 if whole else least)).select("word", *names).toArrow()
    words = table.column("word").to_numpy()
    order = np.argsort(words)
    ratios = np.column_stack([table.column(c).to_numpy()[order] for c in names])
    known = rows.sparkSession.sparkContext.broadcast((words[order], ratios))
    width = len(names)

    def look_up(hashes: np.ndarray, words: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros((len(hashes), width)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        there = words[at] == hashes
        return np.where(there[:, None], ratios[at], 0).astype(float), there

    def result(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "x"])

    source, pick = getattr(rows, "source_and_pick", None) or (rows.select("doc_id", "toxic", "text"), None)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("toxicity")
        for batch in pick(batches) if pick else batches:
            hashes = (word_hashes(t.as_py()).view(np.int64) for t in batch.column("text").cast(pa.binary()))
            yield result(batch, [finish(look_up(h, *known.value)[0]) for h in hashes])

    def unsent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = []
            for text in batch.column(1).cast(pa.binary()):
                hashes = np.unique(word_hashes(text.as_py()).view(np.int64))
                asked.append(hashes[~look_up(hashes, *known.value)[1]])
            row = np.repeat(batch.column(0).to_numpy(), [len(a) for a in asked])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate([*asked, np.zeros(0, np.int64)]))], ["row", "word"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, more in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
                hashes = word_hashes(text.as_py()).view(np.int64)
                values = look_up(hashes, *known.value)[0]
                if more:
                    own = sorted(tuple(m.values()) for m in more)
                    values += look_up(hashes, np.array([m[0] for m in own]), np.array([m[1:] for m in own]))[0]
                found.append(finish(values))
            yield result(batch, found)

    schema = "doc_id long, toxic int, x array<double>"
    if whole:
        return source.mapInArrow(direct, schema)
    numbered = settled(rows.select("doc_id", "toxic", "text").withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    others = model.where(F.col("seen") < least).select("word", *names)
    met = numbered.select("row", "text").mapInArrow(unsent, "row long, word long").join(others, "word")
    lists = met.groupBy("row").agg(F.collect_list(F.struct("word", *names)).alias("more"))
    return numbered.join(lists, "row", "left").select("doc_id", "toxic", "text", "more").mapInArrow(joined, schema)


def features(values: np.ndarray) -> np.ndarray:
    """From a text's ratios word by word: best expression of each span, best three, excess, mean, length."""
    found = np.zeros(FEATURES)
    if not len(values):
        return found
    sums = np.concatenate(([0.0], np.cumsum(values)))
    for i, span in enumerate(SPANS):
        width = min(span, len(values))
        found[i] = (sums[width:] - sums[:-width]).max() / span
    blocks = np.sort(np.add.reduceat(values, np.arange(0, len(values), 8)) / 8)[::-1]
    found[len(SPANS) :] = blocks[:3].sum() / 3, np.maximum(blocks - 0.25, 0).sum(), values.mean(), np.log(len(values))
    return found


class Classifier:
    """Logistic regression over the features of at most CALIBRATION_ROWS labelled documents, by Newton's method."""

    def __init__(self, rows: np.ndarray, toxic: np.ndarray) -> None:
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
        self.constant = share if len(set(toxic.tolist())) < 2 else None
        if self.constant is not None:
            return
        self.mean, self.scale = rows.mean(0), np.maximum(rows.std(0), 1e-9)
        x = np.column_stack((np.ones(len(rows)), (rows - self.mean) / self.scale))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            hessian = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 0.1 * np.eye(x.shape[1])
            self.weights += np.linalg.solve(hessian, x.T @ (toxic - p) - 0.1 * self.weights)

    def loss(self, rows: np.ndarray, toxic: np.ndarray) -> float:
        """Mean logarithmic loss, and the smaller the weights the better."""
        p = np.array([self(r) for r in rows]) if len(rows) else np.zeros(0)
        fit = -np.log(np.where(toxic == 1, p, 1 - p)).sum() + 0.05 * (self.weights[1:] ** 2).sum()
        return float(fit / max(len(rows), 1))

    def __call__(self, row: np.ndarray) -> float:
        if self.constant is not None:
            return float(self.constant)
        z = self.weights[0] + ((row - self.mean) / self.scale) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _remainder(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def _labelled(docs: DataFrame, chosen: DataFrame, sent: int) -> DataFrame:
    """(doc_id, text, toxic, sampled): the rows of ``docs`` that ``chosen`` (doc_id, toxic, sampled; settled, one row an id) has.

    Up to ``sent`` labels go to the tasks, so no text is shuffled. Of a larger table a bounded bit table goes there; texts that it
    does not know pass, the others are joined.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    count = chosen.count()
    if count > sent:
        buckets = buckets_for(count, 1 << 26)
        bits = settled(bits_table(chosen, "doc_id", buckets), "toxicity-bits")
        return maybe_in(rows, F.col("doc_id"), bits, buckets).where("_maybe").drop("_maybe").join(chosen, "doc_id")
    table = chosen.select("doc_id", "toxic", "sampled").toArrow().sort_by("doc_id")
    known = docs.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("doc_id", "toxic", "sampled")])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic, sampled = known.value
        for batch in batches:
            asked = batch.column(0).fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, asked), max(len(ids) - 1, 0))
            there = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (ids[at] == asked if len(ids) else False)
            arrays = [*batch.filter(pa.array(there)).columns, pa.array(toxic[at[there]]), pa.array(sampled[at[there]])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "toxic", "sampled"])

    found = rows.mapInArrow(pick, "doc_id long, text string, toxic int, sampled int")
    found.source_and_pick = (rows, pick)
    return found


def scored(
    docs: DataFrame, labels: DataFrame, sent: int = SENT_WORDS, calibration: int = CALIBRATION_ROWS, sent_labels: int = SENT_LABELS
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    labels: doc_id, toxic. Only labels of documents whose crc32(doc_id) leaves another remainder than 2 by 4 are used: the
    language models count all of these documents. The classifier over their likelihoods is fitted on a sample of remainder 3, at
    most ``calibration`` rows, with likelihoods of models that count all but the sample. Texts are all a score sees.

    Null texts count as empty; empty texts and texts without words have a score too. Of several labels of a document the
    largest counts; null labels and labels of no document are left out. If only one class is labelled, every score is its
    share. Rows that repeat a doc_id stay rows. Very long texts are scored whole. Other columns are not read.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = settled(usable.withColumn("_r", _remainder("doc_id")).where("_r <> 2"), "toxicity-labels")
    sample = usable.where("_r = 3").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration).select("doc_id", F.lit(1).alias("sampled"))
    sample = settled(sample, "toxicity-sample")
    chosen = usable.join(sample, "doc_id", "left").select("doc_id", "toxic", F.coalesce("sampled", F.lit(0)).alias("sampled"))
    chosen = settled(chosen, "toxicity-chosen")
    words = settled(counted(_labelled(docs, chosen, sent_labels)), "toxicity-words")
    model = settled(rated(words), "toxicity-model")
    trials = range(len(DISCOUNTS))

    def tried(values: np.ndarray) -> list[float]:
        return np.concatenate([features(values[:, i]) for i in trials]).tolist()

    asked = _labelled(docs, chosen.where("sampled = 1"), sent_labels)
    # at most ``calibration`` rows and their repeats: sorted here, since Spark would read all texts twice to sort them
    fitted = sorted(with_ratios(asked, model, [f"r{i}" for i in trials], tried, sent).collect(), key=lambda r: (r["doc_id"], r["x"]))
    rows = np.array([r["x"] for r in fitted]).reshape(-1, len(DISCOUNTS), FEATURES)
    toxic = np.array([r["toxic"] for r in fitted], float)
    classifiers = [Classifier(rows[:, i], toxic) for i in trials]
    best = min(trials, key=lambda i: classifiers[i].loss(rows[:, i], toxic))
    classifier = classifiers[best]
    texts = docs.select(F.col("doc_id").cast("bigint"), F.lit(None).cast("int").alias("toxic"), text_of().alias("text"))
    scores = with_ratios(texts, model, [f"a{best}"], lambda values: [classifier(features(values[:, 0]))], sent)
    return scores.select("doc_id", F.col("x")[0].alias("score")).select(
        "doc_id",
        F.coalesce(_remainder("doc_id") == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic; columns unchanged."""
    return drop_ids(docs, settled(scored(docs, labels).where("predicted = 1").select("doc_id"), "toxicity-dropped"))
