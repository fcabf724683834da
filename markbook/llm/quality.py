"""Quality rules: counted faults, and how far a document's characters and words stray from its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import settled, text_of

#: a document fails with fewer words, or if more than this share of its words lies in repeated windows
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 0.2
#: a language has a reference of its own if it holds this share of the documents (so there are at most 1,000 references);
#: documents in other languages are held against a reference made of all documents
OWN_LANGUAGE = 1_000
#: common are words that make up 1 of so many words of the language, hence at most 400 words
COMMON = 400
#: words held by a task before it passes on those that make up 1 of 10 * COMMON of them
HELD_WORDS = 500_000
#: shares of character classes are counted in so many steps, of which a reference takes the median
STEPS = 1_000
#: a histogram of fewer characters or words is not judged
LEAST_CHARS, LEAST_JUDGED = 300, 50
#: greatest Jensen-Shannon distances from the language (0 to 1), those of an endless text. In a short one a single key or
#: address weighs more: its squared distance of classes may be greater by ODD_CHARS / characters. Its words stray by chance,
#: by a squared distance of about bins / (8 n ln 2), of which NOISE times is allowed
FAR_CLASSES, ODD_CHARS, FAR_WORDS, NOISE = 0.16, 25, 0.25, 1.2

CLASSES = ("lower", "upper", "digit", "space", "symbol", "other", "beyond_ascii")
SYMBOLS = b"#*$%&|<>"
FAULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _class(byte: int) -> int:
    """The class that a byte of UTF-8 adds a character to; bytes that continue one are class 7."""
    if byte >= 0x80:
        return 6 if byte >= 0xC0 else 7
    tests = (97 <= byte <= 122, 65 <= byte <= 90, 48 <= byte <= 57, byte == 32 or 9 <= byte <= 13, byte in SYMBOLS)
    return tests.index(True) if True in tests else 5


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)
#: for histograms, words are runs of ASCII letters and characters beyond ASCII, A-Z in lower case
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first find included; each word counts once.

    Windows are numbered by doubling: equal pairs of numbers get equal numbers, so no window is hashed or stored.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    name = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1]
        width += step
    starts = np.flatnonzero(np.bincount(name)[name] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measured(text: bytes) -> tuple[list[int], np.ndarray]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], characters by class)."""
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)[: len(CLASSES)]
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.split()] if b"\n" in text else []
    repeats = repeated(words)
    faults = [len(words), int(classes.sum() - classes[3]), int(classes[4]), len(lines) - len(set(lines)), repeats]
    return faults, classes


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few documents are Python objects at a time."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def frequent_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n, docs): a language's words that some task found frequent, and how often; word null: all its words.

    A task passes on each word that makes up 1 of 10 * COMMON of the words it holds. What it leaves out of any word is less than
    that share of its words, so a word with a share of 1 / COMMON of all is passed on for at least 9 of 10 of its finds.
    """
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        docs: Counter = Counter()
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                total = counts.total()
                found = [(lang, w, n, 0) for w, n in counts.items() if 10 * COMMON * n >= total]
                yield _batches([(lang, None, total, docs[lang]), *found], schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().translate(_LETTERS).split()
                held.setdefault(lang, Counter()).update(words)
                docs[lang] += 1
                size += len(words) + 1
                if size >= HELD_WORDS:
                    yield from passed()
                    held, docs, size = {}, Counter(), 0
        yield from passed()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, word binary, n long, docs long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def distance(seen: np.ndarray, expected: np.ndarray) -> float:
    """Jensen-Shannon distance, to base 2, between counts and the shares expected of the same bins (which add up to one)."""
    p, q = seen / seen.sum(), expected
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0.0)))


class References:
    """Per language, the shares of character classes and of common words, the last of them that of all other words."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, np.ndarray]) -> None:
        self.classes, self.words = classes, words

    def strays(self, ref: str, classes: list[int], letters: int, places: list[int], counts: list[int]) -> tuple[float | None, float | None, bool]:
        """(distance of classes, distance of words, whether either is too far); None where too short to be judged."""
        of_classes = of_words = None
        if sum(classes) >= LEAST_CHARS:
            of_classes = distance(np.array(classes, float), self.classes[ref])
        shares = self.words[ref]
        bins = int((shares[:-1] > 0).sum())
        if letters >= LEAST_JUDGED and bins:
            seen = np.zeros(len(shares))
            seen[places] = counts
            seen[:-1][shares[:-1] == 0] = 0
            seen[-1] = letters - seen.sum()
            of_words = distance(seen, shares)
        most = (FAR_WORDS**2 + NOISE * bins / (8 * max(letters, 1) * np.log(2))) ** 0.5
        odd = (FAR_CLASSES**2 + ODD_CHARS / max(sum(classes), 1)) ** 0.5
        return of_classes, of_words, (of_classes or 0) > odd or (of_words or 0) > most


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept.

    Base rules: fewer than LEAST_WORDS words, or more than MOST_REPEATED of the words in 5-word windows that the text repeats.
    Then two histograms of the document are compared with its language by Jensen-Shannon distance: characters by class (against the
    median shares over all documents of the language, which a large group of junk does not move) and common words, those with
    a share of 1 / COMMON of all words of the language (against these shares). Texts too short for a histogram are not judged by it, and
    short ones are allowed the distance that chance gives.

    Two passes read whole texts. The first finds words that may be common: every task passes on what is frequent in its part, so
    only few words are shuffled, and none with the full share can be missed. The second measures each document once, into a
    narrow table; exact counts, medians and verdicts come from that. References are bounded (OWN_LANGUAGE, COMMON) and go to every task.

    Null texts count as empty: no words, base_failed. A null language is the language ''. Languages with few documents share one
    reference. Rows that repeat an id are documents of their own. No documents give no rows. Distances are null where not
    judged. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), text_of(text).alias("text"))
    spark = docs.sparkSession
    seen = settled(frequent_words(rows), "quality-words")
    documents = seen.agg(F.sum("docs")).head()[0] or 0
    own = {r.lang for r in seen.where("word is null").where(F.col("docs") * OWN_LANGUAGE >= documents).collect()}
    ref = F.when(F.col("lang").isin(sorted(own)), F.concat(F.lit("="), "lang")).otherwise("*")
    sums = seen.withColumn("ref", ref).groupBy("ref", "word").agg(F.sum("n").alias("n"))
    total = sums.where("word is null").select("ref", F.col("n").alias("total"))
    maybe = sums.where("word is not null").join(total, "ref").where(F.col("n") * (10 * COMMON) >= F.col("total") * 9)
    places: dict[str, dict[bytes, int]] = {}
    for r in maybe.select("ref", "word").orderBy("ref", "word").collect():
        of_ref = places.setdefault(r.ref, {})
        of_ref[bytes(r.word)] = len(of_ref)
    found = settled(_measured(rows.withColumn("ref", ref), spark.sparkContext.broadcast(places)), "quality-measures")
    references = spark.sparkContext.broadcast(_references(found, {k: len(v) for k, v in places.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            far = [references.value.strays(**row) for row in batch.select(["ref", "classes", "letters", "places", "counts"]).to_pylist()]
            columns = {n: batch.column(n) for n in FAULTS}
            base = np.array(columns["n_words"]) < LEAST_WORDS
            base |= 100 * np.array(columns["n_repeat_words"]) > round(100 * MOST_REPEATED) * np.array(columns["n_words"])
            new = [base, *zip(*far, strict=True), [not b and not f[2] for b, f in zip(base, far, strict=True)]] if far else [[]] * 5
            arrays = [batch.column("doc_id"), *columns.values(), pa.array(new[0], pa.bool_())]
            arrays += [pa.array(new[1], pa.float64()), pa.array(new[2], pa.float64()), pa.array(new[4], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *FAULTS, "base_failed", "class_distance", "word_distance", "kept"])

    faults = ", ".join(f"{n} long" for n in FAULTS)
    return found.mapInArrow(run, f"doc_id long, {faults}, base_failed boolean, class_distance double, word_distance double, kept boolean")


def _measured(rows: DataFrame, known) -> DataFrame:
    """(doc_id, ref, faults, classes, letters, places, counts): one document each; of words in ``known[ref]`` their places and counts."""
    fields = [("doc_id", pa.int64()), ("ref", pa.string()), *[(n, pa.int64()) for n in FAULTS]]
    schema = pa.schema([*fields, ("classes", pa.list_(pa.int64())), ("letters", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("places", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            found = []
            for doc, ref, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                raw = text.as_py()
                faults, classes = measured(raw)
                places = known.value.get(ref, {})
                words = raw.translate(_LETTERS).split()
                counts = Counter(places[w] for w in words if w in places)
                found.append((doc, ref, *faults, classes.tolist(), len(words), list(counts), list(counts.values())))
            if found:
                yield _batches(found, schema)

    faults = ", ".join(f"{n} long" for n in FAULTS)
    return rows.select("doc_id", "ref", "text").mapInArrow(
        run, f"doc_id long, ref string, {faults}, classes array<long>, letters long, places array<long>, counts array<long>"
    )


def _references(found: DataFrame, sizes: dict[str, int]) -> References:
    """Medians and exact shares of each reference: at most OWN_LANGUAGE + 1 of them, with COMMON words each."""
    chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, c: a + c)
    steps = found.where(chars > 0).select("ref", F.posexplode(F.transform("classes", lambda c: F.floor(c * STEPS / chars))).alias("class", "step"))
    counted = steps.groupBy("ref", "class", "step").agg(F.count(F.lit(1)).alias("n"))
    classes: dict[str, np.ndarray] = {}
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in counted.collect():
        histogram.setdefault((r.ref, r["class"]), {})[r.step] = r.n
    for (ref, no), steps_of in histogram.items():
        order = sorted(steps_of)
        below = np.cumsum([steps_of[s] for s in order])
        classes.setdefault(ref, np.zeros(len(CLASSES)))[no] = order[int(np.searchsorted(2 * below, below[-1]))] + 0.5
    words = {ref: np.zeros(n) for ref, n in sizes.items()}
    every = found.select("ref", F.explode(F.arrays_zip("places", "counts")).alias("c"))
    for r in every.groupBy("ref", "c.places").agg(F.sum("c.counts").alias("n")).collect():
        words[r.ref][r.places] = r.n
    shares = {}
    for r in found.groupBy("ref").agg(F.sum("letters").alias("n")).collect():
        counts = words.get(r.ref, np.zeros(0))
        common = np.where(counts * COMMON >= r.n, counts, 0)
        shares[r.ref] = np.append(common, r.n - common.sum()) / max(r.n, 1)
    return References({k: v / v.sum() for k, v in classes.items()}, shares)


QUALITY_SQL = f"""
with d as (select row_number() over () as k, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t from documents),
l as (select lang, case when count(*) * {OWN_LANGUAGE} >= (select count(*) from d) then '=' || lang else '*' end as ref from d group by lang),
w as (select k, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
win as (select k, i, array_to_string(ws[i:i + 4], ' ') as g from w, unnest(generate_series(1, len(ws) - 4)) s(i)),
twice as (select k, i from win qualify count(*) over (partition by k, g) > 1),
rep as (select k, count(distinct i + j) as n from twice, unnest([0, 1, 2, 3, 4]) o(j) group by k),
dup as (
  select k, count(*) - count(distinct line) as n from d, unnest(string_split(t, chr(10))) x(line)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by k),
c as (
  select k, length(t) as chars, [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')),
    length(regexp_replace(t, '[^0-9]', '', 'g')), length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')),
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), 0, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))] as c from d),
cls as (select k, ref, chars, i as class, case when i = 6 then chars - list_sum(c) else c[i] end as n
  from c join d using (k) join l using (lang), unnest([1, 2, 3, 4, 5, 6, 7]) o(i)),
steps as (select ref, class, floor(n * {STEPS} / chars) as step, count(*) as m from cls where chars > 0 group by all),
cum as (select *, sum(m) over (partition by ref, class order by step) as below, sum(m) over (partition by ref, class) as total from steps),
med as (select ref, class, min(step) + 0.5 as mid from cum where 2 * below >= total group by all),
cref as (select ref, class, mid / sum(mid) over (partition by ref) as q from med),
cdist as (
  select k, sqrt(greatest(sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + q * log2(q / ((p + q) / 2))) / 2, 0)) as dist
  from (select k, n / chars as p, q from cls join cref using (ref, class) where chars >= {LEAST_CHARS}) group by k),
words as (select k, ref, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '(?:[a-z]|[^\\x00-\\x7F])+')) as word from d join l using (lang)),
tot as (select ref, count(*) as total from words group by ref),
com as (select ref, word, count(*) / any_value(total) as q from words join tot using (ref) group by ref, word
  having count(*) * {COMMON} >= any_value(total)),
bins as (select ref, count(*) as bins, greatest(1 - sum(q), 0) as rest from com group by ref),
lens as (select k, ref, count(*) as n from words group by k, ref),
hit as (select k, word, q, count(*) as n from words join com using (ref, word) group by k, word, q),
parts as (
  select k, sum(h.n / e.n * log2(h.n / e.n / ((h.n / e.n + q) / 2)) + q * log2(q / ((h.n / e.n + q) / 2))) as s, sum(h.n) as hits, sum(q) as qs
  from hit h join lens e using (k) group by k),
rest as (
  select k, n, bins, (n - coalesce(hits, 0)) / n as p, rest as q, coalesce(s, 0) + (1 - rest - coalesce(qs, 0)) as s
  from lens join bins using (ref) left join parts using (k) where n >= {LEAST_JUDGED}),
wdist as (
  select k, n, bins, sqrt(greatest((s + (case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end)
    + (case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2, 0)) as dist from rest),
f as (
  select d.k, doc_id, len(ws) as n_words, chars - c.c[4] as word_chars, c.c[5] as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, chars from d join w using (k) join c using (k) left join dup using (k) left join rep using (k))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {round(100 * MOST_REPEATED)} * n_words as base_failed,
  not base_failed and coalesce(cdist.dist, 0) <= sqrt({FAR_CLASSES**2} + {ODD_CHARS} / greatest(chars, 1))
    and coalesce(wdist.dist <= sqrt({FAR_WORDS**2} + {NOISE} * bins / (8 * n * ln(2))), true) as kept
from f left join cdist using (k) left join wdist using (k)"""
