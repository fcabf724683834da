"""Secrets: fixed patterns, and formats learned from the credentials they find, as probabilistic automata."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import settled, text_of

# fixed values: the base patterns; matches below the least lengths are dropped after matching
ASSIGN = re.compile(rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # the greedy runs of 24 or more are those of the pattern without a least length
KINDS = ("assign", "access", "hex", "learned")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: what a learned format may find: whole runs of these characters with letters and digits
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}+")
#: credentials per kind that a format is learned from, first by hash, and the longest of them
SAMPLE, LONGEST = 400, 96
ALPHA = 0.05
#: candidates need a likelihood as high as all but this share of the credentials of the format
MISSED = 0.02


# --- patterns ------------------------------------------------------------------------------------------------
def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: bytes) -> list[tuple[int, int]]:
    spans = (m.span() for m in CANDIDATE.finditer(text))
    return [(a, b) for a, b in spans if re.search(rb"[0-9]", text[a:b]) and re.search(rb"[A-Za-z]", text[a:b])]


def _value(kind: str, text: bytes) -> str:
    return (ASSIGN.match(text)[2] if kind == "assign" else text).decode()


def _letter(c: str) -> str:
    low, high = ("0", "0") if c.isdigit() else ("h", "l") if c.islower() else ("H", "U")
    return low if c.lower() <= "f" else high


LETTER = {ord(c): _letter(c) for c in string.digits + string.ascii_letters}


# --- automata ------------------------------------------------------------------------------------------------
def letters(value: str) -> str:
    """A value over a small alphabet: digits 0, a-f h, g-z l, A-F H, G-Z U; other characters stand for themselves."""
    return value.translate(LETTER)


#: how many characters a letter stands for
WIDTH = {"0": 10, "h": 6, "l": 20, "H": 6, "U": 20}
ALL = 67


class Automaton:
    """A probabilistic automaton by merging compatible states of the prefix tree of its words.

    ``passed[s]`` words went through state s, ``ended[s]`` ended there, ``moves[s]`` has per letter the next state and how
    often it was taken. States are taken breadth first; each is merged into the first kept state whose frequencies, and those
    of all that follows, agree by Hoeffding's bound, or kept.
    """

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.passed, self.ended, self.moves = [0], [0], [{}]
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        for word in words:
            state = 0
            self.passed[0] += 1
            for letter in word:
                if letter not in self.moves[state]:
                    self.moves[state][letter] = [len(self.passed), 0]
                    self.passed.append(0)
                    self.ended.append(0)
                    self.moves.append({})
                step = self.moves[state][letter]
                step[1] += 1
                state = step[0]
                self.passed[state] += 1
            self.ended[state] += 1
        self._merge()

    def _agree(self, f: int, n: int, g: int, m: int) -> bool:
        return not n or not m or abs(f / n - g / m) < self.alpha * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, kept: int, other: int) -> bool:
        stack, seen = [(kept, other)], set()
        while stack:
            a, b = stack.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if not self._agree(self.ended[a], self.passed[a], self.ended[b], self.passed[b]):
                return False
            for letter in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(letter), self.moves[b].get(letter)
                if not self._agree(x[1] if x else 0, self.passed[a], y[1] if y else 0, self.passed[b]):
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def _fold(self, kept: int, other: int) -> None:
        """Add the tree below ``other`` to ``kept``."""
        stack = [(kept, other)]
        while stack:
            a, b = stack.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for letter, (to, many) in self.moves[b].items():
                if letter in self.moves[a]:
                    self.moves[a][letter][1] += many
                    stack.append((self.moves[a][letter][0], to))
                else:
                    self.moves[a][letter] = [to, many]

    def _merge(self) -> None:
        kept = [0]
        while True:
            known = set(kept)
            open_ = [(s, x) for s in kept for x in sorted(self.moves[s]) if self.moves[s][x][0] not in known]
            if not open_:
                return
            source, letter = open_[0]
            state = self.moves[source][letter][0]
            for old in kept:
                if self._compatible(old, state):
                    self.moves[source][letter][0] = old
                    self._fold(old, state)
                    break
            else:
                kept.append(state)

    def score(self, value: str) -> float:
        """Log-likelihood a character, over that of characters drawn evenly. Steps never seen have a small probability."""
        word, state, total = letters(value), 0, 0.0
        for letter in word:
            passed, step = self.passed[state] if state is not None else 0, None
            if state is not None:
                step = self.moves[state].get(letter)
            share = (step[1] + 0.01) / (passed + 1) if step else 0.01 / (passed + 1)
            total += math.log(share / WIDTH.get(letter, 1) * ALL)
            state = step[0] if step else None
        if state is not None:
            total += math.log((self.ended[state] + 0.01) / (self.passed[state] + 1))
        else:
            total += math.log(0.01)
        return total / max(len(word), 1)


def learn(values: dict[str, list[str]]) -> list[tuple[Automaton, float]]:
    """An automaton and the least likelihood to accept, per kind with enough credentials.

    The bound comes from the second half of the credentials, scored by an automaton of the first half; the automaton kept is
    made of all.
    """
    found = []
    for kind in KINDS[:3]:
        words = sorted(set(values.get(kind, [])))
        if len(words) < 20:
            continue
        half = Automaton([letters(w) for w in words[::2]])
        scores = sorted(half.score(w) for w in words[1::2])
        # nothing is accepted that is no likelier than even characters
        bound = max(scores[int(MISSED * len(scores))], 0.1)
        found.append((Automaton([letters(w) for w in words]), bound))
    return found


# --- documents -----------------------------------------------------------------------------------------------
SPAN = "array<struct<kind: string, start: long, end: long, value: string>>"


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, other): spans in code points, with the value that may be a credential. One pass over whole texts."""

    def points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
        if not spans:
            return []
        if text.isascii():
            at = {p: p for _, a, b in spans for p in (a, b)}
        else:  # byte places to code points, one walk through the text
            at, before, count = {}, 0, 0
            for place in sorted({p for _, a, b in spans for p in (a, b)}):
                count += len(text[before:place].decode())
                at[place], before = count, place
        return [{"kind": k, "start": at[a], "end": at[b], "value": _value(k, text[a:b])} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            base, other = [], []
            for one in batch.column(1).cast(pa.binary()):
                text = one.as_py()
                spans = base_spans(text)
                base.append(points(text, spans))
                free = [s for s in candidates(text) if not any(a < s[1] and s[0] < b for _, a, b in spans)]
                other.append(points(text, [("learned", a, b) for a, b in free]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(other, kind)], ["doc_id", "base", "other"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("t")).mapInArrow(
        run, f"doc_id long, base {SPAN}, other {SPAN}"
    )


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end; code points, end exclusive; by start, then kind).

    Kinds assign, access and hex are the base patterns, leftmost and not overlapping within a kind. Their values are labelled
    credentials; from at most SAMPLE different values of a kind, first by hash, an automaton is learned, and every candidate
    of every document that no base span touches is scored by all automata. Those likely enough are spans of kind learned.

    Texts are scanned whole, once; what is kept of them is a settled table of spans. Null texts count as empty and have no
    spans; rows that repeat a doc_id stay rows; an empty table gives no rows. With fewer than 20 credentials of a kind there
    is no format of that kind.
    """
    found = settled(scanned(docs), "secrets-spans")
    values = found.select(F.explode("base").alias("s")).select("s.kind", "s.value").where(F.length("value") <= LONGEST).distinct()
    sample = {}
    for kind in KINDS[:3]:
        chosen = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        sample[kind] = [r["value"] for r in chosen.collect()]
    formats = learn(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for base, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                likely = [s for s in other if any(a.score(s["value"]) >= bound for a, bound in formats)]
                spans = sorted(base + likely, key=lambda s: (s["start"], KINDS.index(s["kind"])))
                rows.append([{k: s[k] for k in ("kind", "start", "end")} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""

    def text(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
