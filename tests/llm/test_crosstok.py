"""Alignment of two tokenizers against token by token comparison of whole texts."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402
from markbook.llm import crosstok  # noqa: E402

TEXTS = [
    None, "", " ", "  ", "x  y", " lead", "trail ", "a\u2581b", "<|endoftext|> <s> </s> <unk> <0x41>", "\n\n a \n b\tc\r\n", "日本語 テスト 😀😀 x",
    "a\u00a0 b \u3000c", "\x00 \x01", "\ufb01  é K", "don't can't  we'll 'tis", "a\u0085 b", "x\u2028 y z", "\u200b a b", "one word here",
    "a " * 5000, "ab" * 30000, "=-" * 900 + "xY" * 700 + " " * 50 + "z", "é" * 3000,
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in rows], "doc_id long, text string, key string, copies int, pairs string, n int")


def check(spark, rows, **options):
    got = Counter(tuple(r) for r in crosstok.alignments(frame(spark, rows), **options).collect())
    want = plain.alignments([t for _, t in rows])
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    letters = "abcxyzé日 <>|\n\t  \u3000"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    found = list(enumerate(TEXTS + made))
    return found + [(900 + i, "a copy of this text") for i in range(120)] + [(None, "no id"), (3, "repeated id"), (3, "repeated id")]


def test_odd_texts_and_copies(spark, rows):
    check(spark, rows)


def test_rare_pairs_are_joined(spark, rows):
    check(spark, rows, sent=100)


def test_tokens_of_stretches_are_those_of_the_text(monkeypatch):
    monkeypatch.setattr(crosstok, "REMEMBERED", 5)
    align = crosstok.Aligner()
    rng = random.Random(6)
    made = [" ".join(rng.choice(["alpha", "beta ", "γάμμα", "delta-x", "don't", "e\nf", " ", "12"]) for _ in range(60)) for _ in range(60)]
    for text in [*filter(None, TEXTS), *made]:
        a, b, _ = align.tokens(text)
        assert a.tolist() == align.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == align.b.encode(text)
        assert len(align.fresh) <= 5 + len(text)


def test_no_documents(spark):
    assert crosstok.alignments(frame(spark, [])).count() == 0
