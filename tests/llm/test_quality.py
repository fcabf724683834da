"""Quality rules: each count and verdict; the whole query is held against SQL in test_llm_queries."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from markbook.llm import quality  # noqa: E402

COMMON = "the of and to in a is that for it was on with as be by at this from or".split()


def prose(seed, n, common=COMMON):
    rng = random.Random(seed)
    made = lambda: "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 9)))
    words = [rng.choice(common) if rng.random() < 0.45 else made() for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)]


ODD = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "x " * 40, "l1 a\nl1 a\n\n \n \nl1 a \nL1 a", "é日😀 # $%|<> &*", "a\x00b \x1c\x1d c\u0085d \u3000e",
    "r r r r r r", "p q r s t u p q r s t", " ".join(f"w{i % 7}" for i in range(200)), prose(1, 3000) + "\n" + prose(1, 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(100 + i, 30 + 7 * i), "en") for i in range(120)]
    rows += [(500 + i, prose(500 + i, 150, ["der", "die", "und", "ist", "ein", "nicht", "mit", "von", "zu", "auf"]), None) for i in range(40)]
    rows += [(700, prose(9, 200).upper().replace(" ", "!! "), "en"), (701, " | ".join(prose(8, 400, ["zqx"]).split()), "en"), (702, "no id", "xx")]
    rows += [(800 + i, "### $$$ %%% &&& " + prose(3, 200).replace(" ", "$$$ "), "en") for i in range(60)]  # a group of junk copies
    columns = "doc_id long, text string, lang string, kept string, ref string, n_words string, common int"
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], columns).cache()


def test_counts(docs):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert sorted(got) == sorted(texts)
    for doc, r in got.items():
        want = plain_counts(texts[doc]) if doc < 500 else None
        if want:
            assert [r[n] for n in quality.FAULTS] == want
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdicts(docs):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(got[100 + i].kept for i in range(120)) and all(got[500 + i].kept for i in range(40))
    assert not got[700].kept and not got[700].base_failed and not got[701].kept
    assert not any(got[800 + i].kept for i in range(60))
    assert got[9].class_distance is None and got[9].word_distance is None


def test_frequent_words_are_found_in_any_dealing(docs, monkeypatch):
    # a task that passes on after every few words finds the same common words
    want = quality.judged(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(quality, "HELD_WORDS", 50)
    assert quality.judged(docs.repartition(7)).orderBy("doc_id").collect() == want


def test_repeats_long(monkeypatch):
    words = [b"w%d" % (i * i % 1013) for i in range(200_000)]
    assert quality.repeated(words) == 200_000 and quality.repeated([b"%d" % i for i in range(200_000)]) == 0


def test_no_documents(spark, docs):
    assert quality.judged(docs.limit(0)).count() == 0
