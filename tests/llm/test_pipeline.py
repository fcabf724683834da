"""The pipeline stage by stage against plain Python, each on what the stage before kept."""

import collections
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from markbook.llm import mixing, simhash, toxicity  # noqa: E402
from markbook.llm.common import settled, table  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, small):
    """Name to (what went in, what came out), as tables."""
    docs, found = table(spark, small, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = settled(stage(spark, docs, small), name)
        found[name] = (docs, out)
        docs = out
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, (before, after) in steps.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_toxicity(spark, small, steps):
    before, after = steps["toxicity"]
    scores = toxicity.scored(before, table(spark, small, "labels"))
    assert ids(after) == ids(scores.where("predicted = 0"))


def test_exact(steps):
    before, after = steps["exact_dedup"]
    kept = {}
    for r in before.collect():
        kept[plain.lowered(r.text)] = max(r.doc_id, kept.get(plain.lowered(r.text), r.doc_id))
    assert ids(after) == sorted(kept.values())


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", plain.lowered(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near(texts):
    """Smallest id reachable by fingerprints within two bits or 0.8 of the shingles in common."""
    sets, prints = {i: shingles(t) for i, t in texts.items()}, {i: plain.fingerprint(t) for i, t in texts.items()}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return (prints[a] ^ prints[b]).bit_count() <= 2 or common >= 0.8 * (len(sets[a]) + len(sets[b]) - common)

    return plain.components(list(texts), linked)


def test_near(steps):
    before, after = steps["simhash_near_dedup"]
    root = near({r.doc_id: r.text for r in before.collect()})
    assert ids(after) == sorted(set(root.values()))


@pytest.mark.parametrize("tile, bucket", [(4096, 8192), (5, 3)])
def test_documents_alike(spark, tile, bucket):
    import random

    rng = random.Random(6)
    texts = {}
    for i in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 30, 120, 300]))]
        for j in range(rng.choice([1, 1, 3, 9])):
            copy = [w if rng.random() > 0.01 * j else "x" for w in words]
            texts[i * 10 + j] = " ".join(copy) if i else [None, "", " \n"][j % 3]
    rows = list(texts.items()) + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.alike_documents(df, tile, bucket).collect()}
    assert got.pop(None) is None and got == near(texts)


def test_mixing(steps):
    before, after = steps["mixing"]
    want = {r.doc_id: r.repeats for r in mixing.mixed(before).collect() if r.repeats}
    assert collections.Counter(ids(after)) == want


def test_mixing_of_large_products(steps):
    """Weights count against each other only. With these, weight times words passes 2^31, as 5 times 430 million words does."""
    before, _ = steps["mixing"]
    ids = lambda weights: sorted(r.doc_id for r in mixing.mixture(before, weights).select("doc_id").collect())
    assert ids([w << 27 for w in mixing.WEIGHTS]) == ids(mixing.WEIGHTS)


def test_packing(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = plain.token_pieces(rows, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    copies = collections.Counter(d for d, _ in rows)
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after.collect())
    assert got == {(d, no, *p): copies[d] for (d, no), p in want.items()}


def test_run(spark, small, steps):
    out = corpus_pipeline.queries()["pipeline"](spark, small)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, steps["packing"][1].select(key).collect()))


def test_alike_with_lines_repeated_unequally(spark):
    """Sets of shingles 0.95 alike, one line of them repeated 30 times in one text and once in the other."""
    import random

    rng = random.Random(8)
    texts = {}
    for i in range(0, 60, 2):
        body, line = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (200, 16))
        texts[i] = " ".join(body + line * 30)
        texts[i + 1] = " ".join([f"own{i}"] * 4 + body + line)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.alike_documents(df).collect()}
    assert got == {i: i - i % 2 for i in texts} == near(texts)


def test_bound_rules_out_no_alike_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (1, 5, 40, 400, 5000, 30_000):
        for _ in range(20):
            base = rng.integers(0, 2**32, size, dtype=np.uint32)
            own = rng.integers(0, 2**32, size, dtype=np.uint32)
            a, b = np.unique(base), np.unique(np.concatenate((base[size // 9 :], own[: size // 9])))
            assert simhash.alike(a, b) <= simhash._within(
                np.array([len(b)]), simhash._parity(b, 1024)[None], len(a), simhash._parity(a, 1024)
            )[0]


def test_stages_send_small_batches(spark, small):
    """Texts go to Python in batches of bounded bytes, however many rows Spark would put into one; a smaller setting stays."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["n", "rows"])

    docs = table(spark, small, "documents")
    texts = spark.range(4000, numPartitions=1).selectExpr("repeat('word ', 1000) AS text")
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(corpus_pipeline.BATCH_SETTING, "64m")
            stage(spark, docs, small)
            found = texts.mapInArrow(sizes, "n long, rows long").collect()
            assert max(r.n for r in found) < 1.5 * corpus_pipeline.BATCH_BYTES
            assert sum(r.rows for r in found) == 4000
        spark.conf.set(corpus_pipeline.BATCH_SETTING, "1k")
        corpus_pipeline.distinct(spark, docs, small)
        assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "1k"
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)


def test_worker_remembers_for_one_operator(monkeypatch):
    from markbook.llm.common import worker_memory

    monkeypatch.delitem(sys.modules, "markbook_worker_memory", raising=False)
    worker_memory("packing")["words"] = 1
    assert worker_memory("packing") == {"words": 1}
    assert worker_memory("toxicity") == {}
    assert worker_memory("packing") == {}
    monkeypatch.delitem(sys.modules, "markbook_worker_memory", raising=False)
