"""Registered queries on the smallest tables: against SQL where there is some, else against plain Python."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402
from markbook.llm import catalog  # noqa: E402
from markbook.llm.common import table  # noqa: E402
from tools import compare  # noqa: E402

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(spark, small, name, key):
    return {r[key]: r for r in QUERIES[name](spark, small).collect()}


@pytest.fixture(scope="module")
def documents(spark, small):
    return [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, small, name):
    assert compare.compare(spark, compare.connect(small), small, name, QUERIES[name], SQL[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_packing(spark, small, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = plain.token_pieces(documents, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    got = QUERIES["op2_packing"](spark, small).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    ordered = got.sort_values(["sequence_id", "offset"])
    sums = ordered.groupby("sequence_id").length
    assert (ordered.offset == sums.cumsum() - ordered.length).all() and sums.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_simhash(spark, small, documents):
    got = rows(spark, small, "op3_simhash", "doc_id")
    want = {d: plain.fingerprint(t) for d, t in documents}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in want.items()}
    root = plain.components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    assert {d: r.component_id for d, r in got.items()} == root


def test_secrets(spark, small, documents):
    import hashlib

    got = rows(spark, small, "op5_secrets", "doc_id")
    for doc, text in documents:
        spans = plain.base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert [got[doc].n_assign, got[doc].n_access, got[doc].n_hex] == counts


def test_repeats(spark, small, documents):
    got = rows(spark, small, "op8_substrings", "doc_id")
    want = plain.without_repeats(documents)
    assert [tuple(got[d])[1:] for d, _ in documents] == want


def test_vectors(spark, small):
    vectors = [(r.vec_id, r.embedding, r.label) for r in table(spark, small, "embeddings").collect()]
    got = rows(spark, small, "op10_vectors", "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == plain.links(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, folder).collect() if r.held_out}
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect() if r.doc_id in got}
    assert len(got) > 2000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    hits = [d for d, t in labels.items() if t == 1 and got[d].predicted == 1]
    toxic = sum(t == 1 for t in labels.values())
    wrong = sum(t == 0 and got[d].predicted == 1 for d, t in labels.items())
    assert len(hits) >= 0.8 * toxic and wrong <= 0.03 * (len(labels) - toxic)


def test_alignment(spark, small, documents):
    got = rows(spark, small, "op13_alignment", "doc_id")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(got[d][n] for n in names) for d, _ in documents] == plain.alignments([t for _, t in documents])
