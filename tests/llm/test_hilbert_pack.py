import itertools
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from trailmark.llm import hilbert_pack as hp
from trailmark.llm.wordbpe import vocabulary_path


def library(text):
    t = Tokenizer.from_file(vocabulary_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, want):
    """Every id in one piece, offsets gapless, full sequences or powers of two. want: ids by doc_id, one row each."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(want)
    for d, rows in docs.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == zlib.crc32(np.array(want[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_neighbours_on_the_curve_touch_and_every_cell_is_visited():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = hp.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: library(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(hp.op10_hilbert_pack(spark, sf).collect(), want)


def test_hard_rows(spark):
    rows = [(1, "a few words"), (2, None), (3, ""), (4, "long text " * 20_000), (5, "a few words"), (6, "with <|endoftext|> inside"), (None, "no id")] + [(100 + k, "the same text in many rows") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS key", "1 AS ids", "2 AS n")
    check(hp.digests(hp.pack(docs)).collect(), {d: library(t) for d, t in rows})
    assert hp.pack(docs.limit(0)).count() == 0
    twice = hp.pack(spark.createDataFrame([(7, "twice the row")] * 2, "doc_id long, text string")).collect()
    assert sum(r.length for r in twice) == 2 * len(library("twice the row"))


def test_like_documents_share_sequences(spark):
    rng = np.random.default_rng(2)
    vocab = [[f"{c}{k}" for k in range(300)] for c in ("alpha", "omega")]
    rows = [(k, " ".join(rng.choice(vocab[k % 2], 300))) for k in range(200)]
    by = defaultdict(set)
    for r in hp.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(x) == 1 for x in by.values()) >= 0.7 * len(by)


def test_cells_are_quantiles_of_all_documents(spark):
    n = 20_000
    table = spark.range(n).selectExpr("double(id) AS x0", "double(-id) AS x1", "double(id % 256) AS x2")
    got, at = hp.fit_cells(table), np.arange(1, 256) / 256
    assert got.shape == (3, 255)
    for row, values in zip(got, (np.arange(n), -np.arange(n), np.arange(n) % 256), strict=True):
        rank = [(np.mean(values < x), np.mean(values <= x)) for x in row]
        assert all(low - 2e-4 <= q <= high + 2e-4 for q, (low, high) in zip(at, rank, strict=True))
    assert not hp.fit_cells(table.limit(0)).any()
