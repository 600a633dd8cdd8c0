import hashlib
import random

import numpy as np
import pytest

from trailmark.llm import bytebpe

TEXTS = [
    None,
    "",
    " ",
    "we're here, it's 3.5   km\n\n\n away  ",
    "naïve café — 東京タワー 12345 \U0001f600\U0001f3fd",
    "x" * 500,
    "a b " * 300 + "\n" * 60 + "they've gone   " * 40,
    "  \t\t " * 200,
    "<|endoftext|> said the text, don't",
]


def brute(text):
    c = bytebpe.codec(bytebpe.vocabulary_path())
    return c.encoding.encode_ordinary(text or "")


@pytest.mark.parametrize("size,overlap", [(16, 12), (64, 32), (200, 40), (16_384, 1_024)])
def test_ids_equal_the_library_and_decode_to_the_text(spark, size, overlap):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, None, "again"), (3, TEXTS[3], "again"), (6, TEXTS[6], "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bytebpe.decode(bytebpe.encode(docs, chunk_chars=size, overlap_chars=overlap)).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if d is None else d, np.array(brute(t), "<u4").tobytes(), (t or "").encode()) for d, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), bytes(r.raw)) for r in got) == want


def test_random_texts_are_stitched_where_scans_agree():
    rng, c = random.Random(5), bytebpe.codec(bytebpe.vocabulary_path())
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "\n", "'", "'re", "!?", "é", "7", "   ", "\t"]) for _ in range(rng.randint(30, 200)))
        parts = bytebpe.chunks(text, 20, 16)
        zones = [bytebpe.zones(c, p, k, k == len(parts) - 1, 20, 16) for k, p in enumerate(parts)]
        cuts = bytebpe.stitch([z[1] for z in zones], [z[0] for z in zones])
        if cuts is not None:
            assert set(cuts) <= set(c.boundaries(text).tolist())


def test_empty_table(spark):
    assert bytebpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_small_table(spark):
    rows = bytebpe.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = brute(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
