import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trailmark.llm import repair_ids as rp
from trailmark.llm.wordbpe import WordEncoder, vocabulary_path

TEXTS = [None, "", " \n ", "The patient's HEAD, the thigh. don't we've 42!! ...", "ÉTÉ Ä̈ naïve café  x\x1cy İstanbul ΣΑΣ. ΟΔΟΣ,", "a" * 5000, "東京 tower\u0085next ## % a.b,c. x., .,", "<|endoftext|> text", "hello <|endoftext|> world <|startoftext|>", "<|ENDOFTEXT|> a<|endoftext|>b", "3rd 2nd. a1b2 it.'s 'tis (x)y <\u0338 =\u0338 e\u0301. 1,000.50", "word " * 3000, "ª. º, ſ. K, ß."]


def library(texts):
    t = Tokenizer.from_file(vocabulary_path())
    return [np.append(np.array(x.ids, np.uint32), np.uint32(2)) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_by_word_ids_are_the_library_s():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "B", "é", "́", " ", "\n", ".", ",", "'s", "'", "7", "(", "\u0338", "=", "<|endoftext|>", "!", " ", "ͅ", "ﬁ", "Σ"]) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    e = WordEncoder(vocabulary_path())
    ids, bounds = e.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 2)
    for k, want in enumerate(library(texts)):
        assert np.array_equal(ids[bounds[k] : bounds[k + 1]], want), texts[k]


@pytest.mark.parametrize("terminals", [50, rp.TERMINALS, 200_000])
def test_grammars_give_back_ids_and_stretches(terminals):
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(3, 12, rng.integers(0, 400)), 2).astype(np.uint32) for _ in range(60)] + [np.full(5000, 7, np.uint32), np.array([2], np.uint32)]
    ids, bounds = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, marks, g = rp.compress(ids, bounds, terminals=terminals, least=4)
    assert len(symbols) < len(ids) and len(g.left)
    for k, d in enumerate(docs):
        part = symbols[marks[k] : marks[k + 1]]
        assert np.array_equal(g.expand(part), d)
        a, b = sorted(rng.integers(0, len(d) + 1, 2).tolist())
        assert np.array_equal(g.part(part, a, b), d[a:b])


def plain_re_pair(docs, least, terminals):
    """Pairs of ids that occur least times or more in what is left, without overlap."""
    count = {}
    for d in docs:
        k = 0
        last = None
        for pair in zip(d, d[1:]):
            if pair == last and pair[0] == pair[1]:
                last = None
                continue
            last = pair
            count[pair] = count.get(pair, 0) + 1
    return {p for p, n in count.items() if n >= least}


@pytest.mark.parametrize("seed", range(6))
def test_rounds_go_on_until_no_pair_is_frequent(seed):
    rng = np.random.default_rng(seed)
    phrase = rng.integers(3, 40, 64)
    docs = [np.append(np.tile(phrase, 64), 2), np.full(4096, 7), np.append(rng.integers(3, 6, 3000), 2)] + [np.append(rng.integers(3, 9, rng.integers(0, 50)), 2) for _ in range(100)]
    ids, bounds = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, marks, g = rp.compress(ids, bounds, least=4)
    parts = [symbols[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
    assert not plain_re_pair([p.tolist() for p in parts], 4, rp.TERMINALS)
    for p, d in zip(parts, docs, strict=True):
        assert np.array_equal(g.expand(p), d)
    assert len(parts[1]) <= 8 and len(parts[0]) <= 40  # of 4096 ids each, doubled again and again


def test_an_id_that_is_no_terminal_is_refused():
    with pytest.raises(ValueError):
        rp.pack([1], np.array([5, 70_000, 2], np.uint32), np.array([0, 3]))
    s = rp.Shard(rp.pack([1], np.array([5, 70_000, 2], np.uint32), np.array([0, 3]), terminals=100_000))
    assert s.document(0).tolist() == [5, 70_000, 2]


def test_more_rules_than_16_bits_hold():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 100, 400_000).astype(np.uint32)
    s = rp.Shard(rp.pack([1], ids, np.array([0, len(ids)]), terminals=64_000))
    assert len(s.grammar.left) > 1_536 and np.array_equal(s.document(0), ids)


def test_a_shard_file_read_at_random():
    docs = library(TEXTS)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    s = rp.Shard(rp.pack([None, *range(1, len(docs))], np.concatenate(docs), bounds))
    assert s.doc_ids == [None, *range(1, len(docs))] and np.array_equal(s.before, bounds[:-1])
    for k, (d, e) in enumerate(zip(docs, s.documents(), strict=True)):
        assert np.array_equal(s.document(k), d) and np.array_equal(e, d)
        assert np.array_equal(s.part(k, 1, max(1, len(d) - 1)), d[1 : max(1, len(d) - 1)])
    with pytest.raises(ValueError):
        rp.Shard(b"something else")


def test_files_through_spark(spark, tmp_path):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "no id", 1)]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(4)
    where = str(tmp_path / "shards")
    rp.write(docs, where, shard_ids=3000)
    got = sorted(rp.read(spark, where).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r, want in zip(got, library([{k: t for k, t, _ in rows}[r.doc_id] for r in got]), strict=True):
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want), want.astype("<u4").tobytes())
        at += len(want)
    rp.write(docs.limit(0), str(tmp_path / "none"))
    assert rp.read(spark, str(tmp_path / "none")).count() == 0


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got, at = {r.doc_id: r for r in rp.op8_repair_ids(spark, sf).collect()}, 0
    for d, want in zip(docs, library([d.text for d in docs]), strict=True):
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(want), zlib.crc32(want.astype("<u4").tobytes()))
        at += len(want)
