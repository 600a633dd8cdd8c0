import json
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import licensing
from trailmark.operators import corpus, search, training, validation
from trailmark.plans import fixtures as fx
from trailmark.sources import files, manifests
from trailmark.streaming import transcripts as ts

SOURCE = {"filename": "a.pdf", "title": "A", "publisher": "P", "license": "Public domain", "url": "u", "citation_prefix": "Manual A"}
CARD = {"slug": "ivy", "common_name": "Ivy", "scientific_name": "Hedera", "hazard_class": "Contact", "identification": "leaves", "field_response": ["wash"], "source_citation": "M", "commons_categories": ["Ivy"]}
IMAGE = {"title": "File:a.jpg", "license": "CC0", "attribution": "x", "credit": "", "descriptor_url": "d", "thumb_url": "t", "width": 9, "height": 8}


def write(path, value):
    path.write_text(json.dumps(value, indent=2), encoding="utf-8")
    return str(path)


def test_source_manifest(spark, tmp_path):
    path = write(tmp_path / "s.json", {"sources": [SOURCE, {**SOURCE, "filename": "b.pdf"}, {**SOURCE, "title": "Later"}]})
    assert {(r.filename, r.title) for r in manifests.sources(spark, path).collect()} == {("a.pdf", "Later"), ("b.pdf", "A")}
    with pytest.raises(manifests.ManifestError, match="entry 0 lacks license"):
        manifests.sources(spark, write(tmp_path / "bad.json", {"sources": [{**SOURCE, "license": ""}]}))


def test_card_manifest_and_lockfile(spark, tmp_path):
    row = manifests.cards(spark, write(tmp_path / "c.json", {"license": "l", "species": [CARD]})).first()
    assert (row.region, row.lookalikes, row.do_not, row.max_images) == ("", "", [], 3)
    for bad in ([{**CARD, "field_response": []}], []):
        with pytest.raises(manifests.ManifestError):
            manifests.cards(spark, write(tmp_path / "b.json", {"species": bad}))
    assert manifests.lockfile(spark, str(tmp_path / "none.json")).count() == 0
    locked = manifests.lockfile(spark, write(tmp_path / "l.json", {"species": {"ivy": [IMAGE], "viper": []}}))
    assert {r.slug: len(r.images) for r in locked.collect()} == {"ivy": 1, "viper": 0}
    manifests.write_lockfile(locked, str(tmp_path / "out"))
    assert {r.slug: len(r.images) for r in manifests.lockfile(spark, str(tmp_path / "out")).collect()} == {"ivy": 1, "viper": 0}
    assert manifests.should_write_lock(True, locked) and not manifests.should_write_lock(False, locked)
    cards = spark.createDataFrame([("ivy",), ("viper",)], "slug string")
    live = locked.select("slug", F.transform("images", lambda i: i).alias("images")).where("slug = 'ivy'").withColumn("slug", F.lit("viper"))
    assert {r.slug: len(r.images) for r in corpus.pinned_or_resolved(cards, locked, live).collect()} == {"ivy": 1, "viper": 1}


def test_image_answers(spark):
    def page(title, license_name="CC BY 4.0", width=1000, **more):
        return {"title": title, "imageinfo": [{"url": "full", "thumburl": "thumb", "descriptionurl": "page", "width": width, "height": 500, "thumbwidth": 640, "thumbheight": 480, "extmetadata": {"LicenseShortName": {"value": license_name}, "Artist": {"value": "<a href='x'>Some  One</a>"}}, **more}]}

    pages = [page("File:b.jpg"), page("File:a.PNG", "<i>Public domain</i>"), page("File:range map.jpg"), page("File:c.jpg", "CC BY-NC 4.0"), page("File:d.jpg", width=10), page("File:e.gif"), {"title": "File:f.jpg"}]
    df = spark.createDataFrame([("ivy", 0, json.dumps({"query": {"pages": pages}})), ("ivy", 1, json.dumps({"query": {"pages": pages[:1]}})), ("none", 0, "{}")], "slug string, category_pos int, body string")
    rows = licensing.pick_images(licensing.resolve_category(df)).orderBy("ordinal").collect()
    assert [(r.title, r.ordinal, r.license, r.attribution, r.thumb_url, r.width) for r in rows] == [("File:a.PNG", 0, "Public domain", "Some One", "thumb", 640), ("File:b.jpg", 1, "CC BY 4.0", "Some One", "thumb", 640)]
    assert licensing.disallowed(spark.createDataFrame([("MIT",), ("CC0",), (None,)], "license string")).count() == 2


def test_images_are_required(spark):
    cards = spark.createDataFrame([("ivy",), ("viper",)], "slug string")
    images = spark.createDataFrame([("ivy", "t", "CC0")], "slug string, title string, license string")
    with pytest.raises(validation.Refused, match="viper"):
        validation.require_images(cards, images)
    with pytest.raises(validation.Refused, match="MIT"):
        validation.require_images(cards, images.withColumn("license", F.lit("MIT")))


@pytest.fixture()
def store(tmp_path):
    path = str(tmp_path / "store.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE chunks (id INTEGER PRIMARY KEY, source_id INTEGER, section TEXT, page_start INTEGER, page_end INTEGER, citation TEXT, text TEXT, token_count INTEGER, embedding BLOB)")
    for i, section, page, citation, text, vector in fx.STORE.rows:
        db.execute("INSERT INTO chunks VALUES (?, 1, ?, ?, ?, ?, ?, ?, ?)", (i, section, page, page, citation, text, 8 * i, np.array(vector, "<f4").tobytes()))
    db.commit()
    db.close()
    return path


def test_a_sqlite_store_is_searched(spark, store, tmp_path):
    assert files.sqlite_table(spark, store, "meta") is None
    chunks = files.sqlite_table(spark, store, "chunks")
    vectors = corpus.resident(chunks)
    assert validation.require_corpus(vectors) == 4
    q = spark.createDataFrame([(1, [0.9, 0.4, 0.1, 0.0])], "query_id long, vector array<double>")
    hits = search.search(vectors.select("id", "vector"), vectors.select("id", "citation", "text"), q, 3, -1.0)
    assert [(r.id, round(r.similarity, 4)) for r in hits.orderBy("rank").collect()] == [(1, 0.9), (2, 0.4), (3, 0.1)]
    assert [r.id for r in training.usable(chunks, 16).orderBy("id").collect()] == [2, 3]
    with pytest.raises(sqlite3.OperationalError):
        files.sqlite_table(spark, str(tmp_path / "missing.db"), "chunks")


def test_files(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1 two\x0cpages")
    (tmp_path / "a.pdf").write_bytes(b"not a document")
    (tmp_path / "c.txt").write_bytes(b"other")

    def extract(raw):
        def fail():
            raise RuntimeError("bad page")

        return [*raw.decode().split("\x0c"), fail]

    found = files.binary_files(spark, str(tmp_path))
    assert {r.doc: r.pages for r in files.page_texts(found, extract).collect()} == {"a.pdf": ["not a document", ""], "b.pdf": ["%PDF-1 two", "pages", ""]}
    both = spark.createDataFrame([(bytearray(b"<html>"), bytearray(b"%PDF-2")), (bytearray(b"%PDF-1"), None), (None, None)], "url binary, mirror binary")
    assert [r.content and bytes(r.content) for r in files.first_success(both, "url", "mirror").collect()] == [b"%PDF-2", b"%PDF-1", None]
    (tmp_path / "vocab.txt").write_bytes("[PAD]\r\ncafé\r\n".encode())
    assert files.vocabulary(spark, str(tmp_path / "vocab.txt")) == {"[PAD]": 0, "café": 1}
    config = tmp_path / "t.json"
    config.write_text('{"max_sequence_length": 128,\n "do_lower_case": true}')
    assert files.tokenizer_config(spark, str(config)).max_sequence_length == 128
    lines = spark.createDataFrame([('{"messages":[{"role":"system","content":"é"},{"role":"user","content":"b"},{"role":"assistant","content":"c"}]}',), ('{"messages":[]}',)], "value string")
    files.write_lines(lines, str(tmp_path / "r.jsonl"))
    assert training.valid_records(files.records(spark, str(tmp_path / "r.jsonl"))).count() == 1
    vectors = spark.createDataFrame([("a", [0.12345678, 1.0])], "text string, vector array<double>")
    files.write_lines(files.parity_json(vectors, "m", 2), str(tmp_path / "p"))
    row = files.parity_fixtures(spark, str(tmp_path / "p")).first()
    assert (row.embedding_model, row.text, row.embedding) == ("m", "a", [0.123457, 1.0])


def test_tables_of_a_build_are_written_and_replaced(spark, tmp_path):
    base = str(tmp_path / "store")
    for n in (3, 2):
        corpus.write(spark, base, chunks=spark.range(n), sources=spark.range(1))
    assert spark.read.parquet(f"{base}/chunks").count() == 2


EVENTS = "event_id long, key string, ts timestamp, kind string, text string, code int"


def events(spark, rows):
    return spark.createDataFrame([(k, key, None, kind, text, code) for k, (key, _, kind, text, code) in enumerate(rows)], EVENTS).drop("ts").join(spark.createDataFrame([(k, at) for k, (_, at, *_rest) in enumerate(rows)], "event_id long, at double"), "event_id").withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).drop("at")


ROWS = [("a", 0.0, "partial", "he", None), ("a", 0.5, "partial", "hello", None), ("a", 0.9, "final", "hello there", None), ("a", 1.0, "partial", "next", None), ("b", 0.0, "partial", "only", None), ("b", 0.2, "error", None, 216), ("b", 3.0, "partial", "later", None), ("c", 0.0, "error", None, 7)]


def test_transcripts_in_batch(spark):
    got = {(r.key, r.session): (r.text, r.ended_by) for r in ts.transcripts(events(spark, ROWS), 1.5, ["key"]).collect()}
    assert got == {("a", 1): ("hello there", "final"), ("a", 2): ("next", "timeout"), ("b", 1): ("only", "timeout"), ("b", 2): ("later", "timeout")}
    assert {r.key: r.text for r in ts.latest(events(spark, ROWS)).collect()} == {"a": "next", "b": "later"}


def test_transcripts_in_a_stream(spark, tmp_path):
    ts.use_rocksdb(spark)
    source = str(tmp_path / "in")
    events(spark, [r for r in ROWS if r[0] == "a"][:3] + [("b", 0.0, "partial", "only", None), ("c", 0.1, "error", None, 301), ("d", 0.1, "error", None, 7)]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    query = ts.finish(stream, 500).writeStream.format("memory").queryName("finished").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("finished").count() < 3:
            time.sleep(0.5)
        assert {(r.key, r.text, r.ended_by) for r in spark.table("finished").collect()} == {("a", "hello there", "final"), ("b", "only", "timeout"), ("d", "", "error")}
    finally:
        query.stop()


def test_states(spark):
    df = spark.createDataFrame([("a", 1, "listen"), ("a", 2, "stop"), ("a", 3, "listen"), ("a", 4, "answer"), ("b", 1, "ask"), ("b", 2, "fail"), ("c", 1, "stop")], "key string, ts int, event string")
    assert {r.key: r.state for r in ts.final_state(df).collect()} == {"a": "speaking", "b": "error", "c": "idle"}


def test_events_that_come_together_wait_as_one_row_of_the_state():
    import types

    import pandas as pd

    class State:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def exists(self):
            return bool(self.rows)

        def appendList(self, rows):  # noqa: N802
            self.rows += rows

        def appendValue(self, row):  # noqa: N802
            self.rows.append(row)

        put, clear = lambda self, rows: setattr(self, "rows", list(rows)), lambda self: setattr(self, "rows", [])

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)

    waiting, timers = State(), []
    handle = types.SimpleNamespace(getValueState=lambda *a: Value(), getListState=lambda *a: waiting, registerTimer=timers.append)
    finisher = ts.EventFinisher(1_000_000)
    finisher.init(handle)
    at = lambda us: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1_000)
    part = pd.DataFrame({"us": [1_000, 3_000, 2_000, 5_000_000], "event_id": [1, 3, 2, 4], "kind": ["partial", "final", "partial", "partial"], "text": ["a", None, "b", "d"]})
    assert not list(finisher.handleInputRows(("k",), iter([part, part[:0]]), None))
    assert len(waiting.rows) == 1 and timers == [2]
    (out,) = finisher.handleExpiredTimer(("k",), at(4_000), None)
    assert out.values.tolist() == [["k", 1, None, "final", 3]]
    assert len(waiting.rows) == 1 and timers[1:] == [5_001]
    assert not list(finisher.handleExpiredTimer(("k",), at(5_500_000), None)) and not waiting.rows
    (out,) = finisher.handleExpiredTimer(("k",), at(7_000_000), None)
    assert out.values.tolist() == [["k", 2, "d", "timeout", 1]]
