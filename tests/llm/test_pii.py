"""op13: base spans against the patterns as they are written, contexts on small corpora."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trailmark.llm import pii
from trailmark.llm.common import Scratch

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _ok(kind: str, value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d * 2 if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[int, int, int]]:
    return [(k + 1, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if _ok(kind, m[0])]


def _scan(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    out = pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: ([tuple(x) for x in r["base"]], [tuple(x) for x in r["spans"]]) for r in out}


def test_base_spans_equal_the_written_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "x.y@z-1.de.", "@", ".", "..", "1.2.3.4", "256.1.1.1", "5", "00300.1.1.1", "+", "+1 (017) 555-7713", "4845168114407329", "4845 1681-1440 7329", "9807915762804490", " ", "-", "  ", "é", "\n", "%+-", "(", ")", "12345678", "𝒜", "a@b", "@b.c", "+4845168114407329"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "no data", "7" * 30_000, "a" * 60_000, "a" * 20_000 + "@b.c", "+1" + "(" * 30_000, "1.2.3.4 " * 3_000, "a@b.cc@d.e@f"]
    found = _scan(spark, texts)
    for k, t in enumerate(texts):
        assert found[k][0] == brute(t), t
        assert set(found[k][0]) <= set(found[k][1])


def test_contexts_find_unseen_identifiers_and_leave_others_alone(spark):
    seeds = [f"word{k} please call me at +1 (01{k % 10}) 555-77{k:02d} today" for k in range(12)]
    unseen = ["someone said: please call me at 555-7209 today", "and write to 555-7209 again"]
    clean = ["call number 555-8888 of the list", "please call me at noon today", "chapter 12 has 9807915762804490 in it", "version 1.2.3"]
    mails = [f"our desk: write to ann{k}@mail.example.com now" for k in range(9)] + ["our desk: write to ann [at] mail [dot] example [dot] com now"]
    texts = seeds + unseen + clean + mails + seeds[:1] * 3
    found = _scan(spark, texts)
    added = {k: [(pii.KINDS[s[0] - 1], texts[k][s[1] : s[2]]) for s in found[k][1] if s not in found[k][0]] for k in found}
    assert {k: v for k, v in added.items() if v} == {12: [("phone", "555-7209")], 13: [("phone", "555-7209")], len(texts) - 4: [("email", "ann [at] mail [dot] example [dot] com")]}


def test_copies_of_one_seed_make_no_pattern(spark):
    found = _scan(spark, ["please call me at +1 (017) 555-7713 today"] * 50 + ["please call me at 555-7209 today"])
    assert all(base == spans for base, spans in found.values())


def test_digits_and_columns(spark):
    rows = [(None, "mail a@b.cd", 1), (7, None, 2), (7, "mail a@b.cd", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("kind", F.lit("x")).withColumn("value", F.lit(1)).withColumn("spans", F.lit(2))
    got = sorted((str(r["doc_id"]), len(r["base"])) for r in pii.scan(df).collect())
    assert got == [("7", 0), ("7", 1), ("None", 1)]
    assert pii.scan(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    texts = ["a@b.cd and 1.2.3.4", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in pii.op13_contextual_pii(spark, str(tmp_path)).collect()}
    assert rows[0]["n_email"] == rows[0]["n_ip"] == 1 and rows[0]["n_card"] == rows[0]["n_phone"] == 0
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest() and rows[0]["spans"] == "email:0:6,ip:11:18"
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[1]["spans"] == ""


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    texts, found = pii.spans(docs, Scratch(spark, "pii"))
    for df in (found, pii.scan(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("digits", "right"), [("4845168114407329", True), ("4845168114407328", False), ("0", True)])
def test_checksum(spark, digits, right):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] == right
