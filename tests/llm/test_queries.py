"""The registered queries on a small folder of tables, against their contracts."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from quarry.llm import queries, warc

WORDS = [f"word{k}" for k in range(500)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(77)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    texts = {k: prose(r.randrange(1, 200)) for k in range(120)}
    texts |= {k: texts[k - 100] for k in range(120, 140)}
    texts |= {140: None, 141: "", 142: "é PassWord: hunter22 token=AKIA" + "Q7" * 9 + " 04dbebab91ab85687d33eeaaf9ac699e", 143: "One Two", 144: "A\x85b c\xa0d"}
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, t in texts.items()]
    pages = [(k, f"http://www.example.com/{'en' if k % 2 else 'fr'}/{k}", "<p>" + prose(r.choice((5, 3000))) + "</p>" if k % 7 else "same") for k in range(60)] + [(60, None, None)]
    items = [prose(30), texts[3] if len(texts[3].split()) > 12 else prose(20)]
    out = str(tmp_path_factory.mktemp("tables"))
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", pages, "page_id long, url string, html string"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"), ("labels", [(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{out}/{name}.parquet")
    return out, texts, pages


def test_every_operator_has_one_query():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 11)]


def test_op1(spark, folder):
    got = queries.op1_source_mixing(spark, folder[0]).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in folder[1].items()}
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=3) and all(r["taken"] <= 3 * r["size"] for r in got)


def test_op1_counts_no_words_of_null_without_ansi(spark, folder):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert min(r["size"] for r in queries.op1_source_mixing(spark, folder[0]).collect()) == 0
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_op2_goes_through_segments(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "reassemble", lambda found, f=warc.reassemble: seen.append(found.filter("type = 'continuation'").count()) or f(found))
    got = {r["page_id"]: tuple(r) for r in queries.op2_warc(spark, folder[0]).collect()}
    first = {}
    for k, _, html in folder[2]:
        first.setdefault((html or "").encode(), k)
    for k, _, html in folder[2]:
        raw = (html or "").encode()
        again = first[raw] != k
        assert got[k] == (k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None)
    assert len(got) == len(folder[2]) and seen[0] > 50


def test_op4(spark, folder):
    def bits(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {k: bits(t) for k, t in folder[1].items()}
    least = {k: k for k in want}
    for _ in range(5):
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 4:
                    least[a] = min(least[a], least[b])
    got = queries.op4_simhash_dedup(spark, folder[0]).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{want[k]:016x}", least[k]) for k in want}


def test_op5_and_op10_hold_out_their_folds(spark, folder):
    for query, folds in ((queries.op5_lm_scoring, 7), (queries.op10_quality_classifier, 4)):
        got = {r["doc_id"]: r["held_out"] for r in query(spark, folder[0]).collect()}
        assert got == {k: zlib.crc32(str(k).encode()) % folds == 2 for k in folder[1]}


def test_op6(spark, folder):
    got = {r["doc_id"]: r["n_bytes"] for r in queries.op6_token_counts(spark, folder[0]).collect()}
    assert got == {k: len((t or "").encode()) for k, t in folder[1].items()}


def test_op7(spark, folder):
    got = queries.op7_decontamination(spark, folder[0]).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 1} <= {3, 123} and not any(r["item_id"] == 0 for r in got)


def test_op9(spark, folder):
    got = {r["doc_id"]: r for r in queries.op9_secret_scans(spark, folder[0]).collect()}
    text = folder[1][142]
    spans = f"assign:2:20,assign:21:{text.index(' 04')},access:27:{text.index(' 04')},hex:{text.index('04d')}:{len(text)}"
    r = got[142]
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (2, 1, 1, spans) and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert all(x["spans"] == "" for k, x in got.items() if k != 142)
