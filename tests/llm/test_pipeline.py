"""Each stage of the pipeline on a small corpus, against what it must do."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.simhash_dedup import shingle_hashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"word{k}" for k in range(4000)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    texts = {k: prose(150) for k in range(60)}
    for k in range(60, 70):  # exact copies
        texts[k] = texts[k - 60]
    for k in range(70, 80):  # near copies: two words of 150
        w = texts[k - 60].split()
        w[20], w[90] = "changed", "changed"
        texts[k] = " ".join(w)
    items = [prose(40) for _ in range(5)]
    for k in range(80, 85):
        texts[k] = prose(60) + " " + items[k - 80] + " " + prose(60)
    texts[85] = prose(60) + ' password = "hunter2hunter2" ' + prose(60)
    texts |= {90: None, 91: "", 92: "too short", 93: "same words over and over again here " * 30, 94: " ".join(f"w{k}###" for k in range(60))}
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t)) for k, t in texts.items()]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([*rows, rows[5], (None, prose(100), "en", "s1", 1)], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def kept(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality rules"](spark, docs, folder)
    assert first.columns == COLUMNS
    assert kept(first) == sorted([*range(86), 5]) + [None]
    second = stages["near dedup"](spark, first, folder)
    assert second.columns == COLUMNS
    similar = lambda a, b: len(a & b) / len(a | b) >= 0.8
    sets = {k: set(h.tolist()) for k in range(86) for h in shingle_hashes(texts[k], 5)}
    best = [k for k in sets if not any(similar(sets[k], sets[j]) for j in range(k))]
    assert kept(second) == [*best, None]
    third = stages["decontamination"](spark, second, folder)
    assert third.columns == COLUMNS and kept(third) == [*(k for k in best if k not in range(80, 85)), None]
    fourth = stages["secret scans"](spark, third, folder)
    assert fourth.columns == COLUMNS and kept(fourth) == kept(third)
    clean = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert "hunter2" not in clean[85] and "[secret]" in clean[85]
    assert all(clean[k] == texts[k] for k in clean if k not in (85, None))
    mixed = stages["source mixing"](spark, fourth, folder).collect()
    words = collections.Counter()
    for r in mixed:
        words[r["source"]] += len(r["text"].split(" "))
    total = sum(len(t.split(" ")) for t in clean.values())
    assert abs(sum(words.values()) - total) <= 4
    known = {k: set(t.split(" ")) for k, t in clean.items()}
    assert all(set(r["text"].split(" ")) <= known[r["doc_id"]] for r in mixed)
    times = collections.Counter()
    for r in mixed:
        times[r["doc_id"]] += len(r["text"].split(" "))
    assert all(n <= 3 * len(clean[k].split(" ")) for k, n in times.items())


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_extra_columns_and_null_ids(spark, tmp_path):
    """Rows are told apart by id and text; columns with any name are carried along."""
    r = random.Random(61)
    prose = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    a, b, c, d, item = prose(120), prose(120), prose(120), prose(120), prose(40)
    near = " ".join([*a.split()[:60], "changed", *a.split()[61:]])
    rows = [(1, a), (2, near), (2, b), (3, b), (3, b), (4, c), (4, c), (None, d), (None, d), (None, c), (None, prose(90)), (5, prose(50) + " " + item), (6, prose(50)), (6, item + " " + prose(50))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    extra = ["f", "n_words", "kept", "base_failed", "hash", "root", "fp", "first", "rows", "node", "item_id", "score", "start", "found", "__text", "shard", "rank", "size"]
    docs = docs.withColumns({x: F.lit(f"clash {x}") for x in extra})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, out = dict(corpus_pipeline.STAGES), docs
    for name in ("quality rules", "near dedup", "decontamination", "secret scans"):
        out = spark.createDataFrame(stages[name](spark, out, str(tmp_path)).toArrow())
        assert out.columns == docs.columns
        assert all(x[c] == f"clash {c}" for x in out.collect() for c in extra)
        if name == "quality rules":
            assert out.count() == len(rows)
        if name == "near dedup":
            got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str)
            assert got == sorted([(1, a), (2, b), (4, c), (None, d), *rows[10:]], key=str)
        if name == "decontamination":
            assert sorted(str(x["doc_id"]) for x in out.collect()) == ["1", "2", "4", "6", "None", "None"]
    assert stages["source mixing"](spark, out, str(tmp_path)).count() > 0


def test_mixing_keeps_line_breaks(spark):
    text = "def f(x):\n    return x\n\n\n| a |\tb |\n"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "  " + "\n\n".join(["para graph"] * 400), "en", "s", 1)], SCHEMA)
    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert text.strip() in {r["text"] for r in mixed}
    assert all(x in ("para graph", "para", "graph") for r in mixed if r["doc_id"] == 2 for x in r["text"].split("\n\n"))
