"""Operators that bring rows together, against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, decontamination, lm_scoring, quality_classifier, simhash_dedup, source_mixing, url_filters, warc
from quarry.llm.shared import new_path

rng = random.Random(7)
VOCABULARY = [f"w{k}" for k in range(3000)]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100 + k, 100) for k in range(1, 80)] + [(300, 300), (500, 501), (501, 500)]
    pairs += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    df = spark.createDataFrame([*pairs, (None, 5), (7, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df).collect()}
    assert got == roots([(a, b) for a, b in pairs if a != b])
    assert components.connected(df.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "n"), [(4, 10), (4, 10**6), (4, 10**9), (2, 10**5)])
def test_blocks_lose_no_link(distance, n):
    masks = simhash_dedup.block_masks(distance, n)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), distance):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "GROUP_ROWS", 4)
    texts = [None, "", "one", "One", "a b c d"]
    for k in range(12):
        base = prose(150, k).split()
        for _ in range(5):
            w = list(base)
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += ["same text here with five words"] * 6
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "same text here with five words"), (ids[7], texts[7])], "doc_id long, text string")
    docs = docs.withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    fp = {i: int(simhash_dedup.simhash(t or "", 4)[0]) for i, t in zip(ids, texts, strict=True)}
    want = roots([(a, b) for a in ids for b in ids if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = simhash_dedup.near_duplicates(docs).select("doc_id", simhash_dedup.hex16(F.col("fp")).alias("h"), "component_id").collect()
    assert len(got) == len(texts) + 2
    same = fp[ids[-1]]
    for r in got:
        own = same if r["doc_id"] is None else fp[r["doc_id"]]
        assert r["h"] == f"{own:016x}"
        assert r["component_id"] == want[ids[-1] if r["doc_id"] is None else r["doc_id"]]
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_similar_documents(spark):
    texts, group = [], []
    for k in range(30):
        base = prose(200, 100 + k).split()
        for copy in range(3):
            w = list(base)
            for at in rng.sample(range(len(w)), copy * 2):
                w[at] = "new"
            texts.append(" ".join(w))
            group.append(3 * k)
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "short"])), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(docs).collect()}
    assert [got[k] for k in range(len(texts))] == group
    assert got[len(texts) + 2] == len(texts) + 2


def grouped(texts, size, similarity):
    sets = [{x for h in simhash_dedup.shingle_hashes(t, size) for x in h.tolist()} for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return {k: k for k in range(len(sets))} | roots(pairs)


@pytest.mark.parametrize("rows", [1024, 4])
def test_similar_documents_compares_every_uncertain_pair(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash_dedup, "GROUP_ROWS", rows)
    r, texts = random.Random(21), []
    for k in range(4):
        base = prose(240, 700 + k).split()
        for _ in range(30):  # pairs a little above and below 0.8
            w = list(base)
            for at in r.sample(range(len(w)), r.choice((3, 4, 5, 5, 6))):
                w[at] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_documents(docs, recall=0.999999).collect()}
    assert got == grouped(texts, 5, 0.8)


def test_similar_documents_compares_sets_of_shingles(spark):
    def with_rules(k):  # ten rules of 20 dots among 800 words
        w = prose(800, 800 + k).split()
        return " ".join(" ".join([*w[at : at + 80], *["."] * 20]) for at in range(0, 800, 80))

    line = "a short line that is repeated over and over again"
    texts = [with_rules(k) for k in range(4)] + [prose(100, 850) + " " + " ".join([line] * n) for n in (2, 60)] + ["x x x x x x", "x x x x x x x x"]
    rows = [*enumerate(texts), (None, prose(60, 860)), (None, prose(60, 860) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["component_id"]) for x in simhash_dedup.similar_documents(docs.filter("doc_id IS NOT NULL")).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert len(simhash_dedup.similar_documents(docs).collect()) == len(rows)


def test_similar_documents_reaches_far_pairs(spark):
    """Pairs at Jaccard 0.8 whose fingerprints happen to differ by 95 to 102 bits."""
    pairs = []
    for k in range(1500):
        a = prose(49, 10_000 + k)
        b = " ".join([*a.split()[:24], "changed", *a.split()[25:]])
        x, y = (simhash_dedup.simhash(t, 5, 8) for t in (a, b))
        if 95 <= np.bitwise_count(x ^ y).sum() <= 102:
            pairs.append((a, b))
    assert len(pairs) >= 10
    docs = spark.createDataFrame(list(enumerate(t for p in pairs for t in p)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_documents(docs, recall=0.999999).collect()}
    assert got == {k: k - k % 2 for k in range(2 * len(pairs))}


def test_bound_and_bands_give_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bound, banded = simhash_dedup.bound_for(512, 0.1516, recall)
        bits, bands = simhash_dedup.bands_for(10**6, 1 - 0.1516, banded)
        lost = sum(math.comb(512, k) * 0.1516**k * 0.8484 ** (512 - k) for k in range(bound + 1, 513))
        assert (1 - lost) * (1 - (1 - 0.8484**bits) ** bands) >= recall


def test_contaminated(spark):
    items = [prose(40, 900 + k) for k in range(8)] + ["two words", "", None, prose(30, 950)]
    edited = items[1].split()
    for at in (5, 17, 29):
        edited[at] = "other"
    del edited[20]
    texts = [
        prose(300) + " " + items[0].upper() + ". " + prose(200), prose(50) + " " + " ".join(edited) + " " + prose(50), prose(400), None, "", items[2], items[2],
        "we found two words here", " ".join(items[3].split()[:10]) + " " + prose(100), prose(20_000) + " " + items[4],
    ]
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (None, items[0])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(items), (2, items[2]), (None, items[0])], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (5, 2), (6, 2), (7, 8), (9, 4)}
    assert got[0, 0]["score"] == 1.0 and got[0, 0]["start"] == 300 and got[0, 0]["n_words"] == 40
    assert 0.5 < got[1, 1]["score"] < 1.0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_with_frequent_seeds(spark):
    """A copy whose only intact words are found in over a thousand other passages."""
    item = prose(20, 970).split()
    changed = [w if 8 <= k < 13 or k % 2 else f"changed{k}" for k, w in enumerate(item)]
    texts = [prose(30, 971) + " " + " ".join(changed) + " " + prose(30, 972)]
    texts += [f"a{k} b{k} c{k} " + " ".join(item[8:13]) + f" d{k} e{k}" for k in range(1100)] + [" ".join(item)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    want = {k: brute_align(t.split(), item) / 40 for k, t in enumerate(texts)}
    got = {r["doc_id"]: r["score"] for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {k: x for k, x in want.items() if x >= 0.5} and set(got) == {0, 1101, 1102, 1103}


def test_contaminated_with_evenly_spread_edits(spark):
    """Every k-th word changed or left out, a word put in after every k, or edits at
    random: whatever brute force scores at 0.5 + 1.5 / n or more is found."""
    r, texts, items = random.Random(31), [], [prose(n, 980 + n) for n in (8, 12, 20, 41)]
    for t in items:
        w = t.split()
        for k in range(2, 8):
            texts.append([x if (i + 1) % k else f"new{i}" for i, x in enumerate(w)])
            texts.append([x for i, x in enumerate(w) if (i + 1) % k])
            texts.append([y for i, x in enumerate(w) for y in ([x] if (i + 1) % k else [x, f"in{i}"])])
        for _ in range(20):
            at = r.sample(range(len(w)), r.randrange(len(w) // 2))
            texts.append([x if i not in at else f"new{i}" for i, x in enumerate(w)])
    texts = [[*prose(60, 2000 + k).split(), *t, *prose(60, 3000 + k).split()] for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    score = {(d, i): brute_align(t, items[i].split()) / (2 * len(items[i].split())) for d, t in enumerate(texts) for i in range(len(items))}
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.contaminated(docs, bench).collect()}
    assert all(score[k] == pytest.approx(x) and x >= 0.5 for k, x in got.items())
    due = {(d, i) for (d, i), x in score.items() if x >= 0.5 + 1.5 / len(items[i].split())}
    assert due <= set(got) and len(due) > 60


def brute_align(doc, item):
    best, row = 0, [0] * (len(doc) + 1)
    for w in item:
        now = [0]
        for j, x in enumerate(doc):
            now.append(max(0, row[j] + (2 if x == w else -1), row[j + 1] - 1, now[j] - 1))
        row, best = now, max(best, *now)
    return best


def test_alignment_scores():
    for _ in range(100):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], dtype=np.uint64)
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 15))], dtype=np.uint64)
        assert decontamination.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def shared_targets(size, weights=(1, 2, 3), most=3):
    names = sorted((n for n in size if n is not None), key=str.encode) + ([None] if None in size else [])
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(most * size[n] for n in full)
        free = sum(weight[n] for n in names if n not in full)
        target = {n: most * size[n] if n in full else left * weight[n] / free for n in names}
        over = {n for n in names if n not in full and target[n] > most * size[n] + 1e-9}
        if not over:
            return target
        full |= over


def test_source_mixing(spark):
    rows = [(k, prose(rng.randrange(0, 400)), ["b", "a", None, "é", "", "tiny"][min(5, k % 11)]) for k in range(300)]
    rows = [(k, t if s != "tiny" else "x y", s) for k, t, s in rows] + [(500, None, "a"), (501, "", "only empty"), (3, "again", "a"), (3, "again", "a"), (None, "no id", "b"), (502, prose(30_000), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit("clash")).withColumn("size", F.lit("clash"))
    got = source_mixing.shares(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, source_mixing.shares(docs).collect()))
    assert len(got) == len(rows)
    size, taken = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
    target = shared_targets(size)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5
    mixed = source_mixing.mixed_text(docs).collect()
    by_source = collections.Counter()
    for r in mixed:
        by_source[r["source"]] += len(r["text"].split(" "))
    assert by_source == {s: n for s, n in taken.items() if n}
    assert source_mixing.shares(docs.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(source_mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("y"), "id")
        df = df.withColumn("back", source_mixing.permuted(F.col("y"), F.lit(n), F.lit(3), back=True))
        rows = df.collect()
        assert sorted(r["y"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_archives_round_trip(spark):
    sep = "\r\n\r\nWARC/1.1\r\n"
    bodies = ["a", None, "", "b" * 1000, sep * 40, "é" * 333, "a", "a", "b" * 1000, "WARC/1.0\r\n" * 30, "\r\n" * 100]
    pages = [(k, f"http://h/{k}\r\nX: y", b) for k, b in enumerate(bodies)] + [(0, "http://again", "a"), (None, None, "none has this"), (None, None, "a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("data", F.lit("clash"))
    path = new_path(spark, "warc")
    warc.write(df, path, segment_bytes=50)
    got = warc.read_pages(spark, path).collect()
    first = {}
    for i, _, b in pages:
        if i is not None:
            first[b or ""] = min(first.get(b or "", i), i)
    want = []
    for i, _, b in pages:
        raw, f = (b or "").encode(), first.get(b or "")
        again = f is not None and f != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    payloads = {bytes(r["payload"]) for r in warc.reassemble(warc.records(spark, path)).collect()}
    assert payloads == {(b or "").encode() for b in bodies} | {b"none has this"}
    empty = new_path(spark, "warc")
    warc.write(df.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_broken_segments_are_reported(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string"), path, segment_bytes=50)
    found = warc.records(spark, path)
    assert warc.reassemble(found).first()["complete"]
    for lost in ("segment = 2", "total_length IS NOT NULL"):
        r = warc.reassemble(found.filter(f"NOT ({lost})")).first()
        assert not r["complete"] and r["payload"] is None
    assert warc.unchunked(b"5\r\nhello\r\n0\r\n\r\n") == b"hello" and warc.unchunked(b"5\r\nhel") is None and warc.unchunked(b"zz\r\n") is None


def test_archives_of_other_writers(spark, tmp_path):
    """Blocks that hold the start of a record, malformed numbers, a record cut short."""
    import gzip

    def rec(kind, block, *more, length=None):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, *more, b"Content-Length: " + (b"%d" % len(block) if length is None else length)]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    inner = http + b"a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.1 end"
    parts = [
        rec(b"warcinfo", b"about"), rec(b"response", inner, b"X-Page-ID: 1"), rec(b"response", http + b"two", b"X-Page-ID: 2"),
        rec(b"response", http + b"bad", b"X-Page-ID: 3", length=b"many"), rec(b"response", http + b"short", b"X-Page-ID: 4", length=b"5000"),
        rec(b"continuation", b"x", b"WARC-Segment-Number: one", b"WARC-Segment-Origin-ID: <none>"), rec(b"response", http + b"five", b"X-Page-ID: 5"),
        rec(b"response", inner, b"X-Page-ID: 6"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[1:3]) + rec(b"response", http + b"cut", b"X-Page-ID: 7")[:-12])
    got = {(r["page_id"], bytes(r["payload"]) if r["payload"] is not None else None, r["complete"]) for r in warc.reassemble(warc.records(spark, str(tmp_path))).collect()}
    body = inner[len(http) :]
    assert got == {("1", body, True), ("2", b"two", True), ("3", None, False), ("4", None, False), (None, None, False), ("5", b"five", True), ("6", body, True), ("7", None, False)}
    assert {r["page_id"]: r["complete"] for r in warc.read_pages(spark, str(tmp_path)).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, None: False}


def test_url_filters(spark):
    link = lambda to: f'<html><link href="{to}" rel="canonical"></html>'
    moved = lambda to: f"<meta http-equiv=refresh content='0; url={to}'>"
    pages = [
        (1, "HTTPS://Example.COM/en/x?y#z", None, "example.com", "/en/x", "example.com/en/", "block"),
        (2, "http://www.example.com/en/", "", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "http://a.b.net/fr/1", "", "a.b.net", "/fr/1", "net/fr/", "block"),
        (4, "http://notexample.net/en/", "", "notexample.net", "/en/", None, "allow"),
        (5, None, link("http://x.net/fr/"), "", "", None, "allow"),
        (6, "no scheme/fr/", "", "", "", None, "allow"),
        (7, "http://clean.org/a", link("http://x.net/fr/2"), "clean.org", "/a", None, "block"),
        (8, "http://other.org/b", moved("http://clean.org/a"), "other.org", "/b", None, "block"),
        (9, "http://fine.com/c", link("http://x.net/fr/2"), "fine.com", "/c", "com/", "allow"),
        (10, "http://lone.org/", link("/self"), "lone.org", "/", None, "allow"),
        (11, "http://com", "", "com", "", None, "allow"),
        (12, "http://CLEAN.org/a#part", "", "clean.org", "/a", None, "block"),
        (12, "http://CLEAN.org/a#part", "", "clean.org", "/a", None, "block"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = url_filters.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((p[0], *p[3:])) for p in pages)
    assert url_filters.judge(df.limit(0)).count() == 0


def test_url_rules_against_each_rule_by_itself(spark):
    """Many rules, as a table: as many as 20,000 are no matter of the plan."""
    r = random.Random(51)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "a", ""]
    paths = ["/", "/a", "/a/b", "/a/b/c", "", "/b", "/é"]
    rules = [(r.choice(["allow", "block"]), h, p) for h in hosts for p in paths if h and r.random() < 0.4]
    many = rules + [("block", f"h{k}.org", f"/p{k % 50}") for k in range(20_000)] + [("block", None, "/"), ("allow", "com", None)]
    sites = [(h, p) for h in [*hosts, "c.b.a.com", "notcom", "a.b.a.com", "h7.org", "x.h8.org"] for p in [*paths, "/a/b/c/d", "/p7", "/p8"]]
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(sites)], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    table = spark.createDataFrame(many, "verdict string, host string, path string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filters.judge(pages, rules=table).collect()}
    for k, (h, p) in enumerate(sites):
        fit = [(len(y + z), y + z, v) for v, y, z in many if y and z is not None and (h == y or h.endswith("." + y)) and p.startswith(z)]
        want = max(fit)[1:] if h and fit else (None, "allow")
        assert got[k] == want, (h, p)
    assert {x["verdict"] for x in url_filters.judge(pages, rules=()).collect()} == {"allow"}


def test_language_model(spark):
    r = random.Random(3)
    tongues = [[f"{c}{k}" for k in range(200)] for c in "abc"]
    texts = [" ".join(r.choices(tongues[k % 3], [1 / (n + 1) for n in range(200)], k=r.randrange(1, 120))) for k in range(600)]
    rows = [*enumerate(texts), (600, None), (601, ""), (601, ""), (None, "a1 A1 zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("row", F.lit("clash"))
    lower = lambda t: ["".join(c.lower() if c < "\x80" else c for c in w) for w in (t or "").split()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in [*lower(t), ""])
    total, distinct = sum(counts.values()), len(counts)
    got = lm_scoring.score(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    gain = []
    for x in got:
        tokens = [*lower(text[x["doc_id"]]), ""]
        assert x["held_out"] == held(x["doc_id"])
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert x["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert x["score"] < 0
        if x["held_out"]:
            gain.append((x["score"] - x["base_score"]) / x["n_tokens"])
    assert np.mean(gain) > 0
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_language_model_with_words_that_tasks_do_not_hold(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"common common w{k} w{k // 2}") for k in range(300)], "doc_id long, text string")
    whole = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 3)
    for r in lm_scoring.score(docs).collect():
        assert (r["n_known"], r["base_score"]) == (whole[r["doc_id"]]["n_known"], pytest.approx(whole[r["doc_id"]]["base_score"]))


def small_model(steps=3):
    words = {f"w{k}".encode(): 100 - k for k in range(40)} | {b"": 30}
    top = sorted(words, key=lambda w: (-words[w], w))[:20]
    rest = [w for w in words if w not in top]
    vocab = lm_scoring.Vocabulary(words, {w: k for k, w in enumerate(top)}, sum(words.values()), len(words), (sum(words[w] for w in rest), len(rest)))
    model, numbering = lm_scoring.Model(*vocab.starts()), lm_scoring.Numbering(vocab)
    places, at, _ = lm_scoring.numbered(numbering, [[b"w1", b"w2", b"w3"]] * 50 + [[b"w30", b"far", b"w0"]] * 20)
    for _ in range(steps):
        sums = lm_scoring.Sums()
        sums.add(model, numbering.feature[places], at)
        row, observed, expected = sums.rows()
        cells = np.zeros((2, lm_scoring.CLASS_ROWS + lm_scoring.WORD_ROWS, lm_scoring.CLASSES))
        cells[0][row], cells[1][row] = observed, expected
        model = model.moved([(cells[0][x], cells[1][x]) for x in (slice(lm_scoring.CLASS_ROWS), slice(lm_scoring.CLASS_ROWS, None))])
    return vocab, model, numbering


def test_model_probabilities_sum_to_one():
    vocab, model, numbering = small_model()
    total = 0.0
    for w in [*vocab.words, b"never seen"]:
        places, at, _ = lm_scoring.numbered(numbering, [[b"w1", b"w2", w]])
        p = np.exp(model.log_probabilities(numbering.feature[places], at[2:3])[0])
        total += p if w in vocab.rank else p * (vocab.words.get(w, 0) + 1) / (sum(vocab.rest) + 1)
    assert total == pytest.approx(1.0, abs=1e-4)


def brute_model(model, numbers, at):
    """(log-likelihood, {(table, row, outcome): (observed, expected)}) word by word."""
    log, cells = 0.0, collections.defaultdict(lambda: [0, 0.0])
    for t in at.tolist():
        one = np.array([t])
        h, own = model.features(numbers, one)[:, 0], int(numbers[t])
        k = own // lm_scoring.MEMBERS + 1 if own < lm_scoring.CLASSES * lm_scoring.MEMBERS else 0
        choices = [(0, model.class_table, model.class_rows(h).tolist(), model.class_bias, k)]
        if k:
            choices.append((1, model.word_table, model.word_rows(h[list(lm_scoring.WORD_FEATURES)], np.full(len(lm_scoring.WORD_FEATURES), k)).tolist(), model.word_bias[k], own % lm_scoring.MEMBERS))
        for table, weights, rows, bias, outcome in choices:
            logits = [sum(float(weights[r][c]) for r in rows) + float(bias[c]) for c in range(len(bias))]
            p = [math.exp(x) for x in logits]
            log += math.log(p[outcome] / sum(p))
            for r in rows:
                for c in range(len(p)):
                    cells[table, r, c][0] += c == outcome
                    cells[table, r, c][1] += p[c] / sum(p)
    return log, cells


def test_gradient_and_score_against_brute_force():
    _, model, numbering = small_model(2)
    places, at, _ = lm_scoring.numbered(numbering, [[b"w1", b"w2", b"w3", b"w9"], [b"w30", b"w0", b"w0", b"unseen"], []])
    numbers = numbering.feature[places]
    log, cells = brute_model(model, numbers, at)
    assert model.log_probabilities(numbers, at).sum() == pytest.approx(log, rel=1e-5)
    sums = lm_scoring.Sums()
    for k in range(0, len(at), 2):
        sums.add(model, numbers, at[k : k + 2])
    row, observed, expected = sums.rows()
    got = {(int(r >= lm_scoring.CLASS_ROWS), int(r % lm_scoring.CLASS_ROWS if r < lm_scoring.CLASS_ROWS else r - lm_scoring.CLASS_ROWS), c): (o[c], e[c]) for r, o, e in zip(row, observed, expected, strict=True) for c in range(len(o))}
    assert set(got) == set(cells)
    assert all(got[x][0] == cells[x][0] and got[x][1] == pytest.approx(cells[x][1], abs=1e-5) for x in cells)
    # observed less expected is the slope of the log-likelihood
    for x in sorted(cells, key=lambda x: -abs(cells[x][0] - cells[x][1]))[:10]:
        table = (model.class_table, model.word_table)[x[0]]
        table[x[1], x[2]] += 0.01
        up = brute_model(model, numbers, at)[0]
        table[x[1], x[2]] -= 0.02
        down = brute_model(model, numbers, at)[0]
        table[x[1], x[2]] += 0.01
        assert (up - down) / 0.02 == pytest.approx(cells[x][0] - cells[x][1], abs=2e-3)


def test_language_model_does_not_depend_on_partitions(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(k, " ".join(f"{'ab'[k % 2]}{min(r.randrange(60), r.randrange(60))}" for _ in range(30))) for k in range(400)], "doc_id long, text string")
    one, many = ({x["doc_id"]: x["score"] for x in lm_scoring.score(docs.repartition(n, "doc_id")).collect()} for n in (1, 9))
    assert one == {k: pytest.approx(x, rel=1e-5) for k, x in many.items()}


def test_quality_classifier(spark):
    r = random.Random(5)
    good = [" ".join(r.choice(VOCABULARY) for _ in range(r.randrange(20, 200))).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:150]]
    texts = [*good, *bad, None, "", "x"]
    docs = spark.createDataFrame([*enumerate(texts), (0, good[0]), (None, good[1])], "doc_id long, text string").withColumn("quality", F.lit(0)).withColumn("x", F.lit(9))
    labels = spark.createDataFrame([*((k, int(k < 300)) for k in range(450)), (5, None), (9999, 1), (None, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7)
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
    held = [x["predicted"] == int(x["doc_id"] < 300) for x in got if x["held_out"] and x["doc_id"] < 450]
    assert np.mean(held) > 0.97
    assert {x["score"] for x in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_gaussian_one():
    r = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    x = [r.normal(size=(200, d)), r.normal(1, 2, size=(300, d))]
    found = {k: (float(len(x[k])), x[k].sum(0), x[k].T @ x[k]) for k in (0, 1)}
    quality_classifier.moments, old = (lambda _: found), quality_classifier.moments
    try:
        model = quality_classifier.fit(None, 0.0, 0.0)
    finally:
        quality_classifier.moments = old
    log = []
    for k in (0, 1):
        s = np.cov(x[k].T, bias=True)
        z = x[0] - x[k].mean(0)
        log.append(-0.5 * (z @ np.linalg.inv(s) * z).sum(1) - 0.5 * np.linalg.slogdet(s)[1] + np.log((len(x[k]) + 1) / 502))
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp((log[0] - log[1]) / quality_classifier.TEMPERATURE)))


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_contaminated_with_words_changed_or_left_out(spark, block_words):
    """Whatever brute force scores at half or more is found, if no words are put in."""
    r, texts, items = random.Random(41), [], [prose(n, 4000 + n) for n in (12, 20, 40)]
    for t in items:
        w = t.split()
        for rate in (0.1, 0.2, 0.3):
            for _ in range(25):
                at = set(r.sample(range(len(w)), round(rate * len(w))))
                out = [x if i not in at else f"new{i}" for i, x in enumerate(w) if i not in at or r.random() < 0.6]
                texts.append([*prose(20).split(), *out, *prose(20).split()])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    score = {(d, i): brute_align(t, items[i].split()) / (2 * len(items[i].split())) for d, t in enumerate(texts) for i in range(len(items))}
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.contaminated(docs, bench, block_words=block_words).collect()}
    assert got == {k: pytest.approx(x) for k, x in score.items() if x >= 0.5} and len(got) > 150


def test_stretches_keep_the_best_alignment():
    r = random.Random(43)
    for _ in range(300):
        item = np.array([r.randrange(8) for _ in range(r.randrange(3, 12))], dtype=np.uint64)
        doc = np.array([r.randrange(20) for _ in range(r.randrange(0, 80))], dtype=np.uint64)
        best, least = brute_align(doc.tolist(), item.tolist()), len(item)
        found = [decontamination.align(doc[a:b], item)[0] for a, b in decontamination.stretches(doc, item, least)]
        assert max(found, default=0) == best if best >= least else all(x < least for x in found)


def test_contaminated_in_a_long_text_of_many_hits(spark):
    items = [prose(30, 5000 + k) for k in range(20)]
    text = " ".join(items * 40) + " " + prose(50_000, 5100)
    docs = spark.createDataFrame([(0, text), (1, text), (2, prose(1000))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"], r["start"], r["n_words"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(d, k, 1.0, 30 * k, 30) for d in (0, 1) for k in range(20)}
