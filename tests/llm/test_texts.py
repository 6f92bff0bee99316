"""License scans, fingerprints, line dedup and SimHash against brute force."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import fingerprint, license_scan, line_dedup, neighbours, queries, simhash
from docspark.llm.common import UPPER

SCHEMA = "doc_id long, text string, size long, words string, row int, id string"
EDGES = [
    (1, None), (2, ""), (3, "   "), (4, "MIT License"), (4, "MIT License"), (None, "mit license mit LICENSE, apache-license"), (5, "word"), (6, "the gnu general public license and general public licence"),
    (7, "a b c"), (8, "é" * 50), (9, "x y " * 3000), (10, "l1\nl2\nl3\nl4"), (11, "l1\nl2\nl3"), (12, "\n\n\n\n"), (13, "q\nq\nq\nq\nq"),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(i, t, 1, "w", 2, "c") for i, t in EDGES], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return (t or "").translate(str.maketrans(UPPER, UPPER.lower()))


def test_license_places(edges, empty):
    rows = license_scan.scan_licenses(edges).collect()
    assert len(rows) == len(EDGES)
    got = Counter((r["doc_id"], r["n_words"], tuple((s["label"], s["first_word"]) for s in r["spans"] if s["exact"])) for r in rows)
    want = Counter()
    for i, t in EDGES:
        ws = [w for w in re.split(license_scan.NOT_WORD, ascii_lower(t)) if w]
        found = [(x.label, k) for k in range(len(ws)) for x in license_scan.BASE if ws[k : k + len(x.text.split())] == x.text.split()]
        want[i, len(ws), tuple(found)] += 1
    assert got == want
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_wordings(spark):
    mit = next(t for t in license_scan.WORDINGS if t.text.startswith("permission"))
    ws = mit.text.split()
    edited = ws[:9] + ["quite"] + ws[9:20] + ws[21:]  # one word more, one less
    texts = ["start " + " ".join(edited) + " end", "Licensed under the Apache License, Version 2.0.", "licensed under cc by-nc 4.0", "licensed under the gnu general public license version 3", " ".join(ws[:12])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in license_scan.scan_licenses(docs).collect()}
    assert found == {0: {"mit"}, 1: {"apache", "apache-2.0"}, 2: {"cc-by-nc"}, 3: {"gpl", "gpl-3.0"}, 4: set()}


def test_license_spans_follow_the_order_of_words(spark):
    rng = random.Random(3)
    apache = next(t for t in license_scan.WORDINGS if t.text.startswith("unless"))
    ws, texts, want = apache.text.split(), [], []
    for k in range(60):
        edited, edits = list(ws), k % 5
        for place in sorted(rng.sample(range(2, len(ws) - 3, 5), edits), reverse=True):
            kind = rng.choice(["insert", "lose", "change"])
            edited[place : place + (kind != "insert")] = [] if kind == "lose" else ["other"]
        before = [f"w{j}" for j in range(rng.randrange(5))]
        texts.append(" ".join(before + edited + ["after"]))
        want.append((len(before), len(before) + len(edited) - 1))
    shuffled = ws[16:] + ws[:16]
    turned = [w for a, b in zip(ws[1::2], ws[::2], strict=False) for w in (a, b)]
    texts += [" ".join(turned), " ".join(ws[::-1]), " ".join(ws + ["x"] * 9 + ws), " ".join(shuffled)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [s for s in r["spans"] if s["label"] == "apache-2.0"] for r in license_scan.scan_licenses(docs).collect()}
    for k, (a, b) in enumerate(want):
        assert [(s["first_word"], s["last_word"]) for s in found[k]] == [(a, b)], (k, texts[k])
        assert found[k][0]["share"] == 1 if k % 5 == 0 else 0.8 <= found[k][0]["share"] < 1
    assert not found[60] and not found[61] and [s["share"] for s in found[62]] == [1.0, 1.0] and not found[63]


def test_a_text_of_hits_only_takes_time_in_proportion(spark):
    license_scan.scan_licenses(spark.createDataFrame([(0, "mit license")], "doc_id long, text string")).collect()
    for unit, n in (("mit license ", 87_000), ("the software of the software to deal in the software in all copies or ", 15_000)):
        began = time.time()
        row = license_scan.scan_licenses(spark.createDataFrame([(1, unit * n)], "doc_id long, text string")).selectExpr("size(filter(spans, s -> s.exact)) as n").collect()[0]
        assert row["n"] == (n if unit.startswith("mit") else 0) and time.time() - began < 20


def test_fingerprint_estimates_generalised_jaccard(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    pairs = []
    for k in range(12):
        a = [rng.choice(words) for _ in range(200)]
        b = a[: 15 * k] + [rng.choice(words) + "x" for _ in range(200 - 15 * k)]
        pairs.append((a, b))
    docs = spark.createDataFrame([(2 * k + j, " ".join(p[j])) for k, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    made = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(docs, samples=1024, width=1).collect()}
    for k, (a, b) in enumerate(pairs):
        x, y = Counter(a), Counter(b)
        weight = lambda n: 1 + math.log(n) if n else 0
        true = sum(min(weight(x[t]), weight(y[t])) for t in x | y) / sum(max(weight(x[t]), weight(y[t])) for t in x | y)
        f, g = made[2 * k], made[2 * k + 1]
        near = sum(f[i : i + 4] == g[i : i + 4] for i in range(0, len(f), 4)) / 1024
        assert abs(near - true) < 0.07, (k, near, true)


def test_likeness_and_empty_fingerprints(spark, edges, empty):
    rows = spark.createDataFrame([("abcd0001", "abcd0002"), ("", ""), ("", "abcd0001"), ("abcd0001", "abcd0001")], "a string, b string")
    assert [r["l"] for r in rows.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("l")).collect()] == [0.5, 1.0, 0.0, 1.0]
    made = fingerprint.fingerprint_documents(edges).collect()
    assert {r["fingerprint"] for r in made if r["doc_id"] in (1, 2, 3)} == {""} and len(made) == len(EDGES)
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_next_rows_and_edited_texts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None if i % 17 == 0 else "".join(rng.choice("abé ") for _ in range(rng.randint(0, 30)))) for i in rng.sample(range(10**6), 300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    import hashlib

    assert len(got) == 300
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % 300][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        f, g = got[i]["fingerprint"], got[order[(k + 1) % 300][0]]["fingerprint"]
        near = float(f == g) if not f or not g else sum(f[j : j + 4] == g[j : j + 4] for j in range(0, 256, 4)) / 64
        assert got[i]["near_next"] == near


def test_next_rows_of_tiny_tables(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(5, "abc def")]), ("null", [(None, "a b"), (3, "c d e f")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert queries.op2_fingerprint(spark, f"{tmp_path}/{name}").count() == len(rows)
    df = spark.createDataFrame([(k,) for k in range(50)], "doc_id long")
    assert neighbours.with_ranges(df, "doc_id")[0].where("not _after").count() == 50


def brute_lines(rows):
    places = {}
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        for k in range(len(ls) - 2):
            w = "\n".join(ls[k : k + 3])
            if w.strip():
                places.setdefault(w, set()).add((i is None, i or 0, k))
    first = {w: min(p) for w, p in places.items()}
    out = []
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        gone = {k + j for k in range(len(ls) - 2) if "\n".join(ls[k : k + 3]).strip() and first["\n".join(ls[k : k + 3])] != (i is None, i or 0, k) for j in range(3)}
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone)))
    return out


def test_line_dedup(spark, edges, empty):
    rng = random.Random(1)
    rows = list(EDGES) + [(100 + i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "w", 2, "c") for i, t in rows], SCHEMA)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines_before", "lines_removed"]
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == Counter(brute_lines(rows))
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_fingerprint(t, width=3):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(t)) if w]
    runs = [" ".join(ws[k : k + width]) for k in range(len(ws) - width + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2 and label[a] != label[b]:
                x, y = label[a], label[b]
                label = [x if z == y else z for z in label]
    return [min((i for i, z in zip(ids, label, strict=True) if z == k and i is not None), default=None) for k in label]


def test_simhash_against_brute_force(spark, sf_dir, edges, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + EDGES
    made = simhash.simhash_classes(docs.union(edges.select("doc_id", "text"))).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], prints, brute_components(prints, [i for i, _ in rows]), strict=True))
    assert Counter((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in made) == want
    assert simhash.simhash_classes(empty).count() == 0


def test_compared_finds_every_link():
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 8)
    f = np.array([b ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(40)])
    group = np.repeat(np.arange(4), 80)
    label = simhash.compared(np.unpackbits(f.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), group)
    for a in range(len(f)):
        for b in range(a):
            if group[a] == group[b] and bin((int(f[a]) ^ int(f[b])) & (2**64 - 1)).count("1") <= 2:
                assert label[a] == label[b]
    for a in range(len(f)):
        assert group[label[a]] == group[a]


def test_large_files_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    prints = sorted({(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(0, a, 3)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(prints, prints)
    assert all(roots.get(p, p) == w for p, w in zip(prints, want, strict=True))


def test_the_driver_sends_sizes_of_large_files_only_and_no_round_of_components(spark, monkeypatch):
    """Near copies in files of several blocks, in files of one block and alone: the same classes, while what is broadcast is a row for a block's worth of filed rows at most."""
    monkeypatch.setattr(simhash, "BLOCK", 30)
    sent, plans, broadcast, cut = [], [], simhash.F.broadcast, simhash.cut
    monkeypatch.setattr(simhash.F, "broadcast", lambda df: sent.append(df) or broadcast(df))

    def watched(df):
        made = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made

    nodes = [(7, [7, 1]), (8, [7, 2]), (9, [9])] + [(100 + k, [11, 1000 + k % 2]) for k in range(64)]
    rows = [(n, (0 if n < 10 else -1 << 20) ^ (n & 1), f) for n, files in nodes for f in files]
    filed = spark.createDataFrame(rows, "node long, bits long, file long")
    unpacked = lambda column: np.unpackbits(column.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = simhash.stars(cut(filed), unpacked, 2, few=True)
    monkeypatch.setattr(simhash, "cut", watched)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {7: 7, 8: 7} | dict.fromkeys(range(100, 164), 100)
    assert [df.count() for df in sent] == [3] and 3 * 30 <= len(rows)
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans[1:])


def test_one_document_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (9, "other words " * 20), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.drop_near_duplicates(docs, width=5).collect()) == [(False, 1), (False, 9), (True, 0)]


def test_similar_texts_are_found(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(60):
        ws = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for c in range(4):
            copy = list(ws)
            for _ in range(0 if c == 0 else rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((4 * g + c, " ".join(copy)))
            group[4 * g + c] = 4 * g
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    near = {i: len(shingles[i] & shingles[g]) / len(shingles[i] | shingles[g]) for i, g in group.items()}
    made = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(made[i] in (i, group[i]) or made[i] // 4 == i // 4 for i in made)
    sure = [i for i in group if near[i] >= 0.85]
    assert len(sure) > 150 and sum(made[i] == group[i] for i in sure) >= 0.98 * len(sure)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.similar_classes(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def jaccard(a, b, width=5):
    x, y = ({tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_texts_below_the_similarity_are_no_class(spark):
    rng, rows = random.Random(4), []
    for g in range(300):
        ws = [f"g{g}w{rng.randrange(9000)}" for _ in range(10 if g % 2 else 150)]
        other = [*ws[:-1], "edit"] if g % 2 else ["edit" if k % 30 == 9 else w for k, w in enumerate(ws)]
        rows += [(2 * g, " ".join(ws)), (2 * g + 1, " ".join(other))]
    assert all(0.65 < jaccard(a[1], b[1]) < 0.8 for a, b in zip(rows[::2], rows[1::2], strict=True))
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None), (901, " "), (902, "a b c d e f")], "doc_id long, text string")
    made = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
    assert made == {i: i for i, _ in rows} | {None: 0, 900: 900, 901: 900, 902: 902}
    assert simhash.drop_near_duplicates(docs).count() == 603


def test_links_across_verified_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY", 4)
    ws = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(ws[:i] + ["edit"] + ws[i:])) for i in range(40)]
    assert {r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


@pytest.mark.parametrize(("shingles", "shared"), [((4, 5), 4), ((9, 9), 8), ((54, 54), 48), ((288, 288), 256)])
def test_lone_pairs_at_the_similarity_are_found(spark, shingles, shared):
    pairs, rows = 1500, []
    for g in range(pairs):  # a common beginning of shared + 4 words; the rest of each text is its own
        for c, n in enumerate(shingles):
            rows.append((2 * g + c, " ".join([f"g{g}s{k}" for k in range(shared + 4)] + [f"g{g}c{c}k{k}" for k in range(n - shared)])))
    assert jaccard(rows[0][1], rows[1][1]) == pytest.approx(0.8)
    made = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    found = made.where("component_id = doc_id - 1 and doc_id % 2 = 1").count()
    print("found", shingles, found / pairs)
    assert found >= 0.99 * pairs and made.where("component_id < doc_id - 1").count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as starts", "6 as later_id", "7 as row", "8 as lines_before", "9 as `a.b`", "10 as _later_id")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "starts", "later_id", "row", "a.b", "_later_id", "lines_before", "lines_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb\nc", 5, 6, 7, 9, 10, 3, 0), (2, "d", 5, 6, 7, 9, 10, 4, 3)]


def test_lines_of_documents_without_an_id_of_their_own(spark):
    same = "a\nb\nc"
    rows = [(None, f"{same}\nx{k}\ny{k}\nz{k}") for k in range(5)] + [(None, f"u{k}\nv{k}\nw{k}") for k in range(5)] + [(None, "only"), (7, f"{same}\nlong\nlonger"), (7, "p\nq\nr"), (7, None), (8, "p\nq\nr\ns")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, f"x{k}\ny{k}\nz{k}", 6, 3) for k in range(5)] + [(None, f"u{k}\nv{k}\nw{k}", 3, 0) for k in range(5)] + [(None, "only", 1, 0), (7, rows[11][1], 5, 0), (7, "p\nq\nr", 3, 0), (7, None, 0, 0), (8, "s", 4, 3)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_a_heap_of_near_copies_and_a_chain_away_from_it(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY", 8)
    rng = np.random.default_rng(2)
    heap = np.sort(rng.integers(0, 2**60, 60))
    rows, sets = [], {}
    for i in range(70):  # most differ from the heap in one hash, the others form a chain away from it
        own = heap.copy()
        own[: 1 if i < 50 else min(3 * (i - 49), 50)] = rng.integers(2**61, 2**62, 1 if i < 50 else min(3 * (i - 49), 50))
        sets[i] = set(own.tolist())
        rows.append((i, 7, bytes(8), sorted(own.tolist())))
    members = spark.createDataFrame(rows + [(100, 9, bytes(8), [1, 2, 3, 4, 5]), (101, 9, bytes(8), [1, 2, 3, 4, 5])], "node long, root long, bits binary, hashes array<long>")
    found = {(r["a"], r["b"]) for r in simhash.verified(members, 0.8, 3).collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(like(a, b) for a, b in found if a < 100) and (100, 101) in found
    root = list(range(70))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        if a < 100:
            root[find(a)] = find(b)
    got = {tuple(sorted(i for i in range(70) if find(i) == find(k))) for k in range(70)}
    root = list(range(70))
    for a in range(70):
        for b in range(a):
            if like(a, b):
                root[find(a)] = find(b)
    assert got == {tuple(sorted(i for i in range(70) if find(i) == find(k))) for k in range(70)} and len(got) > 1
