"""Vector codes, quality rules and the prefix trie against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docspark.llm import prefix_trie, quality_rules, queries, vector_codes

# --- vector codes ---

VECTORS = "vec_id long, embedding array<float>, label int, id string, x string, code string, error string"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """vec_id, code, error, label_error of the kept rows, and the digest of the codebooks, by whole scans in Python integers."""
    kept = [(i, [min(max(math.floor(4096 * np.float32(x).item()), -(2**27)), 2**27) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    by_label = defaultdict(int)
    for _, f, label in found:
        by_label[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label]) for i, f, label in found), digest


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS)


def coded(df, **kw):
    made = vector_codes.compress(df, **kw)
    return sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_errors(made.codes).collect()), made


@pytest.mark.parametrize("seed", range(2))
def test_codes_equal_whole_scans(spark, seed):
    rng = random.Random(seed)
    coarse = lambda: rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0])  # noqa: E731  (many ties)
    rows = [(k * 3, [coarse() if seed else rng.gauss(0, 1) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(rows[0][0], rows[0][1], 1)] * 40 + [(None, [0.1] * 16, None), (5, None, 1), (6, [None] * 16, 1), (7, [math.nan] + [0.0] * 15, 2), (8, [math.inf] * 16, 2), (9, [-math.inf] * 16, 2)]
    rows += [(-4, [1e30, -1e30] * 8, 3), (11, [0.5] * 9, 1), (12, [], 1)]
    want, digest = brute_codes(rows)
    got, made = coded(vectors(spark, rows).repartition(3))
    assert got == want
    assert made.sha256() == digest


def test_codes_of_few_vectors_and_of_none(spark):
    rows = [(3, [1.0] * 8, 1), (1, [2.0] * 8, 1)]
    assert coded(vectors(spark, rows))[0] == brute_codes(rows)[0]
    got, made = coded(vectors(spark, []))
    assert got == [] and made.sha256() == hashlib.sha256(b"").hexdigest()
    assert coded(vectors(spark, [(3, None, 1)]))[0] == []


def test_still_parts_meet_moved_entries_only(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made = vector_codes.compress(table)
    whole = table.count() * vector_codes.PARTS * vector_codes.ENTRIES
    assert made.compared[0] == whole and all(c <= whole for c in made.compared)
    # Two far clusters settle at once: then no entry moves and nothing is compared.
    two = [(k, [float(k % 2)] * 8, 0) for k in range(64)]
    settled = vector_codes.compress(vectors(spark, two), entries=2)
    assert settled.compared == [64 * 8 * 2] + [0] * 6


def test_nearest_after_any_move_equals_a_scan():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, book = rng.integers(-3, 4, (40, 2)), rng.integers(-3, 4, (6, 2))
        entry, distance, _ = vector_codes.nearest(x, book, np.ones(6, bool), None, None)
        moved = rng.random(6) < 0.4
        after = np.where(moved[:, None], rng.integers(-3, 4, (6, 2)), book)
        moved = (after != book).any(1)
        got = vector_codes.nearest(x, after, moved, entry, distance)
        d = ((x[:, None] - after) ** 2).sum(2)
        assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()
        assert got[2] <= 40 * 6


# --- quality rules ---


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k : k + 3])].append(k)
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    repeated = len({k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)})
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeated, failed


PROSE = "The committee met on a Tuesday and talked about the new bridge over the river."
JUNK = {
    "navigation": ["Home | About | Contact | News", "Start » Books » Old", "menu", "Read more"],
    "boilerplate": ["All rights reserved.", "We use cookies to make this site better.", "PRIVACY POLICY"],
    "punctuation": ["Buy### now$$$ and*** save%%% big&&&", "BUY!! NOW!! CHEAP!!", "a line of several words without any end", "word word word word word word"],
}
FINE = [PROSE, "A heading", "He said: \"Stop!\"", "One ended. another goes on without", "100 % of it.", "", "  \t "]


def judged(spark, texts, **kw):
    docs = spark.createDataFrame([(k, t, 1, "x", 0.5, "c") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, cleaned string, lost double, _id string")
    return quality_rules.clean_documents(docs, **kw).orderBy("doc_id").collect()


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(3)
    piece = lambda: rng.choice(["a", "b", "é", "#x", "a|b", " ", " ", "\x1c", "<p>", "日本"])
    texts = [None, "", " ", "\n\n", "a a a", "a a a a", "a b c a b", "\r\nx\r\nx\r\n", "same line.\n" * 60, PROSE]
    texts += ["".join(piece() + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r"]) for _ in range(rng.choice([3, 30, 60, 400]))) for _ in range(60)]
    texts += [" ".join(f"w{k}" for k in range(60_000)) + " " + " ".join(f"w{k}" for k in range(100))]
    for text, r in zip(texts, judged(spark, texts, with_text=False), strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(text), text


def test_lines_fail_the_rule_that_they_break(spark):
    for rule, lines in JUNK.items():
        for line, r in zip(lines, judged(spark, lines), strict=True):
            assert {x: r[f"{x}_lines"] for x in quality_rules.RULES} == {x: int(x == rule) for x in quality_rules.RULES}, line
            assert r["cleaned"] == ""
    for line, r in zip(FINE, judged(spark, FINE), strict=True):
        assert not any(r[f"{x}_lines"] for x in quality_rules.RULES) and r["cleaned"] == line, line


def test_documents_go_by_what_their_lines_lose(spark):
    prose = "\n".join(" ".join(f"word{k}x{j}" for j in range(9)) + "." for k in range(12))
    some = prose + "\n" + "\n".join(JUNK["boilerplate"])
    much = prose + "\n" + "\n".join(f"junk{k}### more{k}*** and{k}$$$ such{k}%%% stuff{k}&&&" for k in range(12))
    kept = judged(spark, [prose, some, much, None, "", PROSE, some])
    assert [r["kept"] for r in kept] == [True, True, False, False, False, False, True]
    assert [r["base_failed"] for r in kept] == [False, False, False, True, True, True, False]
    assert kept[1]["cleaned"] == prose == kept[0]["cleaned"] and kept[3]["cleaned"] is None and kept[3]["n_lines"] == 0
    assert judged(spark, [much], max_lost=0.9)[0]["kept"]
    assert judged(spark, []) == []


def test_labels_agree_with_the_verdict(spark):
    folder = "/root/testdata/sf0.01"
    kept = queries.op12_quality_rules(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    counts = {(r["quality"], r["kept"]): r["count"] for r in kept.where("n_words >= 50").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) <= 0.05 * counts[0, False]


# --- prefix trie ---


def brute_rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn, role or "", text or ""))
    for c in by:
        by[c].sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()[:32]))
    out = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple((r, t) for _, r, t in by.get(c - int(math.fmod(c, 5)), [])[:h] + by[c][h:])
    return out


def brute_nodes(rebuilt):
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(node))
        children = sum(len(n) == len(node) + 1 for n in below)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "d") for r in rows], "conv_id long, turn long, role string, text string, id int, path string, depth string")


def nodes(df, **kw):
    return sorted(map(tuple, prefix_trie.trie_nodes(prefix_trie.rebuilt_paths(df), **kw).collect()), key=str)


def some_talks(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 4 * n), n):
        for k in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, k if rng.random() < 0.95 else rng.choice([None, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é", None, "", "long text " * 3])))
    rows += [(1000 + 5 * c, k, "user", f"copy {k}") for c in range(60) for k in range(3)]  # one large group of copies
    rows += [(3000, k, "user", "deep") for k in range(60)] + [(3005, k, "user", "deep") for k in range(50)]
    return rows + [(None, 0, "user", "no id"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "shards", "chunk"), [(0, 1, 4096), (1, 7, 4096), (2, 40, 4096), (3, 90, 5)])
def test_nodes_equal_brute_force_for_any_shards(spark, monkeypatch, seed, shards, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = some_talks(seed)
    rebuilt = brute_rebuilt(rows)
    got = prefix_trie.rebuilt_paths(talks(spark, rows)).collect()
    assert {r["id"]: (len(r["path"]) // 16, r["sizes"]) for r in got} == {c: (len(p), [len(t.encode()) for _, t in p]) for c, p in rebuilt.items()}
    assert nodes(talks(spark, rows).repartition(3), least_shards=shards, shard_bytes=1 << 30) == brute_nodes(rebuilt)


def test_a_group_of_copies_is_dealt_over_shards(spark):
    paths = spark.range(4000).select("id", F.unhex(F.lit("ab" * 16)).alias("path"), F.array(F.lit(7)).alias("sizes"))
    skeleton = prefix_trie.Skeleton.of(prefix_trie.splitters_of(paths, shards=8, total=4000 * 48))
    counts = [r["count"] for r in prefix_trie.sharded(paths, skeleton).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) <= 520
    ends = hashlib.sha256(",".join(map(str, range(4000))).encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    got = sorted(map(tuple, prefix_trie.trie_nodes(paths, least_shards=8).collect()), key=str)
    assert got == [(0, 0, None, 4000, 1, 1, 3999 * 7, none), (0, 1, 0, 4000, 0, 1, 3999 * 7, ends)]


def test_a_small_sample_changes_no_row(spark):
    rows = some_talks(5, n=60)
    assert nodes(talks(spark, rows), least_shards=12, sample_bytes=2000) == brute_nodes(brute_rebuilt(rows))


def test_conversations_that_lose_all_turns_end_at_the_root(spark):
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert nodes(talks(spark, [(c, 0, "user", "a"), (c, 1, "user", "b")])) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert nodes(talks(spark, [])) == [] == nodes(talks(spark, [(None, 1, "user", "x")]))


def test_role_and_text_are_kept_apart(spark):
    rows = [Row(role="ab", text="c"), Row(role="a", text="bc"), Row(role=None, text="abc"), Row(role="", text="abc"), Row(role="1:", text="x"), Row(role="", text="1:x")]
    keys = [r[0] for r in spark.createDataFrame(rows, "role string, text string").select(prefix_trie.turn_key(F.col("role"), F.col("text"))).collect()]
    assert len(set(keys)) == 5 and keys[2] == keys[3]
