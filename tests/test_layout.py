"""Captions by the boxes of words, against a plain search; reading order, titles and authors from boxes."""

import random
import re

import pytest

from docspark.operators import layout


def plain(text):
    return [w for w in re.split(r"\s+", re.sub(r"[*|]", " ", text or "").lower()) if w]


def brute(captions, words):
    out = {}
    for cid, doc, want, caption, number, keywords in captions:
        pages = {}
        for d, page, idx, text, *box in words:
            if d == doc:
                pages.setdefault(page, {})[idx] = ("".join(plain(text)), box)
        whole = " ".join(plain(caption))
        needles = [plain(caption), plain(whole[:12]) if len(whole) > 12 else [], ["table", str(number)] if number is not None else [], ["tab.", str(number)] if number is not None else []]
        for page in sorted(pages, key=lambda p: ({0: 0, -1: 1, 1: 2}.get(p - want, 3), p)):
            own, hit = pages[page], None
            for rule, ws in enumerate(needles):
                for start in sorted(own) if ws else ():
                    here = [own.get(start + k, ("\0",))[0] for k in range(len(ws))]
                    if here[:-1] == ws[:-1] and here[-1].startswith(ws[-1]):
                        hit = (rule, [own[start + k][1] for k in range(len(ws))])
                        break
                if hit:
                    break
            if not hit:
                keys = [k for k in (re.sub(r"[*|]", "", k).strip().lower() for k in keywords or []) if len(k) >= 3]
                boxes = [b for w, b in own.values() if any(k in w for k in keys)]
                hit = (4, boxes) if len(boxes) >= 2 else None
            if hit:
                xs = list(zip(*hit[1], strict=True))
                out[cid] = (page, hit[0], min(xs[0]), min(xs[1]), max(xs[2]), max(xs[3]))
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_captions_are_found_by_their_words(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["table", "Tab.", "1", "2:", "the", "result", "of", "Results", "**bold**", "|", "été", "measure", "measured", "a"]
    words, captions = [], []
    for doc in range(6):
        for page in range(1, 5):
            for idx in range(rng.choice([0, 1, 40])):
                x, y = rng.randrange(100), rng.randrange(100)
                words.append((doc, page, idx, rng.choice(vocabulary), float(x), float(y), float(x + 9), float(y + 5)))
    for cid in range(60):
        doc = rng.randrange(7)
        own = [w for w in words if w[0] == doc]
        at = rng.randrange(len(own)) if own else 0
        quoted = " ".join(w[3] for w in own[at : at + rng.choice([1, 2, 4])])
        caption = rng.choice([quoted, quoted + " zzz", "zzz", "", None, "the result of measure and more"])
        captions.append((cid, doc, rng.randrange(1, 5), caption, rng.choice([None, 1, 2, 9]), rng.choice([None, [], ["meas"], ["été", "a"], ["res*ult", "zzz"]])))
    got = layout.locate_caption_words(
        spark.createDataFrame(captions, "caption_id long, doc_id long, page long, caption string, number int, keywords array<string>"),
        spark.createDataFrame(words, "doc_id long, page long, word_idx int, text string, x0 double, y0 double, x1 double, y1 double").repartition(3),
    ).collect()
    assert {r["caption_id"]: tuple(r)[1:] for r in got} == brute(captions, words) and len(got) > 10


def test_reading_order_by_cuts():
    # A title over two columns of two paragraphs each, and a foot line.
    boxes = [(55, 60, 100, 80), (0, 0, 100, 10), (0, 20, 45, 50), (55, 20, 100, 55), (0, 55, 45, 80), (0, 90, 100, 95)]
    assert layout.cut_order(boxes) == [1, 2, 4, 3, 0, 5]
    assert layout.cut_order([]) == [] and layout.cut_order([(0, 0, 1, 1)] * 3) == [0, 1, 2]
    staggered = [(0, 0, 60, 30), (50, 20, 100, 60)]  # overlap both ways: by the top edge
    assert layout.cut_order(staggered) == [0, 1]


@pytest.fixture(scope="module")
def papers(spark):
    """One page each: pieces of text with their kind, at the places where they stand, and the file's own fields."""
    abstract = ("text", "**Abstract** We tell of it.")
    made = {
        1: ("My own title", "Ada Lovelace", [("title", "# Another title here"), abstract]),
        2: ("Paper Title (use style)", "IEEE", [("text", "Journal of things"), ("title", "## A title in a box"), ("text", "Jane Doe, John B. Smith and Mary Major1"), ("text", "University of Somewhere"), abstract, ("text", "Later Person wrote this")]),
        3: ("D:2020", None, [("section-header", "## Contents"), ("section-header", "**A header as a title**"), ("text", "**Max Muster** and **Eva Muster**, Max Muster"), ("text", "nothing")]),
        4: (None, "", [("text", "The first text box is long"), ("text", "no names here"), abstract]),
        5: (None, None, [("text", "Short"), ("picture", "x"), ("text", "A line of the text that is long enough")]),
        6: (None, None, [("text", "12.5")]),
    }
    docs, boxes, pages = [], [], []
    for doc, (title, author, parts) in made.items():
        at, text = 0, ""
        for k, (kind, raw) in enumerate(parts):
            boxes.append((doc, 1, len(parts) - k, kind, at, at + len(raw), 0.0, 20.0 * k, 100.0, 20.0 * k + 10))
            text += raw + "\n"
            at = len(text)
        pages.append((doc, 1, text))
        docs.append((doc, text, title, author))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, meta_title string, meta_author string"),
        spark.createDataFrame(boxes, "doc_id long, page int, box_idx int, kind string, pos_start int, pos_end int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(pages, "doc_id long, page int, text string"),
    )


def test_every_tier_of_titles_and_authors(papers):
    docs, boxes, pages = papers
    got = {r["doc_id"]: (r["title"], r["authors"], r["title_tier"]) for r in layout.titles_and_authors(docs, layout.reading_order(boxes), pages).collect()}
    assert got[1] == ("My own title", "Ada Lovelace", 0)
    assert got[2] == ("A title in a box", "Jane Doe; John B. Smith; Mary Major", 1)
    assert got[3] == ("A header as a title", "Max Muster; Eva Muster", 2)
    assert got[4][0] == "The first text box is long" and got[4][2] == 3 and got[4][1] is None
    assert got[5][0] == "A line of the text that is long enough" and got[5][2] == 4
    assert got[6] == (None, None, None)


def test_caption_words_of_rows_and_pages_by_brute_force(spark):
    """Pages of few different words, so that words of a caption meet very often; and no plan that joins word with word."""
    rnd = random.Random(11)
    pages = {(d, p): [rnd.choice(["aa", "ab", "Table", "tab.", "1", "**", "aab", "x|y"]) for _ in range(rnd.choice([1, 5, 40]))] for d in range(12) for p in range(4)}
    words = spark.createDataFrame([(d, p, i, w, i * 10.0, p * 1.0, i * 10.0 + 5, p + 1.0) for (d, p), ws in pages.items() for i, w in enumerate(ws)], "doc_id long, page long, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    asked = [(d, d, rnd.randrange(4), rnd.choice(["aa ab aa", "aa aa ab aa aab z", "zz", "", "**", None]), rnd.choice([None, 1, 2]), rnd.choice([[], ["aab", "xy"], ["aa"], None])) for d in range(12)]
    captions = spark.createDataFrame(asked, "caption_id long, doc_id long, page long, caption string, number int, keywords array<string>")
    plain = lambda c: c.lower().replace("*", " ").replace("|", " ").split()
    want = {}
    for c, d, page, text, number, keys in asked:
        whole = None if text is None else plain(text)
        kinds = [whole, plain(text[:12]) if text is not None and len(" ".join(whole)) > 12 else None, ["table", str(number)] if number else None, ["tab.", str(number)] if number else None]
        for p in sorted(range(4), key=lambda p: ({0: 0, -1: 1, 1: 2}.get(p - page, 3), p)):
            ws = ["".join(plain(w)) for w in pages[d, p]]
            starts = [(rule, i, i + len(k)) for rule, k in enumerate(kinds) if k for i in range(len(ws) - len(k) + 1) if ws[i : i + len(k) - 1] == k[:-1] and ws[i + len(k) - 1].startswith(k[-1])]
            held = [i for i, w in enumerate(ws) if any(len(k) >= 3 and k in w for k in keys or [])]
            if starts:
                rule, a, b = min(starts)
                want[c] = (p, rule, a * 10.0, (b - 1) * 10.0 + 5)
            elif len(held) >= 2:
                want[c] = (p, 4, held[0] * 10.0, held[-1] * 10.0 + 5)
            if c in want:
                break
    out = layout.locate_caption_words(captions, words)
    assert {r["caption_id"]: (r["page"], r["rule"], r["x0"], r["x1"]) for r in out.collect()} == want and len({w[1] for w in want.values()}) > 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
