"""Phrase collocations, ranked search and main texts of pages against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from repoquarry.llm import extraction, lexical, phrases

from .conftest import ODD


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collocations_by_hand(rows, least, longest, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lowered(text)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                of.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    result = []
    for lang, of in counts.items():
        often = {p: f for p, f in of.items() if f >= least}
        found = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if len(p) == 1 or any(len(q) > len(p) and f >= a and inside(q) for q, f in often.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(result)


@pytest.mark.parametrize("least,longest,top", [(3, 5, 2000), (2, 3, 7), (5, 2, 50)])
def test_collocations_equal_brute_force(spark, least, longest, top):
    draw = random.Random(4)
    words = ["New", "york", "city", "la", "der", "日本", "é", "a.b", "Über"]
    rows = []
    for i in range(300):
        text = " ".join(draw.choice(words) + draw.choice(["", "", "", ".", "\t", ",\n"]) for _ in range(draw.randrange(30)))
        rows.append((draw.choice(["en", "de", None]), draw.choice([text, text, "New York city hall is in new york CITY", None, ""])))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(docs, min_count=least, longest=longest, top=top).collect())
    assert found and found == collocations_by_hand(rows, least, longest, top)


def test_rare_phrases_are_not_sent_to_be_summed(spark, monkeypatch):
    """Of pairs that occur once, at most those that share a cell with others are sent whole; what is frequent is counted in full."""
    sent, summed = [], phrases._frequent
    monkeypatch.setattr(phrases, "_frequent", lambda entries, *a: sent.append(sum(r[0] for r in entries.select("size").collect())) or summed(entries, *a))
    names = [f"w{i}" for i in range(60)]
    rows = [("en", f"{a} {b}.") for a in names for b in names] + [("en", "new york.")] * 60
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = [tuple(r) for r in phrases.collocations(docs, min_count=50, longest=2).collect()]
    assert found == [("en", 1, "new york", 60, 60, 60, 7320, 1000 * 60 * 7320 // 3600)]
    assert 1 <= sent[0] < 60 * 60 / 8


def test_collocations_of_odd_documents(spark, odd, empty):
    found = sorted(tuple(r) for r in phrases.collocations(odd, min_count=2).collect())
    assert found == collocations_by_hand([("en", t) for _, t in ODD], 2, 5, 2000)
    assert phrases.collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(["a", "b"], [4 * 10**12, 3 * 10**12], [5 * 10**12, 3 * 10**12], 3 * 10**12, 10**13)], "words array<string>, prefixes array<bigint>, suffixes array<bigint>, f bigint, n bigint")
    assert row.select(phrases._cuts(5).alias("c")).first().c.score == 1000 * 3 * 10**12 * 10**13 // (4 * 10**12 * 5 * 10**12)


def test_index_extends_both_ways():
    """Intervals of all phrases of up to five words: sizes, and places that begin with the phrase."""
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 5, 400).astype(np.int32)
    index = phrases.PhraseIndex(symbols, 5)
    text = index.symbols.tolist()
    found = index.words()
    for size in range(1, 6):
        want = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
        want = {p: f for p, f in want.items() if 0 not in p}
        places, node = index.places(found)
        seen = {}
        for place, n in zip(places.tolist(), node.tolist(), strict=True):
            seen.setdefault(n, set()).add(tuple(text[place : place + size]))
        assert all(len(p) == 1 for p in seen.values())
        assert {p.pop(): found.size[n] for n, p in seen.items()} == want
        found, _ = index.extend_right(found)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(docs, items, k):
    terms = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    held = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    result = []
    for item, text in items:
        asked = Counter(TERM.findall(lowered(text)))
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        result += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(result, key=str)


@pytest.mark.parametrize("shard_bytes", [2_000, 50_000_000])
def test_search_equals_brute_force(spark, shard_bytes):
    draw = random.Random(8)
    words = [f"w{int(draw.paretovariate(0.6))}" for _ in range(300)] + ["Ärger", "x_y", "日本"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 60)))) for i in range(1_500)]
    docs += [(2_000 + i, docs[7][1]) for i in range(30)] + [(None, docs[3][1]), (5_000, None), (5_001, ""), (5_002, "... !")]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 25)))) for i in range(40)] + [(100, None), (101, "nowhere"), (102, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    asked = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    index = lexical.build_index(frame, shard_bytes=shard_bytes)
    found = [tuple(r) for r in lexical.search(index, asked).collect()]
    assert sorted(found, key=str) == ranked_by_hand(docs, items, 10)


def test_block_maxima_spare_decompression():
    """Rare words come in the first documents; then blocks of a frequent word cannot lift a document any more."""
    texts = [f"rare rare rare common{' x' * (i % 7)}" if i < 40 else f"common{' y' * (20 + i % 50)}{' rare' if i % 97 == 0 else ''}" for i in range(30_000)]
    ids = pa.array(range(len(texts)), pa.int64())
    n_terms = sum(len(t.split()) for t in texts)
    rows = lexical._shard_rows(0, ids, pa.array(texts).cast(pa.binary()), len(texts), n_terms).to_pylist()
    lists = {r["term"]: lexical.Postings(r["n_docs"], np.array(r["last"]), np.array(r["top"]), r["blocks"]) for r in rows if r["term"]}
    shard = lexical.Shard(lists, np.array(rows[-1]["lengths"]), len(texts), n_terms)
    weights = {t: math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * lists[t].n_docs + 1))) for t in ("rare", "common")}
    docs, scores = shard.best(weights, 10)
    assert docs.tolist() == [i for i in range(0, 40, 7)] + [1, 8, 15, 22]
    assert (np.diff(scores) <= 0).all()
    assert lists["common"]._whole is None or shard.decompressed < sum(len(held.blocks) for held in lists.values()) / 2


def test_search_of_odd_documents(spark, odd, empty):
    asked = spark.createDataFrame([(1, "The same LINE here"), (2, "日本語 é"), (None, "w5")], "item_id bigint, text string")
    found = [tuple(r) for r in lexical.search(lexical.build_index(odd), asked, k=20).collect()]
    assert sorted(found, key=str) == ranked_by_hand(ODD, [(1, "The same LINE here"), (2, "日本語 é"), (None, "w5")], 20)
    assert lexical.search(lexical.build_index(empty), asked).collect() == []
    assert lexical.search(lexical.build_index(odd), asked.filter("false")).collect() == []


LONG = "This is a sentence of the story, and it goes on for quite a while. Then comes another one, with some more words in it."
PAGES = [
    # (html, blocks)
    (None, []),
    ("", []),
    ("   \n ", []),
    ("<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav></body></html>", []),
    (f"<title>T</title><script>var t='</p>';</script><article><h1>Head &amp; more</h1><p><b>{LONG}<br><p>Short.</p></article><footer>&copy; all</footer>", ["Head & more", LONG, "Short."]),
    (f"<BODY><DIV ID=menu>Menu</DIV><DIV CLASS='post-body'><P>{LONG}<P>x &lt; y &#8212; z\t\n q</DIV><DIV class=\"sidebar\"><p>{LONG}</div>", [LONG, "x < y — z q"]),
    (f"<main><p>{LONG}</p><aside>Read also</aside><form><label>Name</label><input></form><p>End.</p></main><section id='comments'><p>{LONG}</p></section>", [LONG, "End."]),
    (f"<div class='cookie-notice'>We use cookies. Accept them all.</div><div><p>{LONG}</p><p>{LONG} Again.</p></div><div><a href=a>One</a> <a href=b>Two</a></div>", [LONG, f"{LONG} Again."]),
    (f"<form id=aspnet><article><p>{LONG}</p></article></form><div style='display: none'>hidden text</div>", [LONG]),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p><ul><li>first point</li><li>second point</li></ul></article>", ["Title", LONG, "first point", "second point"]),
    (f"<div class='page has-sidebar'><article><p>{LONG}</p><div class=ad>Buy now!</div><p>More.</p><article class=comment><p>{LONG}</p></article></article></div>", [LONG, "More."]),
    (f"<article><p>{LONG}<!-- <p>no</p> --><p>a<b>b</b>c <i>d</i></p><p title='a>b'>tail", [LONG, "abc d", "tail"]),
    ("<article><p>a < b and <3", ["a < b and <3"]),
]


@pytest.mark.parametrize("page,blocks", PAGES)
def test_main_blocks(page, blocks):
    assert extraction.main_blocks(page or "", extraction.odds(extraction.STARTING_COUNTS)) == blocks


def test_extract_text(spark):
    rows = [(i, f"u{i}", page, "kept", "clash") for i, (page, _) in enumerate(PAGES)] + [(0, None, PAGES[4][0], None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, good string, Text string").repartition(3)
    counts = extraction.learn(pages)
    assert counts[("kind", "p")][0] > extraction.STARTING_COUNTS[("kind", "p")][0]
    found = extraction.extract_text(pages, counts)
    assert found.columns == ["page_id", "url", "html", "good", "text", "n_chars"]
    got = sorted((r.page_id, r.text, r.n_chars) for r in found.collect())
    want = [(i, "\n\n".join(blocks)) for i, (_, blocks) in enumerate(PAGES)] + [(0, "\n\n".join(PAGES[4][1]))] * 2
    assert got == sorted((i, text, len(text)) for i, text in want)
    assert extraction.extract_text(pages.filter("false")).collect() == []
    assert extraction.learn(pages.filter("false")) == extraction.STARTING_COUNTS


def test_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "<nav>" + "<p>Menu</p>" * 3_000 + "</nav></article>"
    assert extraction.main_blocks(page, extraction.odds(extraction.STARTING_COUNTS)) == [LONG] * 20_000


def test_cut_is_least():
    draw = random.Random(5)
    for _ in range(60):
        n = draw.randrange(1, 9)
        costs = [draw.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, draw.randrange(1, 6)) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.5]

        def price(side):
            apart = sum(w for a, b, w in edges if side[a] != side[b])
            return apart + sum(c for c, s in zip(costs, side, strict=True) if c > 0 and not s) - sum(c for c, s in zip(costs, side, strict=True) if c < 0 and s)

        least = min(price([bool(bits >> i & 1) for i in range(n)]) for bits in range(1 << n))
        assert price(extraction.source_side(costs, edges)) == least
