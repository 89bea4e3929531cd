"""Ranked search, fill-in-the-middle and main text, each against a version written from its definition."""

import hashlib

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import license_scan, toxicity
from quernel.llm import ranked_search as rs
from quernel.llm.fill_in_middle import CutText, fill_in_middle, restored
from quernel.llm.html_text import Page, extract_text, main_text
from test_llm import ODD, frame, wider

ITEMS = "item_id long, text string"
SF = "/root/testdata/sf0.001"


# --- ranked search


def brute_ranking(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = {}
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in words(text)}
        scores = []
        for doc_id, c, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, math.inf if doc_id is None else doc_id))
        out[item] = [(-s, None if d == math.inf else d) for s, d in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def ranking(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["rank"], r["score"], r["doc_id"]))
    assert all([rank for rank, _, _ in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {i: [(s, d) for _, s, d in rows] for i, rows in out.items()}


@pytest.mark.parametrize("shard,first,block", [(10**6, 256, 2_000_000), (300, 2, 2_000_000), (40, 1, 3_000)])
def test_ranking_matches_brute_force(spark, monkeypatch, shard, first, block):
    monkeypatch.setattr(rs, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(rs, "FIRST_READ", first)
    rng = random.Random(21)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 200])))) for k in range(-60, 90)]
    docs += [(200 + k, docs[k % 7][1]) for k in range(60)] + [(3, "w1 w2 W3, w3"), (3, "w1 w2 W3, w3"), (None, docs[0][1]), (999, None), (998, " ,.;"), (997, "x" * 50_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30])))) for k in range(40)] + [(50, None), (51, "..."), (52, "absent words"), (4, "w1 extra"), (None, "w5 W7")]
    got = ranking(rs.ranked_search(frame(spark, docs, "doc_id long, text string").repartition(3), frame(spark, items, ITEMS), k=20, block_bytes=block))
    assert got == brute_ranking(docs, items, 20)


def test_ranking_reads_no_more_than_it_needs():
    """A document with every rare term ends the reading before long lists are through."""
    rng = np.random.default_rng(5)
    n = 50_000
    terms = np.concatenate([np.zeros(n, np.int32), np.array([1, 1, 2, 2], np.int32)])
    place = np.concatenate([np.arange(n), [7, 9, 7, 9]])
    order = np.argsort(place, kind="stable")
    tfs = np.where(terms[order] == 0, rng.integers(1, 3, len(order)), 1).astype(np.int32)
    tfs[np.isin(place[order], [7, 9]) & (terms[order] == 0)] = 50
    lists = rs.Lists(np.arange(n), np.full(n, 100), np.bincount(place, minlength=n), terms[order], tfs, np.array([10, 9000, 9000]))
    reads = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return np.asarray(self)[key]

    lists.place = lists.place.view(Seen)
    got, scores = lists.best(np.array([0, 1, 2]), 2, 1)
    assert got.tolist() == [7, 9] and scores[0] == scores[1] and sum(reads) < 1000


def test_ranking_of_odd_rows(spark):
    docs, none = wider(frame(spark, ODD)), frame(spark, [], ITEMS)
    items = frame(spark, [(1, "a row without an id"), (2, "naïve WORD"), (3, None)], ITEMS).withColumn("term", F.lit("mine"))
    rows = [(r[0], r[1]) for r in ODD]
    assert ranking(rs.ranked_search(docs, items)) == brute_ranking(rows, [(1, "a row without an id"), (2, "naïve WORD"), (3, None)], 50)
    assert rs.ranked_search(docs, none).collect() == [] == rs.ranked_search(docs.where("false"), items).collect()


# --- licence tags


def test_licence_fields_and_leads():
    automaton = license_scan.build_automaton()
    labels = lambda t: license_scan.scan(t, automaton)["labels"]
    assert labels("License: MIT") == labels("Licensed under the MIT.") == labels('{"license": "MIT"}') == labels("/** @license MIT */") == labels("the MIT licence") == "mit"
    assert labels("License-Expression: MIT OR Apache-2.0") == labels("SPDX-License-Identifier: MIT/Apache-2.0") == labels("licence = Apache-2.0/MIT") == "apache,mit"
    assert labels("License: see the file") == labels("a license of ours") == labels("licensed under water") == labels("license") == labels("released under") == ""
    found = license_scan.scan("Distributed under the terms of the GPL-2.0-or-later WITH Classpath-exception-2.0.", automaton)
    assert found["labels"] == "gpl" and found["score"] == 0.5 and found["base_labels"] == "" and found["n_base"] == 0
    base = license_scan.scan("MIT License and mit licence", automaton)
    assert (base["n_base"], base["first_word"], base["last_word"], base["base_labels"]) == (1, 0, 0, "mit")


def test_styled_letters_are_folded():
    assert toxicity.fold("𝗂𝖽𝗂𝗈𝗍 Ｉｄｉｏｔ 1d10t ⓘdiot") == b" idiot idiot idiot idiot "
    assert toxicity.fold("Straße été") == " straße été ".encode()


# --- fill-in-the-middle


def plain_fim(doc_id, text, unit=None):
    text = text or ""
    ends = [m.end() for m in re.finditer(unit, text)] if unit else list(range(1, len(text) + 1))
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(ends)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = (([0] + ends)[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("unit,block", [(None, 4096), (None, 3), (r"\S+\s*", 7), (r"\w+", 64)])
def test_fim_matches_its_definition(spark, unit, block):
    rng = random.Random(22)
    letters = "ab é☃\U0001f600 \n<SPM>"
    rows = [(k, "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 9, 300, 5000])))) for k in range(250)] + [(900, "<P"), (901, "<S<"), (902, "a<M>b"), (None, "no id"), (903, None), (904, "z" * 300_000)]
    out = fill_in_middle(frame(spark, rows, "doc_id long, text string"), unit=unit, block=block)
    got = out.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"], unit)
        assert r["again"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_every_unit():
    text = "é☃\U0001f600a\n" * 40
    for block in (1, 2, 5, 16, 1000):
        held = CutText(text, None, block)
        assert held.tree.total == len(text)
        assert all(held.cut(k) == (len(text[:k].encode()), k) for k in range(len(text) + 1))
        words = CutText(text, re.compile(r"\S+"), block)
        ends = [0] + [m.end() for m in re.finditer(r"\S+", text)]
        assert all(words.cut(k) == (len(text[: ends[k]].encode()), ends[k]) for k in range(len(ends)))


def test_fim_of_odd_rows(spark):
    docs = frame(spark, ODD).withColumn("n", F.lit("mine")).withColumn("output", F.lit("mine")).withColumn("form", F.lit("mine"))
    rows = fill_in_middle(docs).collect()
    assert len(rows) == len(ODD) and all(r["n"] == r["output"] == r["form"] == "mine" for r in rows)
    assert all(r["_output"] == plain_fim(r["doc_id"], r["text"])[4] for r in rows)
    assert fill_in_middle(docs.where("false")).collect() == []


# --- main text


PAGE = """<!DOCTYPE html><html><head><title>T, t</title><style>p{}</style><script>var a="<p>no, no</p>";</script></head><body class="has-sidebar">
<header><h1>Site, name</h1><form><label>Search, here</label><input name=q></form></header><nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav>
<div class="cookie-notice">We use cookies, and more, and more.</div><div id="wrap"><div class="ad-slot">Buy, buy, buy now.</div>
%s<aside><p>Elsewhere, some text, of a side.</p></aside></div>
<section id="comments"><h2>3 comments</h2><div class="comment"><p>I liked this, really, a lot, more than, the article, itself, I think.</p></div></section>
<footer>&copy; somebody, all rights</footer><!-- <p>a comment, of markup</p> --></body></html>"""
ARTICLE = "<h2>A &lt;title&gt;</h2><p>First, with <b>bold</b>,\n two&nbsp;spaces  and&#x2603;.<p>Second <a href=x>link</a> here.</p><ul><li>One<li>Two</ul><p>x.</p><table><tr><td>c1<td>c2</table><p>End, of it, all.</p>"
EXPECTED = "A <title>\nFirst, with bold, two spaces and☃.\nSecond link here.\nOne\nTwo\nx.\nc1\nc2\nEnd, of it, all."


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div>%s</div>", "<div role='main'><div>%s</div></div>", "<section>%s<script>x</script></section>", "<form id=f><div>%s</div></form>"])
def test_main_text(around):
    assert main_text(PAGE % (around % ARTICLE)) == EXPECTED


def test_main_text_of_parts():
    long = "<p>%s</p>" % "Some prose, that goes on, for a while, and then ends. " * 3
    assert main_text(f"<div><h1>Title</h1><div>{long}</div><div>{long}</div><div><a href=1>One</a> <a href=2>Two</a></div></div>").split("\n")[0] == "Title"
    assert main_text(f"<div>{long}</div>").count("\n") == 2
    assert main_text(f"<article>{long}<h3>Comments (2)</h3><p>So true, so very, very true.</p></article><p>After.</p>").count("\n") == 2
    assert main_text(f"<article>{long}<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></article>").count("\n") == 2
    assert main_text("just text &amp; more") == "just text & more"
    assert main_text("<article><p>Pa.</p></article><div>Some longer text, with commas, that is unmarked, and not the article, in a page.</div>") == "Pa."
    assert main_text("<nav>only a menu</nav>") == "" == main_text(None) == main_text("")
    assert main_text("<h1>Only a heading</h1>") == "Only a heading"
    assert main_text("<p>a<br>b<p title='x>y'>c &am d</p></div></td>") == "a b\nc &am d"
    assert main_text("<article><header class='post-header'><h1>Head</h1></header><p>Text, of it.</p><footer>by X</footer></article>") == "Head\nText, of it."


class Blocks(HTMLParser):
    """The blocks of a page whose markup is in order, by the standard library's parser."""

    def __init__(self, source):
        super().__init__()
        self.path, self.blocks, self.text = [], [], []
        self.feed(source)
        self.close()

    def end_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((tuple(self.path), text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "br", "meta"):
            self.end_block()
            while self.path and self.path[-1] == "p":
                self.path.pop()
            self.path.append(tag)
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.path:
            self.end_block()
            while self.path.pop() != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)


def test_main_text_of_the_given_pages(spark):
    rows = extract_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(rows) > 20
    for r in rows:
        expected = "\n".join(text for path, text in Blocks(r["html"]).blocks if "article" in path)
        assert r["text"] == expected and r["n_chars"] == len(expected)


def test_broken_pages_take_linear_time():
    for source in ("<div>" * 50_000 + "x", '<a "' * 50_000, "<!--" * 50_000, "<p class='" * 50_000, "</div>" * 50_000, "<ul><li>" * 30_000, "&" * 200_000, "<td>" * 50_000, "<table><tr><td>" * 20_000 + "</p>" * 20_000, "<script " * 50_000, "<title>" * 50_000, "<svg>" * 50_000, "<a>" * 50_000 + "x"):
        assert isinstance(main_text(source), str)
    page = Page("<div><p>a<p>b</div>")
    assert [t for _, t, _ in page.blocks] == ["a", "b"]


def test_main_text_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>t, x</p>"), (3, "<p>t, x</p>"), (None, "<b>y"), (4, "<p>word, and</p>" * 20_000)]
    pages = frame(spark, rows, "page_id long, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit("mine"))
    got = extract_text(pages).collect()
    assert sorted((str(r["page_id"]), r["_text"][:9], r["_n_chars"]) for r in got) == [("1", "", 0), ("2", "", 0), ("3", "t, x", 4), ("3", "t, x", 4), ("4", "word, and", 199_999), ("None", "y", 1)]
    assert all(r["text"] == r["n_chars"] == "mine" for r in got) and extract_text(pages.where("false")).collect() == []
