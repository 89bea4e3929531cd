"""Each operator against a brute-force version, and on the cases every operator must bear."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import chat, decontamination, fingerprint, license_scan, near_dedup, packing, quality, substring_dedup, toxicity, url_filter
from quernel.llm._shared import connected_components
from quernel.llm.labels import in_fold
from quernel.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (None, "a row without an id, but with words.", None, None, None),
    (None, None, None, None, None), (4, "same text in two rows of one id", "en", "a", 1), (4, "same text in two rows of one id", "en", "a", 1), (4, "other text of this id", "en", "a", 1),
    (5, "x " * 60_000, "en", "b", 120_000), (6, "word", "en", "b", 4), (7, "Straße №5 — naïve ☃ \U0001f600", "de", "c", 9),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def wider(df):
    """Extra columns with names that operators might use themselves."""
    for name in ("th", "v", "n", "spans", "score", "row", "bin", "range", "host", "own", "kept"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


OPERATORS = {
    "licences": license_scan.scan_licenses,
    "packing": packing.pack,
    "near": near_dedup.near_duplicates,
    "near_drop": near_dedup.drop_near_duplicates,
    "substrings": substring_dedup.remove_repeats,
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Lexicon({" idiot": 5.0}, [], -3.0, (1.0, 1.0, 1.0))),
    "toxicity_drop": lambda d: toxicity.drop_toxic(d, toxicity.Lexicon({" idiot": 5.0}, [], -3.0, (1.0, 1.0, 1.0))),
    "fingerprints": fingerprint.fingerprints,
    "anchors": fingerprint.anchors,
    "next": fingerprint.compare_with_next,
    "contamination": lambda d: decontamination.contamination(d, d.sparkSession.createDataFrame([(1, "a row without an id"), (None, "word"), (3, None)], "item_id long, text string")),
    "contamination_drop": lambda d: decontamination.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "a row without an id"), (3, None)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    operator = OPERATORS[name]
    odd = operator(wider(frame(spark, ODD))).collect()
    empty = operator(wider(frame(spark, []))).collect()
    assert empty == []
    if name in ("licences", "near", "substrings", "toxicity", "fingerprints", "next", "contamination"):
        assert len(odd) == len(ODD)
        assert sorted(str(r["doc_id"]) for r in odd) == sorted(str(r[0]) for r in ODD)
    if name == "near":
        flags = {(r["doc_id"], r["th"]): r for r in odd}
        assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in flags.values() if r["doc_id"] in (1, 2, 3, 6))
    if name == "near_drop":
        assert len(odd) == len(ODD) - 1  # of rows equal in id and text one stays
    if name == "contamination_drop":
        assert {r["doc_id"] for r in odd} >= {1, 2, 3, 4, 5, 6, 7}


def test_url_rules(spark):
    urls = [
        "https://www.EXAMPLE.com/en/a?x=/fr/", "http://example.com/en/", "http://a.b.example.com/en/x#f", "http://example.com/fr/", "http://other.net/es/1", "http://x.net/fr", "http://x.net/fr/",
        "http://notexample.com/en/", "http://com/", "http://a.com", "mailto:x", "", None, "://", "http://ads-track.example.org/z", "http://x.org/", "http://x.net?q=/es/", "ftp://net/es/y",
    ]
    pages = frame(spark, [(k, u, "h") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, html string")
    blocked = ("ads-track.example.org/",)
    got = {r["page_id"]: r for r in url_filter.judge_urls(wider(pages), URL_RULES, blocked=blocked).collect()}
    assert len(got) == len(urls) + 1
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == (URL_RULES[rule] if rule else "block" if host == "ads-track.example.org" else "allow")
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"h{k}.example/" for k in range(5000)]
    listed = keys[::37]
    cascade = url_filter.build_cascade(spark.createDataFrame([(k,) for k in keys], "key string"), listed)
    assert len(cascade.levels) > 1
    assert cascade.holds(keys).tolist() == [k in set(listed) for k in keys]


def test_licence_expressions():
    ev = lambda s: license_scan.evaluate(license_scan.to_postfix(s))
    assert license_scan.to_postfix("A or B and C with D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert ev("MIT OR GPL-3.0-only") == (1.0, {"mit", "gpl"})
    assert ev("(MIT OR GPL-2.0) AND LGPL-2.1+") == (0.6, {"mit", "gpl", "lgpl"})
    assert ev("GPL-2.0 WITH Classpath-exception-2.0")[0] == pytest.approx(0.5)
    assert ev("MIT AND") == (1.0, {"mit"}) and ev("") is None and ev(") OR") is None


def test_licence_scan(spark):
    rng = random.Random(1)
    vocabulary = ["mit", "license", "apache", "general", "public", "MIT", "License,", "x.", "été"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(200)] + ["SPDX-License-Identifier: MIT OR Apache-2.0\nmore", "Released under the MIT License.\nx"]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        hits = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r["base_labels"] == ",".join(sorted({h[1] for h in hits})) and {h[1] for h in hits} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[200]["labels"] == "apache,mit" and got[200]["score"] == 1.0 and got[200]["expressions"] == ["MIT OR Apache-2.0"]


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(prose(rng, rng.choice([0, 3, 40, 300, 900, 5000]))), None, None, None) for k in range(400)]
    placed = packing.pack(frame(spark, rows).repartition(3))
    got = placed.collect()
    bins = {}
    for r in got:
        if r["bin"] is not None:
            bins.setdefault((r["task"], r["bin"]), []).append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["place"]):
            assert r["place"] == at
            at += r["n_tokens"]
        capacity = parts[0]["capacity"]
        assert at == parts[0]["used"] <= capacity and capacity == min(c for c in packing.LENGTHS if c >= at)
    for doc_id, text, *_ in rows:
        want = len(text.split()) + 1 if text.split() else 0
        own = sorted((r["start"], r["n_tokens"]) for r in got if r["doc_id"] == doc_id)
        assert sum(n for _, n in own) == want and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert min(r["fill"] for r in packing.filled(placed).where("capacity = 2048").collect()) > 0.9


def test_packing_chooses_the_cheapest_lengths():
    where, capacity = packing.best_fit([200, 56, 256], (256, 2048))
    assert sorted(capacity) == [256, 256] and where[0] == where[1] != where[2]
    assert packing.best_fit([], (256,)) == ([], [])


TALK = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "How do I reset it? It is stuck."), (1, 1, "assistant", "> How do I reset it?\n> It is stuck.\nHold the button. Then wait."),
        (1, 2, "user", "Something else entirely here."), (1, 3, "user", ">> How do I reset it?\n> Hold the\n> button.\nFor how long?"), (1, 4, "assistant", "> For how  LONG?\n\nTen seconds."),
        (2, 0, "user", "> quoted from nowhere\nown"), (2, 1, None, None), (None, None, "user", "x"), (2, 0, "user", "> quoted from nowhere\nown"), (3, 5, "user", "> later words.\nA"), (3, 6, "user", "later words."),
    ]
    got = chat.reply_threads(wider(frame(spark, rows, TALK)).drop("text").withColumn("text", F.lit(None).cast("string")).limit(0)).collect()
    assert got == []
    out = chat.reply_threads(frame(spark, rows, TALK)).collect()
    one = {r["turn"]: r for r in out if r["conv_id"] == 1}
    assert [one[k]["reply_to"] for k in range(5)] == [None, 0, None, 1, 3]
    assert [one[k]["thread"] for k in range(5)] == [0, 0, 2, 0, 0]
    assert one[3]["text"] == "For how long?" and one[3]["n_quoted"] == 2 and one[1]["n_linked"] == 2
    assert [r["turn"] for r in out if r["conv_id"] == 1] == [0, 1, 3, 4, 2]
    assert len([r for r in out if r["conv_id"] == 2]) == 3 and all(r["reply_to"] is None for r in out if r["conv_id"] in (2, 3))
    assert {r["formatted"] for r in out if r["conv_id"] == 2 and r["turn"] == 1} == {"<|unknown|>\n\n<|end|>\n"}


def test_chat_is_native(spark):
    plan = chat.reply_threads(frame(spark, [(1, 0, "user", "> a\nb")], TALK))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_components(docs, width, share, of):
    sets = {}
    for k, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {k: k for k in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if of * common >= share * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in docs}


@pytest.mark.parametrize("small", [256, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    """Also with nodes and tiles so small that branching, linking whole and tiling all happen."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    if small < 256:
        monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = random.Random(3)
    docs = {}
    base = [prose(rng, rng.randrange(1, 200)) for _ in range(30)] + [prose(rng, 150)] * 60
    for w in base:
        for _ in range(rng.randrange(1, 4)):
            w2 = list(w)
            for _ in range(rng.randrange(0, 8)):
                w2[rng.randrange(len(w2))] = f"e{rng.randrange(9999)}"
            docs[len(docs)] = " ".join(w2)
    docs |= {900: docs[0].upper(), 901: "", 902: None, 903: "a b", 904: "A  b"}
    rows = [(k, t, None, None, None) for k, t in docs.items()]
    for width, share in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows), width, share).collect()}
        assert got == brute_components(docs, width, share, 100)


def test_sets_whose_digests_begin_alike_stay_apart(spark, monkeypatch):
    """Digests are cut to three values here; every distinct set still is a vertex of its own."""
    signatures = near_dedup._signatures
    monkeypatch.setattr(near_dedup, "_signatures", lambda docs, width: signatures(docs, width).withColumn("d", F.pmod("d", F.lit(3))))
    rng = random.Random(9)
    docs = {}
    for base in [prose(rng, 80) for _ in range(12)]:
        for _ in range(3):
            w = list(base)
            w[rng.randrange(80)] = f"e{len(docs)}"
            docs[len(docs)] = " ".join(w)
    docs |= {100: docs[4], 101: docs[4].upper(), 102: "a b", 103: ""}
    rows = [(k, t, None, None, None) for k, t in docs.items()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(docs, 5, 80, 100)
    classes = spark.createDataFrame([(1, 5), (1, 4), (1, 6), (2, 4)], "d long, w long")
    made = {(r["d"], r["w"]): r["v"] for r in near_dedup.with_vertices(classes).collect()}
    assert len(set(made.values())) == 4 and made[1, 4] == 1 and made[2, 4] == 2


def test_large_groups_of_several_tiles(spark, monkeypatch):
    """Groups of many tiles: one of near copies, and two that a covering joins but no link does."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    rng = random.Random(8)
    one, two = prose(rng, 200), prose(rng, 200)
    far = two[:176] + prose(rng, 24, 90_000)
    docs = {}
    for base in [one] * 40 + [two] * 30 + [far] * 30:
        w = list(base)
        w[rng.randrange(150)] = f"e{len(docs)}"
        docs[len(docs)] = " ".join(w)
    rows = [(k, t, None, None, None) for k, t in docs.items()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(docs, 5, 80, 100)
    assert {c for _, c in got.values()} == {0, 40, 70}


def test_components(spark):
    rng = random.Random(4)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in up} == {v: root(v) for v in up}


def brute_cut(rows):
    seen = set()
    out = {}
    for doc_id, text in sorted(rows.items()):
        kept, at = [], 0
        for a, b, after, norm in substring_dedup.units(text or ""):
            if norm in seen:
                kept.append(text[at:a])
                at = after
            seen.add(norm)
        out[doc_id] = None if text is None else "".join([*kept, text[at:]])
    return out


def test_repeats_go_and_the_first_stays(spark):
    rng = random.Random(5)
    passage = " ".join(prose(rng, 60)) + "."
    pieces = [passage] + [" ".join(prose(rng, rng.randrange(3, 14))) + rng.choice([".", "!", "\n"]) for _ in range(60)]
    rows = {k: rng.choice(["\n", " "]).join(rng.choices(pieces, k=rng.randrange(0, 9))) for k in range(80)} | {200: None, 201: f"Some lead. {passage.upper()} and a tail"}
    out = substring_dedup.remove_repeats(frame(spark, [(k, t, "en", "s", 0) for k, t in rows.items()]).withColumn("__cutter", F.lit(1)))
    got = {r["doc_id"]: r for r in out.collect()}
    assert {k: r["text"] for k, r in got.items()} == brute_cut(rows)
    for k, r in got.items():
        assert r["n_chars"] == len(r["text"] or "") and r["lang"] == "en"
        for s in r["removed_spans"]:
            norm = [u for u in substring_dedup.units(rows[k]) if (u[0], u[1]) == (s["start"], s["end"])]
            assert norm
    assert sum(passage[:-1].lower() in (r["text"] or "").lower() for r in got.values()) == 1


def test_repeats_of_short_pieces_go(spark):
    rng = random.Random(15)
    verse = "\n".join(" ".join(prose(rng, 4)) for _ in range(15))  # 60 words in short lines
    talk = " ".join(" ".join(prose(rng, rng.choice([2, 3, 9]))) + "." for _ in range(20))
    chinese = "\u6625\u7720\u4e0d\u899a\u6681\uff0c\u8655\u8655\u805e\u557c\u9ce5\u3002\u591c\u4f86\u98a8\u96e8\u8072\uff0c\u82b1\u843d\u77e5\u591a\u5c11\u3002"
    refrain = "\n".join(["la"] * 20)
    rows = {1: f"One.\n{verse}\nEnd.", 2: f"Two two.\n{verse}\nOther end.", 3: f"Three. {talk} Then.", 4: f"Four. {talk} Last.", 5: f"{chinese}\u7532\u4e59", 6: f"\u4e19\n{chinese}", 7: refrain, 8: "On its own\n----\nand short."}
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, [(k, t, "en", "s", 0) for k, t in rows.items()])).collect()}
    assert {k: got[k]["text"] for k in (1, 3, 5, 8)} == {k: rows[k] for k in (1, 3, 5, 8)}
    assert got[2]["text"] == "Two two.\nOther end." and got[4]["text"] == "Four. Last." and got[6]["text"] == "\u4e19\n"
    assert got[7]["text"].split() == ["la"] * 8  # an overlap with the first occurrence is not a repeat
    for r in got.values():
        ends = [(s["start"], s["end"]) for s in r["removed_spans"]]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot": 5.0}, [" idiotype "], 0.0, (1.0, 1.0, 1.0))
    a = lexicon.automaton()
    hits = lambda t: toxicity.measures(toxicity.fold(t), a)[3]
    for t in ("You IDIOT!", "1d10t", "an idi0t###", "іdіоt", "ｉｄｉｏｔ", "id​iot", "idiotic"):
        assert hits(t) == 1, t
    for t in ("an idiotype here", "videot", "", "1970 4711 9b0b", "$$$ !!"):
        assert hits(t) == 0, t
    assert toxicity.fold("10 000 a1b2") == b" 10 000 aib2 "


def labelled(spark, rng):
    docs, labels = [], []
    for k in range(600):
        bad, junk = k % 4 == 0, k % 3 == 0
        w = prose(rng, 60, 80)
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorkan", "zorkest", "zorkil", "plimp"])
        if junk:
            w = [f"{x}$$$" for x in w]
        docs.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(not junk), int(bad)))
    return frame(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark, random.Random(6))
    lexicon = toxicity.learn_lexicon(docs, labels, ~in_fold("doc_id", 3, 1))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, lexicon).join(docs.where(in_fold("doc_id", 3, 1)).select("doc_id"), "doc_id", "left_semi").collect()}
    assert scored and np.mean([(s >= 0.7) == (k % 4 == 0) for k, s in scored.items()]) > 0.97
    model = quality.learn_quality(docs, labels, ~in_fold("doc_id", 5, 0))
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).join(docs.where(in_fold("doc_id", 5, 0)).select("doc_id"), "doc_id", "left_semi").collect()}
    assert scored and np.mean([(s >= 0.3) == (k % 3 != 0) for k, s in scored.items()]) > 0.97
    odd = quality.score_quality(wider(frame(spark, ODD)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_quality(frame(spark, []), model).collect() == []


def test_classifiers_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    assert all(r["score"] == 0.5 for r in toxicity.score_toxicity(docs, toxicity.learn_lexicon(docs, none, every)).collect())
    assert all(r["score"] == 0.5 for r in quality.score_quality(docs, quality.learn_quality(docs, none, every)).collect())
    assert quality.learn_quality(frame(spark, []), none, every).vectors.shape == (quality.ROWS, quality.SIZE)


def test_lexicon_prefers_beginnings_and_learns_phrases(spark):
    rng = random.Random(16)
    docs = [(k, " ".join([*prose(rng, 30), *([] if k % 2 else ["zorka", "ass"]), *([rng.choice(["assho", "assha"])] if k % 6 == 0 else []), *(["never", "zorka", "mind"] if k % 20 == 1 else [])]), "en", "s", 1) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, 1 - k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(frame(spark, docs), labels, F.lit(True))
    assert {" zorka", " ass ", " assh"} <= set(lexicon.weights) and " zorka " not in lexicon.weights and " zork" not in lexicon.weights
    hits = lambda t: toxicity.measures(toxicity.fold(t), lexicon.automaton())[3]
    assert hits("those zorkas") == 1 and hits("never zorka mind") == 0 and hits("you zorka") == 1
    chosen, later = toxicity.choose([(" abcde", 90, 0), (" abcd", 95, 20), (" abc ", 50, 0), (" abcde ", 90, 0)], 100, 100)
    assert set(chosen) == {" abcde", " abc "} and later == {" abcd"}


def test_lexicon_keeps_every_significant_entry(spark):
    rng = random.Random(17)
    bad = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}q" for k in range(600)]
    docs = [(k, " ".join([*prose(rng, 10), *([] if k % 2 else bad[k // 2 % 50 * 12 :][:12])]), "en", "s", 1) for k in range(1500)]
    labels = spark.createDataFrame([(k, 1, 1 - k % 2) for k in range(1500)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(frame(spark, docs), labels, F.lit(True))
    assert {f" {w} " for w in bad} <= set(lexicon.weights) and not any(e.startswith(" w") and e[2].isdigit() for e in lexicon.weights)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(7)
    items = [(k, " ".join(prose(rng, n, 50))) for k, n in enumerate([25, 12, 10, 9, 3, 1, 0, 40])] + [(2, "w1 w2 w3"), (None, "w7 w7"), (11, None)]
    docs = []
    for k in range(150):
        w = prose(rng, rng.randrange(0, 80), 50)
        source = rng.choice(items)[1]
        if source and k % 2:
            part = source.split()
            at = rng.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = part[at : at + rng.randrange(3, 30)]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).upper(), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for k, text, *_ in docs:
        w = re.findall(r"[0-9a-z]+", text.lower())
        hit, met = set(), set()
        for item_id, t in items:
            iw = (t or "").split()
            size = min(10, len(iw))
            for win in {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else ():
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) == win:
                        hit |= set(range(i, i + size))
                        met |= {item_id} - {None}
        want[k] = (len(w), len(hit), sorted(map(str, met)))
    for block in (10**9, 300):
        got = {r["doc_id"]: r for r in decontamination.contamination(frame(spark, docs), bench, block_bytes=block).collect()}
        assert {k: (r["n_words"], r["n_hit"], r["items"]) for k, r in got.items()} == want
    text = {d[0]: d[1] for d in docs}
    for k, r in got.items():
        assert all(re.match(r"\W|_|$", text[k][s["end"] : s["end"] + 1]) for s in r["spans"])
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(frame(spark, docs), bench).collect()}
    assert kept == {k for k, v in want.items() if v[1] == 0}


def test_blocks_of_a_benchmark_keep_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "same text in two rows"), (2, "text of this id"), (None, "word")], "item_id long, text string")
    whole, parts = (sorted(map(str, decontamination.contamination(frame(spark, ODD), bench, block_bytes=b).collect())) for b in (10**6, 20))
    assert whole == parts and len(whole) == len(ODD)


def test_syncmers_are_context_free():
    rng = random.Random(8)
    passage = " ".join(prose(rng, 80))
    a, b = fingerprint.syncmers("abc def " + passage + " tail")[0], fingerprint.syncmers("Zz" + passage + " other end")[0]
    inside = lambda at, lead: {x - lead for x in at.tolist() if lead <= x and x - lead + fingerprint.K <= len(passage)}
    assert inside(a, 8) == inside(b, 2) == set(fingerprint.syncmers(passage)[0].tolist())
    gaps = np.diff(fingerprint.syncmers(passage)[0])
    assert gaps.max() <= 2 * fingerprint.K  # a window is never far from an anchor in varied text
    assert len(fingerprint.syncmers("short")[0]) == 1 and len(fingerprint.syncmers("")[0]) == 0


def test_next_document(spark):
    rng = random.Random(9)
    texts = {k * 3: " ".join(prose(rng, rng.randrange(0, 120))) for k in range(90)}
    texts |= {500: None, 501: "é" * 7, 502: texts[3], 503: "a"}
    rows = [(k, t, None, None, None) for k, t in texts.items()]
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame(spark, rows).repartition(5)).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for k, after in zip(order, order[1:] + order[:1]):
        text, other = texts[k] or "", texts[after] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.as_text(fingerprint.sketch(text)) and r["edited_fingerprint"] == fingerprint.as_text(fingerprint.sketch(changed))
        assert r["near_next"] == fingerprint.likeness(fingerprint.sketch(text), fingerprint.sketch(other))
    assert got[502]["fingerprint"] == got[3]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 150]
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in long])
    alone = fingerprint.compare_with_next(frame(spark, rows[:1])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_likeness_counts_all_anchors_in_order(spark):
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    rng = np.random.default_rng(18)
    for n, m, values in [(40, 30, 3), (300, 200, 2), (60, 80, 50), (400, 500, 1), (1, 5, 2)] * 4:
        a, b = rng.integers(0, values, n).astype(np.uint64), rng.integers(0, values, m).astype(np.uint64)
        assert fingerprint.in_order(a, b) == fingerprint.in_order(b, a) == brute(a.tolist(), b.tolist())
    words = random.Random(18)
    shared = " ".join(prose(words, 30))
    one, two = (" ".join(prose(words, 3000, 100_000)) for _ in range(2))
    rows = [(1, f"{one} {shared}", None, None, None), (2, f"{shared} {two}", None, None, None)]
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame(spark, rows)).collect()}
    a, b = (fingerprint.syncmers(r[1])[1] for r in rows)
    common = len(set(a.tolist()) & set(b.tolist()))
    assert common and got[1]["near_next"] == got[2]["near_next"] == pytest.approx(2 * common / (len(a) + len(b)))
    assert fingerprint.likeness(fingerprint.sketch(rows[0][1]), fingerprint.sketch(rows[1][1])) != got[1]["near_next"]


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, random.Random(10))
    bench = " ".join(f"b{k}" for k in range(30))
    passage = " ".join(f"p{k}" for k in range(60)) + "."
    clean = [(k, " ".join(prose(random.Random(k), 50)) + ".", "en", "s", 0) for k in range(1000, 1040)]
    more = clean + [(2000, clean[0][1].upper(), "en", "s", 0), (2001, f"Lead {bench} tail", "en", "s", 0), (2002, "He zorkan zorkil plimp zorkest.", "en", "s", 0)]
    more += [(2003, f"First here.\n{passage}", "en", "s", 0), (2004, f"Then again.\n{passage}\nIts own words " + " ".join(f"q{k}" for k in range(50)), "en", "s", 0), (2005, None, None, None, None)]
    docs.unionByName(frame(spark, more)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns
        held.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in held.collect()}
    assert 2002 not in seen["toxicity"] and set(range(1000, 1040)) | {2000, 2005} <= set(seen["toxicity"])
    assert 2000 not in seen["near_dedup"] and set(range(1000, 1040)) <= set(seen["near_dedup"])
    assert passage in seen["substring_dedup"][2003] and passage not in seen["substring_dedup"][2004] and "own words" in seen["substring_dedup"][2004]
    assert 2001 not in seen["decontamination"] and {2003, 2004, 2005} <= set(seen["decontamination"])
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(seen["decontamination"])
