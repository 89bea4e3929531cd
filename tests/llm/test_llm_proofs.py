"""Operators against versions written from their definitions alone, and cases that once went wrong."""

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import chat, decontamination, fingerprint, labels, license_scan, near_dedup, packing, quality, queries, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)


def test_hosts_of_any_number_of_labels(spark):
    urls = ["http://" + "a." * 140 + "example.com/x", "http://" + "b" * 5000 + "." + "a." * 140 + "example.com/en/", "http://com/", "http://a..com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert got == {0: ("com/", "allow"), 1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("com/", "allow")}
    ties = {"b.co/x": "allow", "co/x/yz": "block"}  # both fit and are equally long once the path allows
    page = spark.createDataFrame([(1, "http://b.co/x/yz"), (2, "http://b.co/x")], "page_id long, url string")
    longest = {"a.co/xy": "allow", "co/xy.z": "block"}
    assert {r["page_id"]: r["rule"] for r in url_filter.judge_urls(page, ties).collect()} == {1: "co/x/yz", 2: "b.co/x"}
    tied = spark.createDataFrame([(1, "http://a.co/xy.z")], "page_id long, url string")
    assert url_filter.judge_urls(tied, longest).first()["rule"] == "a.co/xy"  # of equal length the first in order
    with pytest.raises(ValueError):
        url_filter.judge_urls(page, {"no-slash": "allow"})


def descend(tokens):
    """Value and labels of an expression by recursive descent; tokens are consumed from the front."""

    def one():
        if tokens and tokens[0] == "(":
            tokens.pop(0)
            got = some_or()
            if tokens and tokens[0] == ")":
                tokens.pop(0)
            return got
        label = license_scan.label_of(tokens.pop(0))
        return license_scan.FREEDOM.get(label, license_scan.UNKNOWN), {label}

    def some_with():
        value, names = one()
        while tokens and tokens[0].lower() == "with":
            tokens.pop(0)
            value = min(1.0, value + 0.1)
            one()
        return value, names

    def joined(word, below, choose):
        def parse():
            value, names = below()
            while tokens and tokens[0].lower() == word:
                tokens.pop(0)
                other, more = below()
                value, names = choose(value, other), names | more
            return value, names

        return parse

    some_and = joined("and", some_with, min)
    some_or = joined("or", some_and, max)
    return some_or()


def test_expressions_match_recursive_descent():
    rng = random.Random(1)
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1+", "MPL-2.0", "CC-BY-NC-4.0", "Foo-1"]

    def grow(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return [rng.choice(names)]
        if kind < 0.4:
            return [rng.choice(names), "WITH", "Classpath-exception-2.0"]
        if kind < 0.6:
            return ["(", *grow(depth - 1), ")"]
        return [*grow(depth - 1), rng.choice(["AND", "OR", "and", "or"]), *grow(depth - 1)]

    for _ in range(500):
        tokens = grow(4)
        text = "".join(t if t in "()" else f" {t}" for t in tokens)
        got, want = license_scan.evaluate(license_scan.to_postfix(text)), descend(list(tokens))
        assert got[0] == pytest.approx(want[0], abs=1e-9) and got[1] == want[1], text


def test_expressions_over_lines_and_longest_notices():
    a = license_scan.build_automaton()
    one = lambda t: license_scan.scan(t, a)
    got = one("// SPDX-License-Identifier: (MIT OR\n//  Apache-2.0) AND GPL-2.0\n// other words")
    assert (got["labels"], got["score"]) == ("apache,gpl,mit", 0.4)
    assert one("SPDX-License-Identifier: MIT\nGPL-2.0")["labels"] == "mit"
    assert one("SPDX-License-Identifier: MIT, and more")["expressions"] == ["MIT"]
    got = one("GNU Lesser General Public License")
    assert (got["base_labels"], got["labels"], got["score"]) == ("gpl", "gpl,lgpl", 0.6)


def test_notices_match_brute_force():
    rng = random.Random(2)
    a = license_scan.build_automaton()
    phrases = list((license_scan.BASE | license_scan.NOTICES).items())
    for _ in range(300):
        parts = [rng.choice(phrases)[0] if rng.random() < 0.5 else rng.choice(["license", "public", "general", "lesser", "the"]) for _ in range(rng.randrange(0, 8))]
        words = " ".join(parts).split()
        met = [(i, i + len(p.split()), label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        free = {label for x, y, label in met if not any((u, v) != (x, y) and u <= x and y <= v for u, v, _ in met)}
        base = {label for x, y, label in met if (" ".join(words[x:y])) in license_scan.BASE}
        got = license_scan.scan(" ".join(parts), a)
        assert set(filter(None, got["labels"].split(","))) == free | base
        assert got["score"] == min((license_scan.FREEDOM[x] for x in free), default=0.0)


def cheapest(sizes, lengths, per):
    """The least cost of any packing, by trying them all."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(min(c for c in lengths if c >= b) + per for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= lengths[-1]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_optimum():
    rng = random.Random(3)
    ratios, mixed = [], 0
    for _ in range(250):
        lengths = tuple(sorted(rng.sample(range(3, 20), 4)))
        sizes = [rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(1, 8))]
        where, capacity = packing.best_fit(sizes, lengths, 1.0)
        used = [sum(s for s, b in zip(sizes, where) if b == k) for k in range(len(capacity))]
        assert all(0 < u <= c and c == min(x for x in lengths if x >= u) for u, c in zip(used, capacity))
        ratios.append(sum(c + 1.0 for c in capacity) / cheapest(sizes, lengths, 1.0))
        mixed += len(set(capacity)) > 1
    assert max(ratios) < 1.2 and np.mean(ratios) < 1.01 and np.mean([r == 1 for r in ratios]) > 0.9 and mixed > 50


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "x " * 5000), (4, "x " * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["bin"] is None) == [1, 2, 3] and all(r["n_tokens"] == 0 for r in got if r["bin"] is None)
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 4) == 2 * 5001 and [r["n_tokens"] for r in got if r["doc_id"] is None] == [3]
    assert packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), n_tokens=F.lit(-3)).first()["n_tokens"] == 0


def test_quotes_match_sql(spark, tmp_path):
    """A table with nested, repeated, broken and foreign quotes against the registered SQL."""
    rng = random.Random(4)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if said:
                    level = rng.randrange(1, 4)
                    lines += [rng.choice([">" * level, "> " * level, ">" * level + " "]) + x for x in rng.choice(said).split("\n")]
                lines.append(rng.choice(["", f"Own s{rng.randrange(40)} words. And  more s{rng.randrange(40)}!", "a > b", "> nobody said this."]))
            text = rng.choice(["\n", "\r\n"]).join([*lines, f"Turn {rng.randrange(9)} ends here?"])
            said.append(re.sub(r"(?m)^(?:[ \t]?>)+[ \t]?", "", text.replace("\r\n", "\n")))
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), text))
    rows += [(90, 0, "user", None), (90, 1, "user", "> "), (90, 1, "user", "part two"), (91, 3, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(queries.oracle_sql()["op4_chat_threads"])
    names = want.columns
    found = chat.reply_threads(spark.read.parquet(f"{tmp_path}/conversations.parquet")).select(*names).collect()
    ours, theirs = (sorted(map(str, map(tuple, x))) for x in (found, want.fetchall()))
    assert [(a, b) for a, b in zip(ours, theirs) if a != b] == [] and len(ours) == len(theirs)
    assert sum(r["reply_to"] is not None for r in found) > 40 and max(r["n_quoted"] for r in found) > 2


def test_quality_matches_plain_loops(spark):
    rng = np.random.default_rng(5)
    width = 2 * quality.SIZE + 1
    model = quality.QualityModel(rng.normal(size=(quality.ROWS, quality.SIZE)).astype(np.float32), rng.normal(size=width), rng.uniform(0.5, 2, width), rng.normal(size=(width, quality.HIDDEN)), rng.normal(size=quality.HIDDEN), rng.normal(size=quality.HIDDEN), 0.3, 2.0)
    texts = {1: "Some words, SOME some some 12 twelve!!", 2: "", 3: None, 4: "été “quoted” x " * 50, 5: " \n "}

    def score(text):
        tokens = (text or "").encode().split()
        x = [0.0] * width
        for k, t in enumerate(tokens):
            word = xxhash.xxh3_64_intdigest(t.lower()) % quality.ROWS
            kinds = ["A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b) for b in t[:2] + t[-3:]]
            short = "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)
            form = 1 if k and tokens[k - 1] == t else xxhash.xxh3_64_intdigest(b"\0" + short.encode()) % quality.ROWS
            for d in range(quality.SIZE):
                x[d] += float(model.vectors[word][d]) / len(tokens)
                x[quality.SIZE + d] += float(quality.INDEX[form][d]) / len(tokens)
        if tokens:
            x[-1] = float(np.log1p(len(tokens))) / 10
        logit = model.b2
        for h in range(quality.HIDDEN):
            logit += max(0.0, sum((x[d] - model.mean[d]) / model.scale[d] * model.w1[d][h] for d in range(width)) + model.b1[h]) * model.w2[h]
        return 1 / (1 + np.exp(-logit / model.temperature))

    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs_of(spark, texts), model).collect()}
    assert got == {k: pytest.approx(score(t), abs=1e-4) for k, t in texts.items()}


def test_toxicity_matches_plain_loops(spark):
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({" ab": 2.0, " abc ": 3.5, " bca": 1.25, " c ": 0.5}, [" abca ", " bcab c "], -1.0, (0.7, 0.4, 0.2))
    texts = {k: " ".join("".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(0, 40))) for k in range(120)} | {500: None, 501: "АB 4BC!"}

    def score(text):
        words = {500: "", 501: "ab abc"}.get(next(k for k, t in texts.items() if t is text), text or "")
        line = f" {words} " if words else ""
        covered = {q for p in range(len(line)) for e in lexicon.exceptions if line.startswith(e, p) for q in range(p, p + len(e))}
        hits = {p: max(w for e, w in lexicon.weights.items() if line.startswith(e, p)) for p in range(len(line)) if any(line.startswith(e, p) for e in lexicon.weights)}
        # A hit's span begins at the space before its word; the space that ends an exception is not covered.
        ends = {p + len(e) - 1 for p in range(len(line)) for e in lexicon.exceptions if line.startswith(e, p)}
        starts = {p for p in range(len(line)) for e in lexicon.exceptions if line.startswith(e, p)}
        inside = lambda p: any(line.startswith(e, s) and s <= p < s + len(e) - 1 for s in starts for e in lexicon.exceptions)
        left = {p: w for p, w in hits.items() if not (p in covered and (inside(p) or p not in ends))}
        if not left:
            m = (0.0, 0.0, 0.0)
        else:
            total = sum(left.values())
            m = (np.log1p(total), total / np.sqrt(line.count(" ")), max(left.values()))
        z = lexicon.bias + sum(s * x for s, x in zip(lexicon.slopes, m))
        return 1 / (1 + np.exp(-z))

    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(spark, texts), lexicon).collect()}
    assert got == {k: pytest.approx(score(t), abs=1e-9) for k, t in texts.items()}


def plain_units(text, least):
    """Units by definition: of all runs of pieces, the long single ones and the shortest that begin or end with a short piece."""
    borders, i = [], 0
    while i < len(text):
        j = i
        if text[i].isspace() and i and text[i - 1] in ".!?":
            while j < len(text) and text[j].isspace():
                j += 1
        elif text[i] == "\n":
            while j < len(text) and text[j] == "\n":
                j += 1
        if j > i:
            borders.append((i, j))
        i = max(j, i + 1)
    parts, start = [], 0
    for a, b in [*borders, (len(text), len(text))]:
        words = re.findall("[0-9a-z]+", text[start:a].lower())
        if words:
            parts.append((start, a, b, words))
        start = b
    n = [len(p[3]) for p in parts]
    runs = [(x, y) for x in range(len(n)) for y in range(x, len(n)) if sum(n[x : y + 1]) >= least]
    chosen = [(x, y) for x, y in runs if x == y or (n[x] < least and sum(n[x:y]) < least) or (n[y] < least and sum(n[x + 1 : y + 1]) < least)]
    return [(parts[x][0], parts[y][1], parts[y][2], "\n".join(" ".join(p[3]) for p in parts[x : y + 1])) for x, y in sorted(chosen)]


def test_units_match_their_definition():
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bc", "d1"]) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", ".\n\n", "?", "\n \n"]) for _ in range(rng.randrange(0, 60)))
        assert [(a, b, c, u.decode()) for a, b, c, u in substring_dedup.units(text, 5)] == plain_units(text, 5), text


def test_syncmers_match_their_definition():
    rng, mask = random.Random(8), 2**64 - 1
    a, b, k, s = int(fingerprint._A), int(fingerprint._B), fingerprint.K, fingerprint.S

    def inner(points):
        x = points[0]
        for p in points[1:]:
            x = (x * a + p) & mask
        x = ((x ^ x >> 31) * b) & mask
        return x ^ x >> 33

    empty = 0
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "é", "\U0001f600", " "][: rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 61)))
        at, hashes = fingerprint.syncmers(text)
        assert len(at) == len(hashes) and (len(at) > 0) == (text != "")
        if len(text) >= k:
            h = [inner([ord(c) for c in text[i : i + s]]) for i in range(len(text) - s + 1)]
            want = [i for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]
            assert at.tolist() == (want or [h.index(min(h))])
            empty += not want
    assert empty  # texts without a closed syncmer were among them


def test_short_texts_are_like_none_that_is_empty(spark):
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs_of(spark, {1: None, 2: "hello wide world"})).collect()}
    assert got[2]["fingerprint"] != "" and got[2]["near_next"] == 0.0 and got[1]["fingerprint"] == ""


def test_next_document_where_one_id_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(7 if k % 3 else None if k % 2 else k, f"text {rng.randrange(10**9)} of row {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [tuple(r) for r in docs.withColumn("th", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), "th").collect()]
    got = {(r["doc_id"], r["th"]): r for r in fingerprint.compare_with_next(docs.repartition(6)).collect()}
    assert len(got) == len(rows)
    for (doc_id, text, th), (_, after, _) in zip(order, order[1:] + order[:1]):
        a, b = (fingerprint.syncmers(t)[1] for t in (text, after))
        assert got[doc_id, th]["near_next"] == fingerprint.nearness(a, b)
    keys = [(2, 5), (1, 0), (2, -9), (None, 3), (2**60 + 1, 0), (2**60, 0), (-(2**63), 0), (2**63 - 1, 7)]
    numbers = fingerprint.Ranges(keys, len(keys))
    asked = sorted([*keys, (2, 0), (2**60 + 2, 1), (None, -1), (None, 9), (-(2**63) + 1, 0), (2**63 - 1, 6)], key=lambda k: (k[0] is None, -(k[0] or 0), k[1]))
    found = numbers.number(np.array([k[0] or 0 for k in asked]), np.array([k[0] is None for k in asked]), np.array([k[1] for k in asked])).tolist()
    assert found == sorted(found) and len(set(found)) == len(keys)
    assert fingerprint.Ranges([], 4).number(np.array([1]), np.array([False]), np.array([1])).tolist() == [0]


@pytest.mark.parametrize("first", [0, 2**60, 2**63 - 300, -(2**63), -(2**60)])
def test_next_document_of_dense_ids(spark, first):
    rng = random.Random(first)
    rows = [(first + k, f"text {rng.randrange(10**9)} of {k} " * rng.randrange(1, 4)) for k in range(300)]
    rows += [(first + 7, "again"), (first + 7, "again"), (None, "no id"), (None, None), (first + 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [tuple(r) for r in docs.withColumn("th", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), "th").collect()]
    got = {}
    for r in fingerprint.compare_with_next(docs.repartition(5)).collect():
        got.setdefault((r["doc_id"], r["th"]), []).append(r["edited_sha256"])
    expected = {}
    for (doc_id, text, th), (_, after, _) in zip(order, order[1:] + order[:1]):
        changed = fingerprint.edited(text or "", after or "")
        expected.setdefault((doc_id, th), []).append(hashlib.sha256(changed.encode()).hexdigest())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_repetitive_texts_take_linear_time():
    a = "the cat sat on a mat and " * 40_000
    begun = time.perf_counter()
    assert fingerprint.nearness(*(fingerprint.syncmers(t)[1] for t in (a, a[:300_000] + "a few other words" + a[300_000:]))) > 0.99
    assert 0 < fingerprint.nearness(*(fingerprint.syncmers(t)[1] for t in (a, "the cat sat on the mat and " * 37_000))) < 0.5
    assert time.perf_counter() - begun < 20


def longest_common(a, b):
    last = np.zeros(len(b) + 1, np.int32)
    row = last.copy()
    for x in a:
        np.maximum(last[1:], np.where(b == x, last[:-1] + 1, 0), out=row[1:])
        np.maximum.accumulate(row, out=row)
        last, row = row, last
    return int(last[-1])


@pytest.mark.parametrize("piece", [1, 7, 64, 500])
def test_matching_in_order_is_exact_across_pieces(monkeypatch, piece):
    monkeypatch.setattr(fingerprint, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for k in range(12):
        a = rng.integers(0, 2, rng.integers(500, 700)).astype(np.uint64)
        near = np.insert(np.delete(a, rng.integers(0, len(a), 9)), [5, 90, 300], 1)
        b = (near, rng.integers(0, 2, rng.integers(500, 700)).astype(np.uint64), np.concatenate([a[200:], a[:200]]))[k % 3]
        assert fingerprint.in_order(a, b) == fingerprint.in_order(b, a) == longest_common(a, b)


def test_likeness_of_long_repetitive_texts_is_exact(spark):
    one, two = "the cat sat on a mat and ", "some dog ran off in fog or "
    texts = {1: one * 2_000 + two * 4_000, 2: two * 4_000 + one * 2_000}
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs_of(spark, texts)).collect()}
    a, b, of_one, of_two = (fingerprint.syncmers(t)[1] for t in (*texts.values(), one * 2_000, two * 4_000))
    assert min(len(a), len(b)) > fingerprint.PIECE
    # Nothing but the anchors of one phrase, all of them, can match in order: they have none in common, nor have the seams.
    assert not set(of_one.tolist()) & set(of_two.tolist()) and set(a.tolist()) & set(b.tolist()) == set(of_one.tolist()) | set(of_two.tolist())
    assert got[1]["near_next"] == got[2]["near_next"] == pytest.approx(2 * max(len(of_one), len(of_two)) / (len(a) + len(b)))


def test_long_quote_marks_kill_nothing(spark):
    rows = [(1, 0, "user", "First words. Second words."), (1, 1, "assistant", ">" * 100_000 + " First words.\nAnswer."), (1, 2, "user", "> " * 50_000 + "Answer.\n>> First words.\nYes."), (2, 0, "user", " >" * 100_000)]
    got = {(r["conv_id"], r["turn"]): r for r in chat.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1]["reply_to"] == 0 and got[1, 1]["text"] == "Answer." and got[1, 2]["reply_to"] == 0 and got[2, 0]["text"] == ""


CLASHING = ("__key", "__id", "__th", "__spans", "__cut", "__m", "key", "of_id", "of_th", "gone", "shorter", "measured", "times", "th", "spans")


def test_columns_of_any_name_stay(spark):
    docs = docs_of(spark, {1: "one two three four five six seven eight nine ten. Own words.", 2: "one two three four five six seven eight nine ten. Other.", 3: "zork", 4: None})
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    lexicon = toxicity.Lexicon({" zork": 9.0}, [], -3.0, (1.0, 1.0, 1.0))
    for out, left in ((near_dedup.drop_near_duplicates(docs), {1, 2, 3, 4}), (substring_dedup.remove_repeats(docs), {1, 2, 3, 4}), (toxicity.drop_toxic(docs, lexicon), {1, 2, 4})):
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == left and out.columns[: len(docs.columns)] == docs.columns
        assert all(r[name] == f"{name} of {r['doc_id']}" for r in rows for name in CLASHING)


def test_an_id_gives_one_labelled_text(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(60)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, toxic int")
    sample, totals = labels.labelled_sample(docs, known, "toxic", F.lit(True), 10)
    rows = sample.collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2] and totals == {0: 2, 1: 1}


def test_long_items_are_sent_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
    rng = random.Random(10)
    item = [f"w{rng.randrange(500)}" for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, "kurz"), (3, "..."), (4, None)], "item_id long, text string")
    texts = {k: " ".join([*("x" * 3), *item[k : k + 10], "y"]) for k in range(0, 391, 5)} | {900: " ".join(item[3:12]), 901: "ein kurz wort"}
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(docs_of(spark, texts), bench).collect()}
    assert all(got[k][1] == ["1"] and got[k][0] >= 10 for k in texts if k < 900) and got[900] == (0, []) and got[901] == (1, ["2"])
    pieces = decontamination.benchmark_pieces(bench, 10).collect()
    assert max(len(r["text"].split()) for r in pieces) <= 25


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, {}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from quernel.llm import _shared

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: {"spark.master": "spark://host:7077"}.get(name, default))

    with pytest.raises(RuntimeError):
        _shared.shared_dir(Session)
