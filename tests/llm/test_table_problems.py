"""Problems 4, 6, 7, 8 and 9, on issues and documents."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge.llm import copies, leakage, packing, prefixes, terms, truncation
from sitegauge.llm.skew import attach_classes

ISSUES = "issue_id bigint, severity string, issue string, recommendation string, html_snippet string, term string, n bigint, _id string"


def issues(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], ISSUES)


# --- 4 -----------------------------------------------------------------------------------


def test_terms_against_sets(spark):
    random.seed(5)
    words = ["Ab", "ab", "C1", "é", "Ü", "straße", "x_y", "don't", "½", "𝒜", "日本", "!", ""]
    texts = [None if random.random() < 0.1 else " ".join(random.choices(words, k=random.randrange(8))) for _ in range(400)]
    df = issues(spark, [(i, "e", t, None, None) for i, t in enumerate(texts)])
    occurrences, records = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        for m in re.findall(r"[^\W_]+", t or ""):
            occurrences[m.lower()] += 1
            records[m.lower()].add(i)
    for flush_at in (1, 400_000):
        got = {(r["field_name"], r["term"]): (r["n_occurrences"], r["n_records"]) for r in terms.term_statistics(df, ["issue", "recommendation"], flush_at).collect()}
        assert got == {("issue", t): (n, len(records[t])) for t, n in occurrences.items()}


def test_term_pattern_is_letters_and_numbers():
    for c in map(chr, [*range(0x3000), *range(0x1D400, 0x1D800)]):
        assert bool(terms.TERM.fullmatch(c)) == (unicodedata.category(c)[0] in "LN"), hex(ord(c))


def test_marks(spark):
    df = issues(spark, [(i, "e", f"often {'half' if i < 5 else ''} w{i}", "", None) for i in range(10)])
    got = {r["term"]: r["mark"] for r in terms.marked_terms(df, ["issue", "recommendation"]).collect()}
    assert got["often"] == got["half"] == "common" and got["w3"] == "rare"
    assert terms.marked_terms(issues(spark, []), ["issue"]).count() == 0
    long = issues(spark, [(1, "e", "a b " * 200_000, None, None), (1, "e", "a b " * 200_000, None, None)])
    assert {r["term"]: (r["n_occurrences"], r["n_records"]) for r in terms.term_statistics(long, ["issue"]).collect()} == {"a": (400_000, 2), "b": (400_000, 2)}
    some = issues(spark, [*((i, "e", "", None, None) for i in range(3)), (3, "e", "x", None, None), (4, "e", None, None, None)])
    values = {(r["field_name"], r["value"]): (r["n_occurrences"], r["n_records"], r["mark"]) for r in terms.marked_values(some, ["issue", "recommendation"]).collect()}
    assert values == {("issue", ""): (3, 3, "common"), ("issue", "x"): (1, 1, "rare")}
    assert terms.marked_values(issues(spark, []), ["issue"]).count() == 0


# --- 6 -----------------------------------------------------------------------------------


def plain(s):
    return "".join(c for c in s.upper().lower() if unicodedata.category(c)[0] in "LMN")


def markup(s):
    out = []
    for tag, text in re.findall(r"(<[^<>]*>)|([^<]+)", s):
        if tag:
            name = re.match(r"<\s*/?\s*[^\s/>]*", tag)[0]
            out.append(plain(name) + "".join(sorted(plain(a) for a in re.findall(r"[^\s=\"'/<>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", tag[len(name) :]))))
        else:
            out.append(plain(text))
    return "".join(out)


def brute(rows):
    groups = defaultdict(list)
    for i, s, t, h in rows:
        groups[tuple(None if x is None else f(x) for f, x in ((plain, s), (plain, t), (markup, h)))].append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_copies_against_brute_force(spark):
    random.seed(8)
    rows = []
    for i in range(600):
        t = random.choice(["No heading!", "no  heading", "NO HEADING…", "Heading no", "", None, "“No” heading", "straße", "STRASSE"])
        h = random.choice(['<a id="x" href="/y">T</a>', "<A HREF='/y' ID='x' >t</A>", '<a id="xhref" ="/y">T</a>', "", None, "plain", "<", "<a", '<a id="x">T</a><b c="d" a="e">', "<a id='x'>t </a><b a='e'  c='d'>"])
        rows.append((i, random.choice(["error", " Error", "info", None]), t, h))
    df = issues(spark, [(i, s, t, "r", h) for i, s, t, h in rows])
    same = {"id_col": "issue_id", "plain": ["severity", "issue"], "markup": ["html_snippet"]}
    got = {(r["first_id"], r["copy_id"]) for r in copies.formatting_copies(df, **same).collect()}
    assert got == brute(rows)
    counted = {r["first_id"]: r["n_copies"] for r in copies.collapsed_records(df, **same).collect()}
    assert sum(counted.values()) == 600 and len(counted) == 600 - len(got)
    assert copies.formatting_copies(issues(spark, []), **same).count() == 0


def test_one_large_class(spark):
    rows = spark.range(3000).select(F.col("id").alias("issue_id"), F.lit("e").alias("severity"), F.when(F.col("id") < 2500, "Same, text").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("issue"), F.lit(None).cast("string").alias("html_snippet"))
    got = copies.formatting_copies(rows, "issue_id", ["severity", "issue"], ["html_snippet"], salts=2)
    assert (got.count(), got.agg(F.max("first_id")).first()[0]) == (2499, 0)


def test_very_long_snippet(spark):
    text = "<p " + 'a="b" ' * 20_000 + ">" + "x" * 200_000
    df = issues(spark, [(1, "e", "t", None, text), (2, "e", "t", None, text.upper())])
    assert copies.formatting_copies(df, "issue_id", ["severity", "issue"], ["html_snippet"]).count() == 1


def test_payloads(spark):
    rows = [
        (1, '{"severity": "error", "issue": "a", "htmlSnippet": null, "extra": [1]}'),
        (2, '  {"issue": "a", "severity": "error"}'),
        (3, "[]"), (4, "null"), (5, ""), (6, None), (7, '{"severity": "error", "issue": "cut'), (8, "no record"), (9, '{"severity": "error"}'), (10, '[{"severity": "error", "issue": "a"}]'),
    ]
    got = copies.parse_payloads(spark.createDataFrame(rows, "issue_id bigint, payload string"))
    assert sorted((r["issue_id"], r["html_snippet"]) for r in got.collect()) == [(1, None), (2, None)]


# --- 7 -----------------------------------------------------------------------------------


def test_nnls():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert x.min() >= 0 and gradient.max() < 1e-6 and abs(gradient @ x) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30), st.sampled_from([64, 100, 300]))
def test_plans_use_up_the_histogram(histogram, capacity):
    used = Counter()
    for sizes, repeats in packing.plan_containers(histogram, capacity):
        assert sum(s * m for s, m in sizes.items()) <= capacity and repeats > 0
        for s, m in sizes.items():
            used[s] += m * repeats
    assert used == Counter(histogram)


def test_packing(spark):
    random.seed(4)
    sizes = [(i, random.choice([40, 40, 40, random.randrange(1, 300)])) for i in range(3000)] + [(9000, 1000), (9001, 256), (9002, 0), (9003, None), (40, 40)]
    df = spark.createDataFrame(sizes, "id bigint, n_tokens bigint")
    rows = packing.pack(df, 256, salts=8).collect()
    used, whole = Counter(), defaultdict(list)
    for r in rows:
        used[r["container_id"]] += r["n_tokens"]
        whole[r["id"]].append(r["n_tokens"])
    assert max(used.values()) <= 256 and set(used) == set(range(len(used)))
    assert sum(used.values()) == sum(n or 0 for _, n in sizes)
    assert sorted(whole[9000], reverse=True) == [256, 256, 256, 232] and 9002 not in whole and 9003 not in whole
    assert all(len(p) == 1 for i, p in whole.items() if i not in (40, 9000) and dict(sizes)[i] <= 256)
    assert sum(used.values()) / (len(used) * 256) > 0.95
    assert packing.pack(df.filter("false"), 256).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "two words", 5), (2, " \n", 5), (3, None, 5), (4, "", 5), (5, "<|endoftext|>", 5)], "doc_id bigint, text string, n_tokens bigint")
    got = {r["id"]: r["n_tokens"] for r in packing.token_sizes(df, "doc_id", "text").collect()}
    assert got[1] == 2 and set(got) == {1, 5} and got[5] > 1


# --- 8 -----------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcde"), max_size=25))
def test_seeds_against_brute_force(texts, stream):
    auto = leakage.Automaton(dict(enumerate(texts)))
    ids = [auto.vocabulary.get(w, 0) for w in stream]
    finder = leakage.Finder(auto.arrays({i: [True] * len(t) for i, t in enumerate(texts)}, 2), {}, 2, 0.4, 0.75)

    def holders(part):
        return {i for i, t in enumerate(texts) if any(t[k : k + len(part)] == part for k in range(len(t) - len(part) + 1))}

    longest = [max((n for n in range(e + 1) if holders(stream[e - n : e])), default=0) for e in range(len(stream) + 1)]
    expected = defaultdict(set)
    for e in range(1, len(stream) + 1):
        n = longest[e]
        if n >= 2 and (e == len(stream) or longest[e + 1] != n + 1):
            for i in holders(stream[e - n : e]):
                expected[i].add((e - n, e))
    assert {i: set(s) for i, s in finder.seeds(ids).items()} == dict(expected)


WORDS = [f"w{k}" for k in range(400)]


def item(k):
    own = [f"{w}x{k}" if j % 3 == 0 else w for j, w in enumerate(WORDS[:80])]
    sentences = [" ".join(own[a : a + 20]).capitalize() + "." for a in range(0, 80, 20)]
    return own, ("Read this case. " if k % 2 else "") + " ".join(sentences) + "\n\nQuestion: What is it?\nAnswer: Nothing at all."


def test_leaks(spark):
    items = [(k, "t", item(k)[1]) for k in range(6)]
    own = item(2)[0]
    noise = "other words stand here and there. " * 40
    altered = [("zz" if j % 8 == 3 else w) for j, w in enumerate(own)]
    docs = [
        (1, noise + " ".join(own) + noise),
        (2, noise + " ".join(own[:36]).upper() + noise),
        (3, noise + " ".join(own[:20])),
        (4, " ".join(own[:18]) + noise + " ".join(own[40:60])),
        (5, " ".join(altered)),
        (6, " ".join(w for j, w in enumerate(WORDS[:80]) if j % 3)),
        (7, "Question: What is it? Answer: Nothing at all. Read this case."),
        (8, "<p>" + "</p>\n<p>".join(" ".join(own[a : a + 7]) for a in range(0, 80, 7)) + "</p>"),
        (9, None),
        (10, ""),
        (11, "y " * 300_000 + " ".join(item(5)[0])),
        (1, noise + " ".join(own) + noise),
        (12, " ".join(item(1)[0] + item(4)[0])),
    ]
    df = spark.createDataFrame([(i, t, 3, "c") for i, t in docs], "doc_id bigint, text string, item_id int, coverage string")
    table = spark.createDataFrame([*items, items[2], (77, "t", None), (78, "t", "")], "item_id bigint, topic string, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, table).collect())
    assert got == [(1, 2), (2, 2), (4, 2), (5, 2), (8, 2), (11, 5), (12, 1), (12, 4)]
    for size in (10, 2000, 8_000_000):
        blocks = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, table, block_bytes=size).collect())
        assert blocks == got
    cleaned = leakage.cleaned_documents(df, table).collect()
    assert len(cleaned) == len(docs)
    for (i, t), r in zip(sorted(docs, key=str), sorted(cleaned, key=lambda r: str((r["doc_id"], dict(docs)[r["doc_id"]])))):
        assert r["doc_id"] == i and (r["n_spans"] > 0) == (i in {d for d, _ in got})
        assert (r["text"] == t) if not r["n_spans"] else len(r["text"]) + r["n_removed"] == len(t)
    assert {r["doc_id"]: r["text"] for r in cleaned}[1] == noise + " w79" + noise
    assert leakage.leaked_passages(df.filter("false"), table).count() == 0
    assert leakage.leaked_passages(df, table.filter("false")).count() == 0


@pytest.mark.parametrize("users", [1, 2, 3, 50])
def test_passages_that_many_items_share(spark, users):
    own = item(3)[0]
    passage = " ".join(" ".join(own[a : a + 20]).capitalize() + "." for a in range(0, 80, 20))
    near = passage.replace("w41", "other").replace("w62", "else")
    items = [(k, f"Read this case. {passage}\n\nQuestion: What is thing {k}?\nAnswer: It is {k}.") for k in range(users)] + [(100, "Read this case. " + near + " Is it? No.")]
    items += [(200 + k, item(10 + k)[1]) for k in range(5)]
    docs = spark.createDataFrame([(1, "Before that. " + passage + " After it."), (2, "Read this case. " + " ".join(WORDS[:80:3]))], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.leaked_passages(docs, table).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, k) for k in [*range(users), 100]]
    assert all(r["spans"][0]["begin"] == 13 for r in found if r["item_id"] < 100)
    assert leakage.cleaned_documents(docs, table).filter("doc_id = 1").first()["text"] == "Before that. . After it."


LINES = [" ".join(f"s{k}w{j}" for j in range(12)) for k in range(10)]
ASKED = "\n\nQuestion: What is it?\nAnswer: Nothing at all."


@pytest.mark.parametrize(
    "begin, joined, end",
    [
        ("", ". ", "." + ASKED),
        ("It measures 3.5 by 2.5 by 1.5 m. ", ". ", "." + ASKED),
        ("Why so? See http://x.example/a.php?id=3 first. ", ". ", "." + ASKED),
        ("Why so? ", ". ", ". What is it? Nothing at all."),
        ("Q1: five.\nQ2: six.\n", ". ", ". What is it? Nothing at all."),
        ("", ". ", ASKED),
        ("", "\n", ASKED + ASKED),
        ("", "。", "。" + ASKED),
        ("", ". ", ".\n\nQuestion: Name it.\nAnswer: Nothing, is it? No."),
        ("", ". ", ""),
    ],
)
def test_passages_are_whole(begin, joined, end):
    text = begin + joined.join(LINES) + end
    assert leakage.passages([(1, text)]) == {tuple(leakage.words(begin + " ".join(LINES))): [1]}


def test_leaks_of_the_end_of_a_long_passage(spark):
    items = [(1, ". ".join(LINES) + "." + ASKED), (2, item(2)[1])]
    docs = [(1, "Before that. " + ". ".join(LINES[5:]) + ". After it."), (2, ". ".join(LINES[:3]) + "."), (3, ". ".join(LINES) + ".")]
    found = leakage.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in found) == [(1, 1, 0.5), (3, 1, 1.0)]


def test_instructions_and_alignment_of_long_texts():
    random.seed(8)
    text = [random.choice(WORDS[:200]) for _ in range(4000)]
    assert leakage.passages([(1, ". ".join(text))]) == {tuple(text): [1]}
    finder = leakage.Finder(leakage.Automaton({0: text}).arrays({0: [True] * len(text)}, 3), {0: [1]}, 3, 0.36, 0.75)
    document = " ".join(["before"] * 5 + text[2000:])
    [(found, coverage, spans)] = finder.find(document)
    assert found == 1 and 0.5 <= coverage < 0.51 and (35, len(document)) in spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abßİ́é\u00adﬁ =-&;<p>\n 한Ⅳ", max_size=40))
def test_places_of_words(text):
    found, places = leakage.words(text), leakage.word_places(text)
    assert len(found) == len(places) and all(0 <= a < b <= len(text) for a, b in places)


# --- 9 -----------------------------------------------------------------------------------


def test_prefixes_against_brute_force(spark):
    random.seed(6)
    long = "x" * 450
    values = [None, "", *("".join(random.choices("ab", k=random.randrange(1, 9))) for _ in range(300)), *["hot"] * 200, "hotter", long, long + "a", long + "ab", *["word"] * 3, "words"]
    rows = [(v, i % 3 > 0, i % 4 != 1, i) for i, v in enumerate(values)]
    whole = {v for v, _, w, _ in rows if v is not None and w}
    expected = {v for v, a, _, _ in rows if v is not None and a and any(x != v and x.startswith(v) for x in whole)}
    df = spark.createDataFrame(rows, "value string, asked boolean, whole boolean, part int")
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [r["value"] for r in prefixes.values_with_longer(df).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert prefixes.values_with_longer(df.filter("false")).count() == 0


def test_classes_are_attached_once(spark):
    members = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(6000)], "uid bigint, value string")
    classes = spark.createDataFrame([("hot", 20000, 1), *((f"k{k}", 60, k) for k in range(40))], "value string, n int, mark int")
    got = {r["uid"]: r["mark"] for r in attach_classes(members, classes, "value", "n", "uid").collect()}
    expected = {i: 1 if i % 3 == 0 else None if i % 7 == 0 or i % 50 >= 40 else i % 50 for i in range(6000)}
    assert got == expected


WHOLE = [
    "A sentence.", "Really? “Yes.”", "He said (quietly).", "Fin.\n\n", "- one item\n- another item", "1. first\n2. second", "| a | b |\n|---|---|\n| 1 | 2 |", "```\ncode\n```",
    "Text.\nSee also: https://a.example/b-c", "Text.\n\nTags: one, two", "Text.\nScore: 35/100", "Thanks\n– build team", "Text.\nSigned: design guild", "Text.\nKind regards,\nthe design guild", "Viele Grüße\nTeam Nord", "Hello World", "Our Story\n\nWelcome to the shop", "a,b,c\n1,2,3",
    "2026-01-02 10:00 crawl begun\n2026-01-02 10:05 crawl of the second host of the night done", "<p>done</p>", "文章在这里结束。", "Wait… what?", "1 &lt; 2 is fine.",
]
CUT = [
    "A sentence that stops in the mid", "Text.\nIt goes on with a sentence that sto", "a <img src=\"data:" + "x" * 900, "a <a href='/x' title='" + "many words " * 90, "a <!-- note " + "word " * 300, "A sentence, then", "It ends with a comma,", "dropped here…", "dropped here...", "word [truncated]", "word\n[message clipped]", "word (1053 more characters)", "so … read more",
    "part\n<!-- rest left out -->", "left</p", "made <a hre", 'made <div class="no', "and &nbs", "soft=", "caf�", "```\ncode", "| a | b", "text. <b>", "[link](http://a", "Score: 97/10", "“I bought the",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_endings(text):
    e = truncation.ending(text)
    assert (e.status, e.form) in ((truncation.WHOLE, None), (truncation.OPEN, truncation.WHOLE))


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    e = truncation.ending(text)
    assert (e.status, e.form) in ((truncation.CUT, None), (truncation.OPEN, truncation.CUT))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.,:;-|`<>&[]()…#/ \n1–", min_size=1, max_size=40))
def test_endings_never_fail(text):
    if text.strip():
        assert truncation.ending(text)[0] in (truncation.WHOLE, truncation.CUT, truncation.OPEN)


def test_truncation_table(spark):
    base = "First line here.\n- let the table have a header row\n- name the button"
    docs = [
        (1, "s", "Whole sentence."), (2, "s", "It is an unfinished and lonely senten"), (3, None, None), (4, "s", ""), (5, "s", " \n "), (6, "s", base + " after its action\n- last item"),
        (7, "s", base), (8, "s", "Text.\n- let the table ha"), (9, "s", "Text.\n- let the table have a header row"), (10, None, "A long one. " * 30_000), (2, "s", "It is an unfinished and lonely senten"),
        (11, "s", "Text.\nSee https://a.example/x"), (12, "s", "Text.\nSee https://a.example/xyz and more.\nEnd."),
        *((20 + k, "s", f"Text {k ** 9}.\n\nSigned: design guild") for k in range(4)), (24, "s", "Text.\n\nSigned: design gui"),
        (13, "s", "Other text.\nTags: one, two"), (14, "s", "Other text.\nTags: one, two  \nSigned: me"),
        (30, "s", "It weighs 17 grams less than the other one. End."), (31, "s", "Text. It weighs 250 gra"), (32, "s", "Nothing else, and 3 grams le"), (33, "s", "Much of it, and 4 grams less."),
        (34, "s", "It weighs 18"), (35, "s", "Garden Chairs"), (36, "s", "Text.\n\nGarden Chairs\n\nMore text."), (37, "s", "Garden Chairs of wood are here."),
        *((40 + k, "s", f"Text {k ** 9}.\nYours,\nthe catalog team") for k in range(4)), (44, "s", "Text.\nYours,\nthe catalog te"),
    ] + [(100 + k, "limited", "y " * 19 + "yk") for k in range(4)] + [(200, "limited", "Words here.\n- an item of its own w itself"[:40]), (201, "free", "Words here.\n- an item of its own w itself"[:40])]
    df = spark.createDataFrame([(i, t, s, 1, True) for i, s, t in docs], "doc_id bigint, text string, source string, status int, is_cut boolean")
    rows = truncation.truncation(df)
    found = rows.collect()
    why = {r["doc_id"]: r["reason"] for r in found}
    cut = sorted(r["doc_id"] for r in found if r["is_cut"])
    assert len(found) == len(docs) - 3
    assert cut == [2, 2, 7, 8, 11, 24, 31, 32, 34, 44, 100, 101, 102, 103, 200]
    assert [why[i] for i in (2, 7, 8, 31, 32, 34, 44, 200, 1, 35)] == ["ending", "copy", "copy", "copy", "clause", "copy", "copy", "limit", None, None]
    shares = {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.by_source(rows).collect()}
    assert shares["limited"] == (5, 5) and shares["free"] == (1, 0) and shares[None] == (1, 0)
    assert truncation.truncation(df.filter("false")).count() == 0
