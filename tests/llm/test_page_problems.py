"""Problems 1 to 3 and 5, all on html."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge.llm import encodings, markup, residue, splitting, stuffing

SENTENCE = "We wrote this page by hand because people kept asking how the lamp is cleaned. "
PAGES = "page_id bigint, host string, html string, fetch_error string, share double, n bigint, text string"


def pages(spark, rows):
    """Pages with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, h, html, e, 0.5, 7, "t") for i, h, html, e in rows], PAGES)


def empty(spark):
    return spark.createDataFrame([], PAGES)


def body(inner):
    return f"<html><head><title>Lamps</title></head><body><nav><a href='/'>cheap lamps, cheap lamps</a></nav><main>{inner}</main></body></html>"


LAMPS = ["desk lamp", "wall lamp", "oak stool", "tin mug", "felt rug"]
STUFFED = ", ".join(f"{w} {LAMPS[k % 5]} {t}" for k, (w, t) in enumerate((w, t) for w in ("cheap", "best", "buy") * 2 for t in ("here", "Leeds", "Hull", "Bath", "York", "Kent")))


def test_stuffed_pages(spark):
    links = "".join(f"<li><a href='/{k}'>cheap {LAMPS[k % 5]} Leeds</a></li>" for k in range(40))
    rows = [
        (1, "a", body(f"<p>{STUFFED}</p>"), None),
        (2, "a", body(f"<p>{SENTENCE * 5}</p>"), None),
        (3, "a", body(f"<ul>{links}</ul>"), None),
        (4, "a", body(f"<ul>{links}</ul><p>{SENTENCE * 30}</p>"), None),
        (5, "a", body(f"<p>{SENTENCE}</p><div style='display:none'>{STUFFED}. {STUFFED}.</div>"), None),
        (6, "a", body("".join(f"<img alt='cheap {x} Leeds, {x} York'>" for x in LAMPS * 5)), None),
        (7, "a", body(f"<p>{'Cheap desk lamp! Best desk lamp! Desk lamp Leeds! ' * 12}</p>"), None),
        (8, "a", body("<div class=c>" + " ".join(f"<span>#desklamp{k}</span>" for k in range(50)) + "</div>"), None),
        (9, "a", None, None),
        (10, "a", "", None),
        (11, "a", body("<p>wall lamp, oak stool</p>"), None),
        (12, None, body(f"<p>{STUFFED}</p>"), None),
        (12, None, body(f"<p>{STUFFED}</p>"), None),
        (13, "a", body("<p>" + "x " * 200_000 + "</p>"), None),
        (14, "a", body("<p>" + " ".join(["buy cheap desk lamp Leeds wall lamp York"] * 12) + ".</p>"), None),
    ]
    got = [r["page_id"] for r in stuffing.stuffed_pages(pages(spark, rows)).filter("stuffed").collect()]
    assert sorted(got) == [1, 3, 5, 6, 7, 8, 12, 12, 13, 14]
    assert stuffing.stuffed_pages(empty(spark)).count() == 0


def test_word_salad_is_less_coherent_than_prose(spark):
    rng = random.Random(5)
    nouns, verbs, places = [f"noun{k}" for k in range(30)], [f"verb{k}" for k in range(30)], [f"place{k}" for k in range(30)]

    def sentence():
        k = rng.randrange(30)
        return f"The {nouns[k]} of our shop {verbs[k]} every day near the {places[k]} by the river."

    everything = [*nouns, *verbs, *places, "the", "of", "our", "shop", "every", "day", "near", "by", "river"]
    prose = [(k, "a", body("".join(f"<p>{sentence()}</p>" for _ in range(12))), None) for k in range(80)]
    salad = [(100 + k, "a", body("<ul>" + "".join(f"<li>{rng.choice(everything)}</li>" for _ in range(80)) + "</ul>"), None) for k in range(5)]
    df = pages(spark, prose + salad)
    scored = {r["page_id"]: r["reason"] for r in stuffing.stuffed_pages(df).collect()}
    assert scored == {100 + k: "salad" for k in range(5)}
    # without the test for prose every page is scored, and coherence alone tells them apart
    alone = stuffing.stuffed_pages(df, share=0.0)
    assert alone.count() == 85 and {r["page_id"] for r in alone.filter("reason = 'salad'").collect()} == set(scored)
    templates = body("<p>%TITLE% %NAME%</p>" + "".join(f"<p>{{{{ item.word_{k} }}}} {{{{ item.other_{k} }}}}</p>" for k in range(30)))
    assert stuffing.stuffed_pages(pages(spark, [*prose, (1, "a", templates, None)])).count() == 0


def test_mean_pmi_against_brute_force(spark):
    from collections import Counter
    from math import log

    texts = {1: "red lamp red lamp blue mug " * 10, 2: "a b c d e f g h red lamp " * 4}
    df = pages(spark, [(i, "h", f"<p>{t}</p>", None) for i, t in texts.items()])
    words = {i: t.split() for i, t in texts.items()}
    uni, bi = Counter(w for x in words.values() for w in x), Counter(p for x in words.values() for p in zip(x, x[1:]))
    def pmi(p, n):
        return log(n / sum(bi.values()) / (uni[p[0]] / sum(uni.values()) * uni[p[1]] / sum(uni.values())))

    def level(p):
        return tuple(uni[w].bit_length() for w in p)

    by_level = {}
    for p, n in bi.items():
        by_level.setdefault(level(p), []).append((n, pmi(p, n)))
    usual = {k: sum(n * x for n, x in v) / sum(n for n, _ in v) for k, v in by_level.items()}
    found = stuffing.stuffed_pages(df, least=1).collect()
    assert len(found) == 2
    for r in found:
        own = Counter(zip(words[r["page_id"]], words[r["page_id"]][1:]))
        elsewhere = {p: pmi(p, max(bi[p] - k, 0.5)) for p, k in own.items()}
        assert r["mean_pmi"] == pytest.approx(sum(k * elsewhere[p] for p, k in own.items()) / sum(own.values()))
        assert r["coherence"] == pytest.approx(sum(k * (elsewhere[p] - usual[level(p)]) for p, k in own.items()) / sum(own.values()))


def test_prose_in_other_scripts():
    cjk = markup.Block("这是一个关于台灯清洁方法的页面。我们每天都会检查内容。", "p", "", 0, False, False)
    assert stuffing.is_prose(cjk)


WRONG = ["cp1252", "latin-1", "cp1251", "cp1250", "iso8859-15", "cp437", "cp850", "mac-roman", "koi8-r"]
TEXTS = [
    "Le café de l’équipe a été rénové près du château, où l’on déjà sert.",
    "Für größere Mengen können wir über Nacht prüfen und ändern.",
    "Описание товара читается лучше всего, поэтому оценка снизилась.",
    "La corrección se publicó mañana, también en otoño.",
]


@pytest.mark.parametrize("wrong", WRONG)
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(wrong, text):
    page = f"<html><body><p>{text}</p></body></html>"
    garbled = misread(page.encode("utf-8"), wrong)
    text_, layers, _, whole = encodings.restore(garbled)
    assert (text_, layers, whole) == (page, 1, True)
    twice = misread(garbled.encode("utf-8"), wrong)
    again = encodings.restore(twice)
    assert again and again[0] == page


def test_single_byte_misreadings():
    russian = "Описание товара читается лучше всего, поэтому оценка снизилась вчера."
    for right, wrong in (("cp1251", "latin-1"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
        got = encodings.restore(f"<p>{russian.encode(right).decode(wrong)}</p>")
        assert got and got[0] == f"<p>{russian}</p>", (right, wrong, got)
    french = "vérifié après préparé déjà"
    assert encodings.restore(french.encode("cp1252").decode("mac-roman"))


def test_references_and_losses():
    assert encodings.restore("<p>caf&#195;&#169; cr&#195;&#168;me</p>")[0] == "<p>café crème</p>"
    lost = encodings.restore("<p>caf�</p>")
    assert lost[0] == "<p>caf�</p>" and lost[3] is False


@pytest.mark.parametrize("text", ["", "plain", "&eacute;t&eacute; &#233; &copy; &amp;", *TEXTS, "Её дом. ВНИМАНИЕ", "中文网页", "日本語のテキスト", "Ελληνικά", "עברית", "हिन्दी", "Łódź żółć", "x² + y³ ≤ 5 °C ±1 µm", "#bikepumpкупитьJorvale #ценаdesklamp #woolblanketдёшевоLeeds", "L’ÉTÉ, ATENÇÃO, CŒUR “œuvre”"])
def test_sound_text_is_left_alone(text):
    assert encodings.restore(f"<p>{text}</p>") is None


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_restore_never_fails(text):
    encodings.restore(text)


def test_garbled_table(spark):
    rows = [(1, "h", "<p>cafÃ©</p>", None), (1, "h", "<p>cafÃ©</p>", None), (2, "h", None, None), (3, "h", "", None), (4, None, "<p>café</p>" * 20_000, None), (None, "h", "<p>�</p>", None)]
    got = [(r["id"], r["restored"]) for r in encodings.garbled(pages(spark, rows), "page_id", "html").collect()]
    assert sorted(got, key=str) == sorted([(1, "<p>café</p>"), (1, "<p>café</p>"), (None, "<p>�</p>")], key=str)
    assert encodings.garbled(empty(spark), "page_id", "html").count() == 0


def misread(data, wrong):
    """Bytes as text under a single-byte encoding, undefined bytes read as control characters."""
    return "".join(encodings._DECODE[wrong][b] if b > 127 else chr(b) for b in data)


MANY = [
    ("Ми написали цю сторінку, щоб пояснити, як її чистити. Лампа стоїть біля вікна і світить.", "cp1251:latin-1 cp1251:cp1252 utf-8:cp1252 utf-8:cp1251 koi8-u:latin-1"),
    ("Γράψαμε αυτή τη σελίδα για να εξηγήσουμε πώς καθαρίζεται η λάμπα.", "iso8859-7:latin-1 utf-8:cp1252 utf-8:latin-1"),
    ("Napisaliśmy tę stronę, żeby wyjaśnić, jak czyścić lampę. Światło świeci, więc można czytać książkę.", "cp1250:latin-1 iso8859-2:latin-1 cp1250:cp1252 utf-8:cp1252"),
    ("Chúng tôi viết trang này để giải thích cách lau đèn. Ánh sáng chiếu suốt buổi tối.", "utf-8:cp1252 utf-8:latin-1"),
    ("このページはランプの掃除の方法を説明するために書きました。", "cp932:latin-1 euc_jp:latin-1 utf-8:latin-1"),
    ("我们写这一页是为了说明如何清洁这盏灯。灯光可以持续整个晚上。", "gb2312:latin-1 utf-8:cp1252"),
    ("이 페이지는 램프를 닦는 방법을 설명하기 위해 작성되었습니다.", "cp949:latin-1"),
    ("Bu sayfayı lambanın nasıl temizlendiğini açıklamak için yazdık. Işığı bütün akşam sürüyor.", "cp1254:latin-1 utf-8:cp1252"),
]


@pytest.mark.parametrize("text, ways", MANY)
def test_other_languages_come_back(text, ways):
    page = f"<p>{text}</p>"
    assert encodings.restore(page) is None
    for way in ways.split():
        right, wrong = way.split(":")
        got = encodings.restore(misread(page.encode(right), wrong))
        assert got and got[0] == page, (way, got)


def test_residue(spark):
    rows = [
        (1, "a", body("<h1>{{ page.title }}</h1><p>text</p>"), None),
        (2, "a", body("<script>var a='{{x}}'</script><template>{{y}}</template><pre><code>{{z}} ${w}</code></pre><p>Fine.</p>"), None),
        (3, "a", body(f"<p>{SENTENCE}</p><p>Your headline goes here.</p>"), None),
        (4, "a", body("<h1>Access denied.</h1><p>Access denied.</p>"), None),
        (5, "a", body(f"<p>{SENTENCE * 4}</p><p>Access denied.</p>"), None),
        (6, "a", "<html><head><title>Shop</title></head><body><noscript>You need to enable scripts to run this app.</noscript><div id='root'></div></body></html>", None),
        (7, "a", body("<p>Lorem ipsum velit magna dolor. Sint culpa quis amet.</p>"), None),
        (8, "a", None, "status 500"),
        (9, "a", None, "status ${code}: failed"),
        (10, "a", None, "status 502: Too many requests. Slow down."),
        (11, None, None, "<div>Página não encontrada.</div>"),
        (12, "a", "", ""),
        (13, "a", None, None),
        (4, "a", body("<h1>Access denied.</h1><p>Access denied.</p>"), None),
        (14, "a", body("<p>Dolor is a word, and this is an ordinary sentence about a magna carta.</p>"), None),
        (15, "a", body("<input placeholder='{{x}}'><p>Read the guide.</p>"), None),
        (16, "a", body(f"<p>{'y' * 300_000}</p>"), None),
        (17, "a", "<html><head><title>[Insert article name here] | Shop</title></head><body><p>" + SENTENCE + "</p></body></html>", None),
        (18, "a", body("<p>No encontramos esta página.</p>"), None),
    ]
    found = residue.residue(pages(spark, rows)).collect()
    assert len({(r["page_id"], r["field"]) for r in found}) == len(found)
    assert {r["page_id"]: r["reason"] for r in found} == {1: "template", 3: "template", 4: "phrase", 6: "phrase", 7: "template", 9: "template", 10: "phrase", 11: "phrase", 17: "template", 18: "phrase"}
    assert residue.residue(empty(spark)).count() == 0
    assert residue.clean_pages(pages(spark, rows), residue.residue(pages(spark, rows))).filter("page_id in (1, 4)").count() == 0


def test_weak_cues_need_recurrence(spark):
    text = body("<p>The robot check could not load.</p>")
    alone = pages(spark, [(1, "a", text, None), (2, "a", text, None)])
    spread = pages(spark, [(1, "a", text, None), (2, "b", text, None), (3, "c", text, None)])
    assert residue.residue(alone).count() == 0
    assert residue.residue(spread).count() == 3


def test_recurrence_in_any_language(spark):
    strange = body("<h1>Tämä sivu ei ole käytettävissä juuri nyt.</h1><p>Yritä myöhemmin uudelleen, koodi 17.</p>")
    few = pages(spark, [(k, f"h{k % 4}", strange, None) for k in range(9)])
    many = pages(spark, [(k, f"h{k}", strange.replace("17", str(k)), "certificate has expired") for k in range(9)])
    assert residue.residue(few).count() == 0
    found = residue.residue(many).collect()
    assert sorted(tuple(r) for r in found) == [(k, "html", "recurrence") for k in range(9)]
    article = pages(spark, [(k, f"h{k}", body(f"<p>{SENTENCE * 4}</p>"), None) for k in range(9)])
    assert residue.residue(article).count() == 0


def test_long_notices(spark):
    trace = "Fatal error: Uncaught exception in the page. " + " ".join(f"at shop.Cart.load(Cart.java:{k})" for k in range(80))
    lines = "<br>".join(f"Access denied. Ref {c}" for c in "abcdefghijklmnopq")
    long_mark = "{{ " + "very_long_name." * 30 + "x }}"
    prose = "This page is about sites under maintenance. " + SENTENCE * 20
    rows = [(1, "a", body(f"<pre>{trace}</pre>"), None), (2, "a", body(f"<div>{lines}</div>"), None), (3, "a", None, trace), (4, "a", body(f"<p>{long_mark}</p>"), None), (5, "a", body(f"<p>{prose}</p>"), None)]
    assert {r["page_id"]: r["reason"] for r in residue.residue(pages(spark, rows)).collect()} == {1: "phrase", 2: "phrase", 3: "phrase", 4: "template"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}%_@[]<> todxlorem ipsumhere.ABgsc$#", max_size=50))
def test_cues_lose_no_match(text):
    block = markup.clean(text)
    plain = bool(residue.PLACEHOLDER.search(block) or residue.FILLER.search(block))
    assert not plain or residue.has_residue(block)


def test_blocks_are_linear_and_forgiving():
    assert markup.blocks("<p>a<p>b</div></p>c<script>x") == [markup.Block("a", "p", "", 0, False, False), markup.Block("b", "p", "", 0, False, False), markup.Block("c", "p", "", 0, False, False)]
    assert markup.blocks("<" * 50_000) != [] and markup.blocks("") == []
    assert [b.region for b in markup.blocks("<nav>a<footer>b</nav>c")] == ["nav", "nav", ""]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n.<p>/€", min_size=0, max_size=900), st.integers(60, 200), st.integers(0, 40))
def test_pieces_make_the_text(text, capacity, overlap):
    data = text.encode()
    pieces = splitting.cut(text, capacity, overlap)
    joined = b""
    for k, (a, b, o, _) in enumerate(pieces):
        piece = data[a:b]
        piece.decode()
        assert len(piece) <= capacity
        assert (o == 0) if k == 0 else overlap <= o <= overlap + 3
        joined += piece[o:]
    assert joined == data
    assert len(pieces) == 1 or len(data) > capacity


def test_cuts_fall_on_blocks():
    page = "".join(f"<section><p>{SENTENCE * 3}</p></section>\n" for _ in range(60))
    kinds = [kind for *_, kind in splitting.cut(page, 4096, 128)]
    assert kinds[-1] == "end" and set(kinds[:-1]) <= {"section", "block"}


def test_split_table(spark):
    budgets = spark.createDataFrame([(1, "split", "utf8_bytes", 300, 20), (2, "split", "utf8_bytes", 100, None), (3, "pack", "tokens", 10, 0)], "budget_id int, purpose string, measure string, capacity int, overlap int")
    rows = [(1, "h", "x" * 300, None), (2, "h", "é" * 151, None), (3, "h", None, None), (4, "h", "", None), (5, "h", "y" * 50, None), (2, "h", "é" * 151, None)]
    got = splitting.split_oversized(pages(spark, rows), budgets, "page_id", "html")
    assert sorted((r["budget_id"], r["id"]) for r in got.filter("piece_no = 0").collect()) == [(1, 2), (1, 2), (2, 1), (2, 2), (2, 2)]
    assert got.agg(F.max(F.octet_length("piece"))).first()[0] <= 300
    assert splitting.split_oversized(empty(spark), budgets, "page_id", "html").count() == 0
    assert splitting.split_oversized(pages(spark, rows), budgets.filter("false"), "page_id", "html").count() == 0
    with pytest.raises(ValueError):
        splitting.cut("x" * 100, 30, 20)
