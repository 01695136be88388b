import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fixtures_llm import SMALL, TEXTS, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactframe.llm import chat, langid, pages, pii, queries

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def checksum(digits):
    return sum(d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and checksum(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns(spark):
    import random
    rng = random.Random(5)
    parts = ["a", "b.", "@", "x", "1", "2", "9", "0", ".", "-", " ", "+", "(", ")", "%", "é", "🙂", "\n", "192.168.0.1", "4111 1111 1111 1111",
             "+1 (555) 123-4567", "a@b.co", "255", "256."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["x" * 50_000 + "@", "1" * 60_000, "1.2.3.4 " * 3_000, "a@" + "b.c" * 5_000, None, "", "0000255.1.1.1", "+" * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.base_spans(docs).select("doc_id", "spans").collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == base_spans(texts[r.doc_id])


def revealing():
    rows = [f"Contact Zorblatt vizier anna@x.org about the thing number {i} today friend" for i in range(4)]
    return rows + rows[:2] + [f"about the thing today friend words {'abcdefghij'[i % 10] * 5} more" for i in range(300)]


def test_terms_that_give_an_entity_away(spark):
    texts = revealing()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(texts)
    assert [a.word for a in rows[0].added] == ["Contact", "Zorblatt", "vizier", "number"]
    assert all(texts[i][a.start:a.end] == a.word for i, r in rows.items() for a in r.added)
    assert not any(rows[i].added for i in range(6, len(texts)))  # clean documents stay as they are
    clean = {r.doc_id: r.sanitised for r in pii.rewritten(docs, found).collect()}
    assert clean[0] == "   [EMAIL] about the thing  0 today friend" and clean[4] == clean[0] and clean[50] == texts[50]


def test_shares_match_brute_force(spark):
    texts = revealing() + ["mail bob@y.org about Quimby", "other bob@y.org Quimby thing", "Quimby alone here"]
    texts += [f"10.0.0.{i} anna@x.org" for i in range(20)]  # bare values: texts that hold an entity and no word
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = {(r.entity, r.term): r.share for r in pii.disclosures(docs, generalise_at=-99.0).collect()}
    got = dict(every)
    for least in (0.1, 0.5, 0.8):  # the bound before pairing loses nothing
        assert {(r.entity, r.term): r.share for r in pii.disclosures(docs, generalise_at=least).collect()} == {k: v for k, v in every.items() if v >= least}
    distinct = sorted(set(texts))
    words = {t: set(re.findall(r"(?<!\w)[^\W\d_]{4,}(?!\w)", t.lower())) for t in distinct}
    for entity, mark in (("email:anna@x.org", "anna@x.org"), ("email:bob@y.org", "bob@y.org")):
        holds = [t for t in distinct if mark in t]
        for term in {w for t in holds for w in words[t]} - {"anna"}:
            both = sum(term in words[t] for t in holds)
            n_t = sum(term in w for w in words.values())
            if both >= 2:
                share = np.log(len(distinct) * both / (len(holds) * n_t)) / np.log(len(distinct) / len(holds))
                assert got[(entity, term)] == pytest.approx(share)


def test_bare_values_count_for_their_entity(spark):
    texts = [f"192.168.1.9 {'x' * (i + 4)}" for i in range(3)] + ["192.168.1.9 zorblatt here", "192.168.1.9 there zorblatt", "zorblatt alone", "zorblatt again"]
    texts += [f"{i} 192.168.1.9" for i in range(50)] + [f"words of text {'ab' * i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    share = {r.term: r.share for r in pii.disclosures(docs, generalise_at=-99.0).collect()}["zorblatt"]
    n, n_e, n_t, both = len(set(texts)), 55, 4, 2
    assert share == pytest.approx(np.log(n * both / (n_e * n_t)) / np.log(n / n_e)) and share < 0.8


def test_personal_data_of_odd_rows(spark):
    assert pii.find(odd(spark)).count() == len(TEXTS)
    assert pii.find(odd(spark, empty=True)).count() == 0
    r = queries.op3_personal_data(spark, SMALL)
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for x in r.collect():
        want = base_spans(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, _, _ in want) for kind in BASE]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    rows = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    fold = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in fold]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    net = langid.fit(docs)
    rows = langid.predict(docs, net).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 4, 11, None}
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    nothing = odd(spark, empty=True)
    assert langid.fit(nothing) is None and langid.predict(nothing, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(1)
    net = langid.train(rng.integers(1, 255, (32, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 32), list("abc"), epochs=1)
    texts = [b"", b"x", bytes(rng.integers(1, 255, 1000).astype(np.uint8)), b"y" * langid.WINDOW]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, owner, size = langid.windows_of(data, offsets)
    assert size.sum() == len(data) and [int((owner == i).sum()) for i in range(4)] == [0, 1, 4, 1]
    fast = langid.predict_windows(net, data, start, size)
    slow = np.concatenate([r.max(1) for r in langid.responses(langid.cut(data, start, size), net.tables())], 1) + net.bias
    assert np.abs(fast - langid.softmax(np.maximum(slow, 0) @ net.dense + net.out)).max() < 1e-3


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("#\\h/turn<>: \nab"), max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape(text, True)) == text
    assert chat.CLOSE.strip() not in chat.escape(text) and "#" not in chat.escape(text)
    assert ":" not in chat.escape(text, True) and "\n" not in chat.escape(text, True)


def test_events_fold_into_messages(spark):
    log = [(1, "m1", 1, "start", "user", None), (1, "m1", 2, "delta", None, "Hel"), (1, "m1", 3, "delta", None, "lo"), (1, "m1", 3, "delta", None, "lo"),
           (1, "m2", 4, "start", "assistant", None), (1, "m2", 5, "delta", None, "wrong"), (1, "m1", 6, "edit", None, "Hi"), (1, "m2", 7, "regenerate", None, None),
           (1, "m2", 8, "delta", None, "right"), (1, "m1", 9, "delta", None, "!"), (None, None, 1, "delta", None, None), (2, "m1", 1, "start", None, "all at once")]
    events = spark.createDataFrame(log[::-1], "conv_id long, msg string, seq long, kind string, role string, text string")
    rows = chat.reconstruct(events).collect()
    assert sorted((str(r.conv_id), str(r.msg), r.position, r.role, r.text) for r in rows) == [
        ("1", "m1", 1, "user", "Hi!"), ("1", "m2", 4, "assistant", "right"), ("2", "m1", 1, "", "all at once"), ("None", "None", 1, "", "")]
    bad = spark.createDataFrame([(1, "m", 1, "erase", "user", "x")], events.schema)
    with pytest.raises(Exception, match="unknown event kind"):
        chat.reconstruct(bad).collect()


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "é\n### user: x </turn>\n", "x" * 1000, "\\h\\\\#"]
    rows = [(c, t, ["user", "assistant", None, "a:b\n#"][(c + t) % 4], texts[(c * 7 + t) % 6], "extra") for c in range(12) for t in range(c)]
    rows += [(50, 0, "user", "twice", "e"), (50, 0, "user", "twice", "e"), (50, None, "system", "no turn", "e"), (None, 0, "user", "no id", "e"), (None, 1, "assistant", "yes", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(chat.events_of(turns, delta_chars=7)))).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text, _ in rows if i == c), key=lambda x: x[0])
        assert r.n_turns == len(mine) and r.turns_sha256 == digest([m[1:] for m in mine])
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.render(chat.reconstruct(chat.events_of(turns.limit(0))))).count() == 0


LAYOUT = {
    "<p>a<p>b <b>c</b>d<br>e<ul><li>x<li>y<ul><li>z</ul><li>w</ul>tail": "a\n\nb cd\ne\n\n- x\n- y\n  - z\n- w\n\ntail",
    "<table><tr><th>Name<th>N<tr><td>apple<td>10<tr><td>fig &amp; co<td>7</table>after": "Name      N\napple     10\nfig & co  7\n\nafter",
    "<head><title>t</title><style>p{}</style></head><body>hi <span hidden>no</span><div style='display: none'>x</div><pre>\n a\n   b</pre>z": "hi\n\n a\n   b\n\nz",
    "<ol start=3><li>one<li>two</ol>": "3. one\n4. two",
    "<dl><dt>k<dd>v<dt>l<dd>w</dl>": "k\n    v\nl\n    w",
    "<table><tr><td>a<br>b<td>c<tr><td colspan=2>wide<td>x</table>": "a     c\nb\nwide     x",
    "<script>var t='</p>';</script>x<!-- no --><template>no</template>": "x",
    "plain < text &copy; more": "plain < text © more",
    "a<div>b</div>c<hr>d": "a\nb\nc\n---\nd",
    "<p>cut <a href='x": "cut",
    "<td>stray</td></table></p>": "stray",
    "": "", "<p></p>": "",
}


@pytest.mark.parametrize("html", list(LAYOUT))
def test_layout(html):
    assert pages.visible_text(html) == LAYOUT[html]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<br>", "<pre>", "</pre>", "<div>",
                                 "</div>", "word", " ", "<!--", "-->", "<a href=", "&lt;", "<", "<hr>", "<dl>", "<dd>", "<ol>", "</td>"]), max_size=30))
def test_no_markup_fails(parts):
    pages.visible_text("".join(parts))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("p div li td b span h1 section".split()), st.integers(0, 10**6)), max_size=25))
def test_every_visible_word_is_kept_in_order(parts):
    words = [f"w{n}" for _, n in parts]
    html = "".join(f"<{t}>{w} </{t}>" for (t, _), w in zip(parts, words))
    assert re.findall(r"w\d+", pages.visible_text(html)) == words


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, None, "<p>a<p>b", "x"), (3, "u", "<div>" * 3000 + "deep", "x"), (3, "u", "<div>" * 3000 + "deep", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((str(r.page_id), r.text, r.n_lines) for r in pages.extract(df).collect()), key=str)
    assert got == sorted([("1", None, 0), ("2", "", 0), ("None", "a\n\nb", 3), ("3", "deep", 1), ("3", "deep", 1)], key=str)
    assert pages.extract(df.limit(0)).count() == 0
    assert pages.extract(df.select("page_id", "url", "html", F.lit(1).alias("n_lines"))).count() == 5


TABLES = {
    "<table><tbody><td>a</table>": "a",
    "<table><td>a<td>b<tr><td>c</table>": "a  b\nc",
    "<table><tbody><form><tr><td>a<tr><td>b</form></table>z": "a\nb\n\nz",
    "<table><tbody><tr><td>a</tr>between<tr><td>b</table>": "between\n\na\nb",
    "<table><tbody><div>x<tr><td>y</div>w</table>": "x\n\nyw",
    "<table><tr><td>a</td></tr><table><tr><td>b</table>": "a\n\nb",
    "<table><colgroup><col>x<tr><td>1</table>": "x\n\n1",
    "<table hidden>seen<tr><td>no</table>": "seen",
}


@pytest.mark.parametrize("html", list(TABLES))
def test_parts_of_a_table_are_implied_and_nothing_in_it_is_skipped(html):
    assert pages.visible_text(html) == TABLES[html]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("table tbody thead tr td th caption form div ul li p b span colgroup /table /tbody /tr /td /form /div /p /ul".split()), max_size=30))
def test_every_word_around_table_tags_is_kept(tags):
    html = "".join(f"<{t}> w{n} " for n, t in enumerate(tags))
    assert sorted(re.findall(r"w\d+", pages.visible_text(html))) == sorted(f"w{n}" for n in range(len(tags)))


def test_terms_far_from_their_entity_and_short_ones(spark):
    far = " ".join(f"the thing today w{n % 9}" for n in range(60))
    rows = [f"Lee Quorl {i} {far} badge A1234 {far} lee@x.org, {i} {far} quorl" for i in range(3)]
    texts = rows + [f"about {far} and more {i}x" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(docs)
    got = {r.doc_id: r.added for r in found.collect()}
    for i in range(3):
        assert [a.word for a in got[i]] == ["Lee", "Quorl", "badge", "A1234", "quorl"]
        assert all(texts[i][a.start:a.end] == a.word for a in got[i])
    assert not any(got[i] for i in range(3, len(texts)))
    clean = {r.doc_id: r.sanitised.lower() for r in pii.rewritten(docs, found).collect()}
    assert not any(word in clean[i] for i in range(3) for word in ("lee", "quorl", "badge", "a1234"))


def test_words_that_touch_a_span_are_no_words(spark):
    rows = [(1, "né x4111 1111 1111 1111y anna@x.org \U0010ffffb"), (2, "1.2.3.4 " * 600 + "end"), (3, "plain Words words"), (4, "")]
    words = {r.doc_id: r.words for r in pii.words_of(pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string"))).join(
        pii.keyed(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "k1"), "k1").collect()}
    assert words == {1: ["né", "b"], 2: ["end"], 3: ["plain", "words"], 4: []}


SHOWN = {
    "<p>let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> hold": "let x= 1 2 hold",
    "<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>": "1 2\n3 4",
    "<svg><title>no</title><defs><text>no</text></defs><path d=''/><g><text>La<tspan>bel</tspan></text><text>two</text></g></svg>after": "Label\ntwo\nafter",
    "a<svg/>b<svg><path/><p>out</p>c": "ab\n\nout\n\nc",
    "<select><option>A<option selected>B</select>z": "A\nB\nz",
    "<textarea>\n<b>x</b> &amp; y\n  z</textarea>end": "<b>x</b> & y\n  z\nend",
}


@pytest.mark.parametrize("html", list(SHOWN))
def test_formulas_drawings_and_forms_are_shown(html):
    assert pages.visible_text(html) == SHOWN[html]


DEEP = "<div>" * 10_000


@pytest.mark.parametrize("html,text", [
    (DEEP + "<script>var secret=1</script><p style='display:none'>HIDDEN</p>shown", "shown"),
    (DEEP + "<style>.a{}</style><span hidden>no</span><b>one</b> two", "one two"),
    ("<b><p>" * 5_000 + "x", "x"), ("<table><tr><td>" * 1_000 + "x", "x"), ("<svg><g>" * 3_000 + "<text>x", "x"),
    ("<select><optgroup>" * 1_000 + "<option>x", "x"), ("<blockquote>" * 3_000 + "x", " " * 240 + "x"),
])
def test_pages_nested_without_end(html, text):
    assert pages.visible_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E</table>", "A  B  C\n   D  E"),
    ("<table><tr><td>A<td rowspan=0>B<tr><td>C<tr><td>D<td>E</table>", "A  B\nC\nD     E"),
    ("<table><tbody><tr><td rowspan=9>A<td>B<tbody><tr><td>C<td>D</table>", "A  B\nC  D"),
    ("<style>.x{display:none} p#a.b, #q{visibility:hidden}</style><p class='y x'>no<p id=a class='c b'>no<b style='visibility:visible'>shown</b>", "shown"),
    ("<style>@media print{p{display:none}} /* b{display:none} */ i{display:none}</style><p>one<b>two</b><i>no</i>", "onetwo"),
    ("<style>p{display:none}.s{display:block}</style><p>no<p class=s>yes<p style='display:inline'>yes", "yes\n\nyes"),
    ("<style>p{display:none!important}</style><p style='display:block'>no<div>yes", "yes"),
    ("<p style='display:nonexistent'>a<p style='--x: display:none'>b<p style='color:red;DISPLAY : none'>no", "a\n\nb"),
    ("<div style='visibility:hidden'>no<ul><li>no<li style='visibility:visible'>yes</ul>no</div>", "- yes"),
    ("<p hidden>no<p hidden style='display:block'>yes", "yes"), ("a   b", "a   b"),
    ("<div style='white-space:pre'>x  y\n z</div>", "x  y\n z"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol start=-1><li>a<li value=7>b<li>c</ol>", "-1. a\n7. b\n8. c"), ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
])
def test_pages_as_a_browser_shows_them(html, text):
    assert pages.visible_text(html) == text


def test_spanning_cells_stand_in_their_columns():
    rng = random.Random(6)
    for _ in range(200):
        rows = [[(rng.randrange(1, 4), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]
        filled, place, n = set(), {}, 0
        html = "<table>"
        for r, cells in enumerate(rows):
            html += "<tr>"
            c = 0
            for wide, deep in cells:
                while (r, c) in filled:
                    c += 1
                place[f"w{n}"] = r, c
                filled |= {(r + i, c + k) for i in range(deep) for k in range(wide)}
                html += f"<td colspan={wide} rowspan={deep}>w{n}"
                c, n = c + wide, n + 1
        lines = pages.visible_text(html).split("\n")
        columns = sorted({c for _, c in place.values()})
        widths = {c: max(len(w) for w, (_, x) in place.items() if x == c) for c in columns}
        want = ["  ".join(next((w for w, at in place.items() if at == (r, c)), "").ljust(widths[c]) for c in columns).rstrip() for r in range(len(rows))]
        assert lines == [line for line in want if line]


def test_words_are_sought_behind_the_choice_of_texts(spark, tmp_path):
    """Each branch runs the patterns on its own texts: never below the join that marks them."""
    rows = [(i, f"mail anna@x.org about zorblatt {i % 7}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    pii.base_spans(docs).select("doc_id", "k1", "k2", "spans").write.parquet(f"{tmp_path}/found")
    counted = pii.texts_with(docs, spark.read.parquet(f"{tmp_path}/found"))
    assert {r.term: r.n_t for r in counted.collect()} == {"mail": 7, "about": 7, "zorblatt": 7, **{str(i): 1 for i in range(7)}}
    plan = counted._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:|+-]*", line)[0]) for line in plan]
    for i, line in enumerate(plan):
        if "Join " in line:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert not any("regexp_extract_all" in x for x in plan[i + 1:below])
    assert any("regexp_extract_all" in x for x in plan)
