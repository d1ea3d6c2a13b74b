"""Main text of pages and surrogates of personal data."""

import html as entities
import re

import pyarrow.parquet as pq
import pytest

from tidelog.llm import html as H
from tidelog.llm import pii as P

KEY = b"test"

PAGES = [
    ("", ""), ("x", "x"), ("<p>a", "a"), ("a < b and c > d", "a < b and c > d"), ("<script>x", ""), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<html><body><nav>menu</nav><p>One long sentence, here it is.<p>Two &amp; three.<table><tr><td>c1<td>c2</table><div class='comments'><p>nice post, thanks!</div></body>", "One long sentence, here it is.\nTwo & three.\nc1\nc2"),
    ("<div id=cookie-notice>We use cookies.</div><div class=content><h2>T</h2><p>Hello <b>bold</b>  world,\n this is text.</p></div><form>Email <input></form>", "T\nHello bold world, this is text."),
    ("<article><header><h1>Title</h1></header><p>Text.</p><footer>f</footer></article><article class=comment><p>hi there, a comment longer than the text.</p></article>", "Title\nText."),
    ("<body><header>Site</header><main><h1>A</h1><p>First, of two.</p><aside>More</aside><p>Second&nbsp;&eacute; &#x41;&amp</p></main><footer>end</footer>", "A\nFirst, of two.\nSecond é A&"),
    ("<article><p><b>Bold para, one.<br><p>Para two, plain.</article>", "Bold para, one.\nPara two, plain."),
    ("<div class=has-sidebar><article><p>Kept, all of it.</p></article><div class=sidebar>side</div></div><section id=comments><article class=reply><p>Not this, ever.</p></article></section>", "Kept, all of it."),
    ("<body class='nav-open'><div class='alert'>Note!</div><p>Plain text, in the body.</p><article class='comments'>no</article></body>", "Plain text, in the body."),
    ("<p>x<!-- <p>no -->y</p><style>p{}</style><noscript>no</noscript>", "xy"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_articles_of_the_table_come_out_whole(spark, sf_dir):
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in H.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|div|article)\b[^>]*>", article)]
        want = "\n".join(b for b in parts if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_odd_pages(spark):
    rows = [(1, "u", None), (None, None, "<p>a"), (1, "u", "<div>" * 5000 + "deep"), (2, "v", "<" * 2000), (3, "w", '<p "' * 1000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    got = H.extract_text(df).collect()
    assert [r["text"] for r in got][:3] == ["", "a", "deep"] and len(got) == 5
    assert H.extract_text(df.limit(0)).count() == 0


TEXT = (
    "Mr. John Smith met Mrs Garcia; john.smith@example.co.uk called +49 30 1234567, (555) 123-4567. IBAN DE89 3704 0044 0532 0130 00 and "
    "GB82WEST12345698765432, 123-45-6789, 192.168.0.1, card 4111 1111 1111 1111. Later Anna Schmidt wrote to john.smith@example.co.uk; Иван Петров и Мария Иванова."
)


def test_entities_are_found_and_keep_their_kind():
    found = [(k, TEXT[a:b]) for a, b, k in P.find_entities(TEXT)]
    kinds = [k for k, _ in found]
    assert kinds == ["name", "name", "email", "phone", "phone", "iban", "iban", "ssn", "ip", "card", "name", "email", "name", "name"]
    new, _ = P.replaced(TEXT, KEY)
    again = P.find_entities(new)
    assert [k for _, _, k in again] == kinds
    for (a, b, k), (_, old) in zip(again, found, strict=True):
        assert new[a:b] != old
        if k in ("phone", "iban", "card", "ssn"):  # format stays
            assert re.sub(r"\d", "0", new[a:b][4:]) == re.sub(r"\d", "0", old[4:]) or k == "iban"
            assert len(new[a:b]) == len(old)
    values = {old: new[a:b] for (a, b, _), (_, old) in zip(again, found, strict=True)}
    assert len(set(values.values())) == len(values)
    assert values["John Smith"].split()[0] in P.GIVEN["latin", "m"] and values["Anna Schmidt"].split()[0] in P.GIVEN["latin", "f"]
    assert values["Иван Петров"].split()[0] in P.GIVEN["cyrillic", "m"]
    assert values["john.smith@example.co.uk"].endswith(".co.uk")
    assert P.replaced(TEXT, b"other")[0] != new


def test_permutations_are_one_to_one_without_fixed_points():
    for n in (2, 3, 10, 257, 1000):
        p = P.Permutation(KEY, "x", n)
        moved = [p.move(i) for i in range(n)]
        assert sorted(moved) == list(range(n)) and all(a != b for a, b in enumerate(moved))


def test_coreference_of_parts():
    a, b = P.surrogate("name", "John Smith", KEY), P.surrogate("name", "Smith", KEY)
    assert a.split()[1] == b
    assert P.surrogate("email", "a.b@site.com", KEY).split("@")[1] == P.surrogate("email", "c@site.com", KEY).split("@")[1]


def test_clean_texts_stay(spark):
    clean = ["v1.2.3.4 2020-01-01 10.5.3 1234567890123456789012", "order 4111111111111112 at 12:30", "Anna and the others", "", None, "e-mail me @ home", "1.2.3.4.5"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(clean)], "doc_id long, text string, n_entities int")
    got = sorted(tuple(r) for r in P.pseudonymize(docs, key=KEY).collect())
    assert got == [(i, t, 0, "") for i, t in enumerate(clean)]
    assert P.pseudonymize(docs.limit(0), key=KEY).count() == 0


def test_surrogates_are_distinct_over_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    many = spark.createDataFrame([(i, f"mail u{i}@mail{i % 7}.example.com or +1 (212) 555-{i:04d} at 10.0.{i // 256}.{i % 256}") for i in range(2000)], "doc_id long, text string")
    table = P.entity_table(docs.union(many), KEY)
    assert P.collisions(table).isEmpty() and table.count() >= 6000
    bad = spark.createDataFrame([("ip", "1", "3"), ("ip", "2", "3"), ("ip", "4", "4")], "kind string, value string, surrogate string")
    assert P.collisions(bad).count() == 2


def test_names_of_any_script(spark):
    names = ["Ž", "Łś", "Աննա", "Đặng", "Ça", "çA", "ẞa", "李", "ŉ", "ʼn", "ΐ", "אבג", "A", "Ğ", "Ø", "İz", "ǅur"]
    docs = spark.createDataFrame([(i, f"Dr {n} kam heute") for i, n in enumerate(names)], "doc_id long, text string")
    got = sorted(P.pseudonymize(docs, key=KEY).collect())
    assert P.collisions(P.entity_table(docs, KEY)).isEmpty()
    for n, r in zip(names, got, strict=True):
        assert r["n_entities"] == (n[:1].isupper()) and (n in r["text"].split()) == (r["n_entities"] == 0)
    lower = [chr(i) for i in range(97, 0x600) if P.letters_like(chr(i))]
    values = list(dict.fromkeys(lower + [P._capital(c) for c in lower if P._capital(c)] + [a + b for a in lower[:80] for b in lower[:80]]))
    new = [P.surrogate("name", v, KEY) for v in values]
    assert len(set(new)) == len(values) and all(a != b for a, b in zip(values, new, strict=True))
    assert all(len(b) == 24 or len(a) == len(b) and [c.isupper() for c in a] == [c.isupper() for c in b] for a, b in zip(values, new, strict=True))


def test_surrogates_need_a_key(spark):
    with pytest.raises(ValueError):
        P.key_of(spark)
    spark.conf.set("tidelog.pii.key", "a secret of the tests")
    try:
        assert len(P.key_of(spark)) == 32
    finally:
        spark.conf.unset("tidelog.pii.key")


def test_replacement_against_plain_substitution(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "mail a.b@c.de"), (7, None), (7, "call (555) 123-4567"), (7, "call (555) 123-4567"), (10**6, "")], docs.schema)
    both = docs.union(odd)
    got = sorted(map(repr, P.pseudonymize(both.selectExpr("*", "1 AS found", "2 AS id"), key=KEY).collect()))
    want = []
    for r in both.collect():
        text, at, out = r["text"] or "", 0, ""
        entities = P.find_entities(text)
        for a, b, k in entities:
            out += text[at:a] + P.SURROGATES[k](text[a:b], KEY)
            at = b
        new = None if r["text"] is None else out + text[at:]
        want.append(f"Row(doc_id={r['doc_id']!r}, text={new!r}, n_entities={len(entities)}, entities={','.join(f'{k}:{a}:{b}' for a, b, k in entities)!r})")
    assert got == sorted(want)


def test_gate_lets_every_entity_through(spark):
    texts = ["call +33 6 12 34 56 78 now", "+49 30 12 34 56 78", "+1 (2) 34 56 78", "+٣٣ ٦ ١٢ ٣٤ ٥٦ ٧٨", "(555) 123-4567", "a@b.co", "at 1.2.3.4 only", "123-45-6789", "Mr Xu"]
    texts.append(next(t for n in range(2, 99) if P.find_entities(t := f"to XX{n:02d}ABCDEFGHIJKL")))
    for t in texts:
        assert P.find_entities(t) and P._quick(t.encode()), t
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.pseudonymize(docs, key=KEY, check=False).collect()}
    assert all(got[i]["n_entities"] == len(P.find_entities(t)) for i, t in enumerate(texts))
    assert all("12 34 56 78" not in got[i]["text"] for i in (0, 1))
    assert {r["value"] for r in P.entity_table(docs, KEY).collect()} >= {"+33 6 12 34 56 78", "+49 30 12 34 56 78"}


STATES = [
    ("<body class='comments-open'><p>A text, of a page.</p></body>", "A text, of a page."), ("<body class='no-comments'><p>A text, here.</p></body>", "A text, here."),
    ("<article class='post has-comments'><p>An article, whole.</p></article>", "An article, whole."),
    ("<div class='sidebar-right'><article><p>An article, whole.</p></article></div><div class='sidebar'>side</div>", "An article, whole."),
    ("<div id='content' class='social-share-enabled'><p>The text, all of it.</p><div class='share'>x</div></div>", "The text, all of it."),
]


@pytest.mark.parametrize(("page", "text"), STATES)
def test_names_of_states_and_wrappers_take_no_article(page, text):
    assert H.main_text(page) == text


def test_headings_and_smaller_siblings_stay():
    long, short = "A long sentence, of many words. " * 30, "The rest, in a second part."
    assert H.main_text(f"<body><h1>Title</h1><div>{long}</div></body>") == f"Title\n{long.strip()}"
    assert H.main_text(f"<body><div><p>{long}</p></div><div><p>{short}</p></div></body>") == f"{long.strip()}\n{short}"
    assert H.main_text(f"<body><div><a href=x>home</a></div><h1>T</h1><div>{long}</div></body>") == f"T\n{long.strip()}"


def test_frames_formulas_and_unnamed_menus():
    text = "A sentence, with some words in it, and a point. " * 4
    links = "".join(f"<a href=/{i}>Link {i}</a><br>" for i in range(30))
    body = "".join(f"<p>{text}</p>" for _ in range(6))
    want = "\n".join([text.strip()] * 6)
    assert H.main_text(f"<body><form id=aspnetForm><div>{body}</div></form></body>") == want
    assert H.main_text(f"<body><div>{body}</div><form>Your mail <input></form></body>") == want
    assert H.main_text(f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, then.</p>{body}</article>") == f"Let x=2, then.\n{want}"
    assert H.main_text(f"<body><div class=links>{links}</div><div>{body}</div></body>") == want
    assert H.main_text(f"<body><div><div class=links>{links}</div>{body}</div></body>") == want


def test_planted_pages_without_an_article():
    import random

    rng = random.Random(9)
    words = "the of and a to in is was he for it with as his on be at by had not".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 25))).capitalize() + rng.choice([".", ", so.", "?"])
    hit = got_all = want_all = 0
    for _ in range(60):
        paras = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(3, 12))]
        menu = "".join(f"<li><a href=/{i}>{rng.choice(words)} {rng.choice(words)}</a></li>" for i in range(rng.randint(4, 25)))
        menu = rng.choice([f"<ul>{menu}</ul>", f"<div class=x1><ul>{menu}</ul></div>", f"<nav><ul>{menu}</ul></nav>", f"<div>{menu.replace('li>', 'span>')}</div>"])
        body = "".join(f"<p>{p}</p>" for p in paras)
        wrap = rng.choice(["<div>{}</div>", "<div class=c><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<form><div>{}</div></form>", "{}"])
        page = rng.choice(["<body>{m}{b}<footer>end of it</footer></body>", "<body>{b}{m}</body>", "<body><div>{m}{b}</div></body>"]).format(m=menu, b=wrap.format(body))
        got, want = H.main_text(page).split(), "\n".join(paras).split()
        from collections import Counter

        hit += sum((Counter(got) & Counter(want)).values())
        got_all += len(got)
        want_all += len(want)
    assert hit >= 0.95 * want_all and hit >= 0.95 * got_all
