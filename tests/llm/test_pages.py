import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest

from rivulet.llm import htmltext, langid, warc

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div><div class="sidebar">Latest</div>
<article><h1>{title} &amp; more</h1><p>One  two<br>three <b>bold</b>.<p>{body}<div class="ad">Buy</div><ul><li>a<li>b</ul>
<form>Name<input></form><section class="comments"><p>First!</p></section><p>Last<script>if(a<b){{}}</script> one.</article>
<footer>&copy; me</footer></body></html>"""


def test_article():
    got = htmltext.main_blocks(htmltext.parse(PAGE.format(title="News", body="Text &lt;here&gt;")), frozenset())
    assert got == ["News & more", "One two three bold.", "Text <here>", "a", "b", "Last one."]


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), ("just text", ["just text"]), ("<p>a<p>b", ["a", "b"]), ("a < b & c", ["a < b & c"]), ("<!-- x --><p>y</p><!-- open", ["y"]), ("<script>x", []),
    ("<p title='a>b'>t</p>", ["t"]), ("<main><p>in</p></main><p>out</p>", ["in"]), ("<p>&#233;&nbsp;&euro;</p>", ["é €"]), ("</p></div><p>x", ["x"]), ("<article><p>q<noscript>no</noscript> r</article>", ["q r"]),
    ("<TABLE><TR><TD>a<TD>b</TABLE>", ["a", "b"]), ("<body class='has-sidebar'><p>x</p></body>", ["x"]), ("<pre>a\n  b</pre>", ["a b"]),
])
def test_markup(html, want):
    assert htmltext.main_blocks(htmltext.parse(html), frozenset()) == want


@pytest.mark.parametrize("bad", ["<" * 50_000, '<a "' * 20_000, "<b>" * 20_000, "<script>" * 10_000, "<!--" * 10_000, "<div>" * 20_000 + "</div>" * 20_000, "&amp;" * 50_000, "<a '\">" * 10_000])
def test_hostile_markup_is_read_in_one_pass(bad):
    htmltext.parse(bad)


@pytest.mark.parametrize("html, want", [
    ("<main><h1>Head</h1><p>lead</p><article><p>card</p></article><div>body</div><nav>menu</nav></main><p>out</p>", ["Head", "lead", "card", "body"]),
    ("<main><p>short</p></main><article><p>the longer text of the page</p></article>", ["the longer text of the page"]),
    ("<article><p>card</p></article><main><p>the longer text of the page</p></main>", ["the longer text of the page"]),
    ("<div class='main'><p>beside</p><article><p>text</p></article></div>", ["text"]),
])
def test_main_keeps_what_stands_beside_an_article(html, want):
    assert htmltext.main_blocks(htmltext.parse(html), frozenset()) == want


def pages(frame, rows):
    return frame(rows, "page_id long, url string, html string")


def test_template_text_goes_where_no_article_is_marked(frame):
    page = "<html><body><div class='top'><p>Welcome to our site</p></div><div class='x'><p>{}</p><p>{}</p></div><div class='end'><p>All about us here</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(f"story {k} " * 10, f"more {k} " * 8)) for k in range(8)] + [(99, "http://other.example/", page.format("alone " * 5, "only"))]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages(frame, rows)).collect()}
    for k in range(8):
        assert got[k] == (f"story {k} " * 10).strip() + "\n\n" + (f"more {k} " * 8).strip()
    assert "alone" in got[99]


def test_templates_are_classes_of_equal_vectors(frame):
    rows = [(k, f"http://h.example/{k}", f"<div class='a'><p>menu one</p></div><div class='b'><p>text {k}</p></div>") for k in range(6)]
    found = htmltext.templates(pages(frame, rows)).collect()
    assert len(found) == 1
    template, page = set(found[0]["template"]), htmltext.parse(rows[1][2])
    assert {t for e, t in page.tokens} - template == {htmltext.text_token(page.path[4], "text 1")}
    assert htmltext.templates(pages(frame, rows[:4])).count() == 0  # too few pages
    assert htmltext.templates(pages(frame, [(k, "http://h.example/", rows[0][2]) for k in range(9)])).count() == 0  # one page, many times


def host_of_many_kinds(rng, n):
    """Pages with parts that stand always, mostly, seldom, often, and in two orders."""
    for k in range(n):
        one, two = "<h4>first</h4>", "<h5>second</h5>"
        items = "".join(f"<li><a href='/{j}'>item {j}</a></li>" for j in range(rng.randrange(1, 4)))
        yield (
            f"<div class=top><p>Welcome</p></div><ul>{items}</ul><div class=swap>{one + two if rng.random() < 0.5 else two + one}</div>"
            f"{'<div class=mostly><b>Mostly</b></div>' if k % 10 else ''}{'<div class=seldom><i>Seldom</i></div>' if k % 5 == 0 else ''}"
            f"<div class=body><p>story {rng.random()}</p><p>more {rng.random()}</p></div>" + "<dl><dt>a</dt><dd>b</dd></dl>" * 2
        )


def test_templates_against_brute_force(frame, rng):
    html = list(html_ for html_ in host_of_many_kinds(rng, 40))
    rows = [(k, "http://h.example/", h) for k, h in enumerate(html)] + [(k, "http://h.example/", html[k]) for k in range(5)]
    parsed = [htmltext.parse(h) for h in html]
    tokens = sorted({t for p in parsed for _, t in p.tokens})
    vector = {t: tuple(sum(u == t for _, u in p.tokens) for p in parsed) for t in tokens}
    same = {}
    for t in tokens:
        if sum(map(bool, vector[t])) >= 24:
            same.setdefault(vector[t], []).append(t)
    want = set()
    for ts in same.values():
        for t in ts if len(ts) > 1 else []:
            parent = next(p.path[e] for p in parsed for e, u in p.tokens if u == t)
            mates = {u for u in ts if any(p.path[e] == parent and v == u for p in parsed for e, v in p.tokens)}
            orders = set()
            for p in parsed:
                row = [u for e, u in p.tokens if u in mates and p.path[e] == parent]
                orders |= {tuple(row[k : k + len(mates)]) for k in range(0, len(row), len(mates))}
            if len(orders) == 1 and len(set(next(iter(orders)))) == len(mates):
                want.add(t)
    (found,) = htmltext.templates(pages(frame, rows)).collect()
    assert set(found["template"]) == want
    held = {b.text for p in parsed for b in p.blocks if htmltext.text_token(p.path[b.element], b.text) in want}
    assert held == {"Welcome", "Mostly", "first", "second", "item 0", "a", "b"}
    # The elements that swap are in no valid class, and neither is what is seldom.
    tags = {p.path[e] for p in parsed for e, x in enumerate(htmltext.template_elements(p, want)) if x}
    assert not tags & {p.path[b.element] for p in parsed for b in p.blocks if b.text in ("first", "second", "Seldom")}
    got = {r["text"] for r in htmltext.extract(pages(frame, rows)).collect()}
    assert all("story" in t and "more" in t and not any(x in t for x in held - {"a", "b"}) for t in got)


def test_the_template_decides_inside_marked_articles(frame):
    page = "<body><nav>menu</nav><article><p>Share this story</p><p>{}</p></article></body>"
    rows = [(k, "http://h.example/", page.format(f"story {k} of this very host")) for k in range(8)] + [(k, "http://few.example/", page.format(f"story {k}")) for k in range(20, 23)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages(frame, rows)).collect()}
    assert got[1] == "story 1 of this very host" and got[21] == "Share this story\n\nstory 21"


def test_slots_of_links_go_by_the_host(frame):
    page = "<div class=x>{}</div><div class=y><p>{}</p></div>"
    links = "<p><a href=q>one link to read</a></p>"
    rows = [(k, "http://h.example/", page.format(links.replace("one", str(k)) if k else "<p>plain words</p>", f"the text of page {k}")) for k in range(8)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages(frame, rows)).collect()}
    assert got == {k: f"the text of page {k}" for k in range(8)}


@pytest.mark.parametrize("html, want", [
    ("<div class='content has-sidebar'><p>x y</p></div>", ["x y"]), ("<div class='entry-content no-sidebar'><p>x y</p></div>", ["x y"]),
    ("<div class='site header-fixed'><article><p>x y</p></article></div>", ["x y"]), ("<div class='search-results-page'><p>x y</p></div>", ["x y"]),
    ("<form><nav><a>m</a></nav><article><p>x y</p></article></form>", ["x y"]), ("<div><div class=l><p>long long long</p></div><div class=r><p>short</p></div></div>", ["long long long", "short"]),
    (f"<p title=\"{'x>' * 5000}\">hello</p>", ["hello"]), ("<a href=x>only link</a>", ["only link"]), ("<p title=\"never closed>text</p>", ["text"]),
    ("<div class=search>find</div><div class=left-sidebar><p>latest</p></div><p>the text</p><div id=comment-list><p>I say</p></div>", ["the text"]),
    ("<div>" * 200 + "deep" + "</div>" * 200, ["deep"]), ("<article><p>short</p></article><div class=comments><p>" + "talk " * 5 + "</p></div>", ["short"]),
])
def test_names_do_not_decide_alone(html, want):
    assert htmltext.main_blocks(htmltext.parse(html), frozenset()) == want


def test_copies_of_an_article_stay(frame):
    rows = [(k, "http://h.example/a", PAGE.format(title="Same", body="Copy")) for k in range(9)]
    assert {r["text"] for r in htmltext.extract(pages(frame, rows)).collect()} == {"Same & more\n\nOne two three bold.\n\nCopy\n\na\n\nb\n\nLast one."}


def test_extract_edges(frame):
    rows = [(1, None, None), (2, "", ""), (None, "no url", "<p>x"), (2, "", ""), (3, "http://[bad", "<article></article>")]
    odd = frame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, host int, template string")
    assert sorted(r["text"] for r in htmltext.extract(odd).collect()) == ["", "", "", "", "x"]
    assert htmltext.extract(pages(frame, [])).count() == 0
    # Beyond the broadcast bound the join gives the same.
    many = pages(frame, [(k, f"http://h.example/{k}", PAGE.format(title=str(k), body="b")) for k in range(7)])
    assert sorted(map(tuple, htmltext.extract(many, broadcast_tokens=0).collect())) == sorted(map(tuple, htmltext.extract(many).collect()))


def test_warc_round_trip(frame, tmp_path, spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://d", "small"), (5, "x\r\ny", None), (6, "u", ""), (7, "http://g", big + "!"), (9, "http://i", big)]
    path = str(tmp_path / "w")
    warc.write_archives(pages(frame, rows), path, per_file=2)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        first = max(j for j, _, h in rows if h == html) if len(raw) >= 1000 else i
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert bytes(got[i]["payload"]) == (raw if first == i else b"")
    # Each file is a plain series of gzip members.
    for f in (tmp_path / "w").glob("part-*"):
        assert gzip.GzipFile(fileobj=io.BytesIO(f.read_bytes())).read().startswith(b"WARC/1.1\r\n")


def test_warc_rows_that_share_ids_and_null_ids(frame, tmp_path, spark):
    a, b, c = "a" * 2000, "b" * 2000, "c" * 2000
    rows = [(5, "u", a), (9, "u", a), (5, "u", b), (None, "m", c), (None, "n", c), (None, None, c), (None, "x", a), (4, "r", "s"), (4, "r", "s"), (7, "p", b), (7, "q", b)]
    path = str(tmp_path / "w")
    warc.write_archives(pages(frame, rows), path)
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read_archives(spark, path).collect()), key=repr)
    d = lambda t: hashlib.sha1(t.encode()).hexdigest()
    # A null url cannot be told from an empty one in an archive.
    assert got == sorted([
        (5, "u", "revisit", 9, d(a)), (9, "u", "response", None, d(a)), (None, "x", "revisit", 9, d(a)), (5, "u", "revisit", 7, d(b)), (7, "q", "response", None, d(b)), (7, "p", "revisit", 7, d(b)),
        (None, "n", "response", None, d(c)), (None, "m", "revisit", None, d(c)), (None, "", "revisit", None, d(c)), (4, "r", "response", None, d("s")), (4, "r", "response", None, d("s")),
    ], key=repr)
    payloads = {bytes(r["payload"]) for r in warc.read_archives(spark, path).collect()}
    assert payloads == {a.encode(), b.encode(), c.encode(), b"s", b""}
    # Each member of a file holds a record.
    for f in (tmp_path / "w").glob("part-*"):
        kinds = [warc.read_record(m).headers["warc-type"] for m in warc.members(f.read_bytes())]
        assert kinds[-1] == "metadata" and set(kinds[:-1]) <= {"response", "revisit"}


def test_warc_edges(frame, tmp_path, spark):
    warc.write_archives(pages(frame, []), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def archive(*payloads):
    return b"".join(warc.record("response", k, "u", len(p), hashlib.sha1(p).digest(), p) for k, p in enumerate(payloads)) + gzip.compress(b"")


def test_warc_reader_refuses_what_is_broken():
    good = archive(b"x" * 100_000, b"", b"\r\n\r\n")
    assert [r.payload for r in warc.read_archive(good)] == [b"x" * 100_000, b"", b"\r\n\r\n"]
    pack = lambda raw: gzip.compress(raw)
    raw = gzip.decompress(archive(b"payload"))
    broken = [good[:-30], b"junk" + good, pack(raw.replace(b"payload", b"PAYLOAD")), pack(raw[:-1]), pack(raw + b"more"), pack(raw.replace(b"Content-Length: ", b"Content-Width: ")), pack(b"hello")]
    for data in broken:
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data))


def test_warc_members_inflate_in_pieces():
    piece = next(iter(warc.members(zlib_member(b"a" * 1_000_000))))
    assert len(next(piece)) <= 1 << 16


def zlib_member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


LANGUAGES = {"en": "the quick brown fox jumps over the lazy dog and then the cat with that hat", "de": "der schnelle braune fuchs springt über den faulen hund und dann die katze", "fr": "le renard brun rapide saute par dessus le chien paresseux et puis le chat"}


def test_language(frame, rng):
    docs = [(k, " ".join(rng.sample(t.split(), 8)), lang) for lang, t in LANGUAGES.items() for k in range(30)]
    model = langid.train(frame([*docs, (1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"), max_docs=20)
    assert model.languages == ("de", "en", "fr")
    rows, truth = [], {}
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        truth[k] = lang
        declared = f' lang="{lang}-X"' if k % 4 else ""
        rows.append((k, f"http://{lang}.site.{'de' if lang == 'de' else 'com'}/{k}", f"<html{declared}><nav>der die das</nav><p>{' '.join(rng.sample(LANGUAGES[lang].split(), 6))}</p></html>"))
    rows.append((100, "http://de.site.de/empty", ""))  # nothing but its host and suffix
    rows.append((101, "http://fr.site.com/empty", '<html lang="fr"></html>'))
    rows.append((102, None, None))
    got = {r["page_id"]: r for r in langid.identify(pages(frame, rows), model).collect()}
    assert sum(got[k]["lang"] == truth[k] for k in truth) >= 59
    assert got[100]["lang"] == "de" and got[101]["lang"] == "fr" and got[102]["lang"] in model.languages
    assert got[1]["declared"] == "de" and got[100]["declared"] is None and all(0 < r["posterior"] <= 1 for r in got.values())


def test_language_edges(frame):
    nothing = langid.train(frame([], "doc_id long, text string, lang string"))
    assert nothing.languages == ()
    assert [r["lang"] for r in langid.identify(pages(frame, [(1, "u", "<p>x")]), nothing).collect()] == [None]
    model = langid.train(frame([(1, "abc def", "en")], "doc_id long, text string, lang string"))
    assert langid.identify(pages(frame, []), model).count() == 0


def test_fusion_against_plain_python(frame, rng):
    docs = frame([(k, " ".join(rng.sample(t.split(), 8)), lang) for lang, t in LANGUAGES.items() for k in range(10)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    names = list(model.languages)
    hosts = ["a.shop.co.uk", "b.shop.co.uk", "c.other.co.uk", "www.laden.de", "m.laden.de", "x"]
    rows = []
    for k in range(40):
        lang = rng.choice(list(LANGUAGES))
        declared = f' lang="{rng.choice([lang, lang, "en"])}"' if k % 3 else ""
        rows.append((k, f"http://{rng.choice(hosts)}/", f"<html{declared}><p>{' '.join(rng.sample(LANGUAGES[lang].split(), rng.randrange(1, 6)))}</p></html>"))
    rows += [rows[0], rows[0], (99, "http://x/", "<p>" + "the dog and that cat " * 50_000), (100, None, None)]
    seen = [r.asDict() for r in langid.evidence(pages(frame, rows), model).collect()]
    assert len({r["domain"] for r in seen if r["suffix"] == "uk"}) == 2
    softmax = lambda x: (lambda e: e / e.sum())(np.exp(np.array(x) - max(x)))
    for r in seen:
        r["p"] = softmax(r["loglik"])
    k = len(names)
    total = sum(r["p"] for r in seen)
    corpus = (total + 1) / (total.sum() + k)
    prior = lambda own, above: (own + 10 * above) / (own.sum() + 10)

    def posterior(r):
        logits = np.array(r["loglik"])
        for column in ("declared", "suffix"):
            if r[column] is not None:
                values = {x[column] for x in seen} - {None}
                logits = logits + np.log((sum(x["p"] for x in seen if x[column] == r[column]) + 1) / (total + len(values) + 1))
        of_domain = prior(sum(x["p"] for x in seen if x["domain"] == r["domain"]), corpus)
        own = sum(x["p"] for x in seen if x["host"] == r["host"]) - r["p"]
        return softmax(logits + np.log(prior(np.maximum(own, 0), of_domain)))

    want = sorted((r["page_id"], names[int(posterior(r).argmax())], round(float(posterior(r).max()), 4)) for r in seen)
    got = sorted((r["page_id"], r["lang"], round(r["posterior"], 4)) for r in langid.identify(pages(frame, rows), model).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-4 for g, w in zip(got, want, strict=True))
