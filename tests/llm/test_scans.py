import math
import random
import re
import time
from html.parser import HTMLParser

import pytest
import regex

from lucidframe.llm import htmltext as H
from lucidframe.llm import licenses as L

SCAN = L.Scanner(L.NOTICES)


def edited(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


def test_within_bounds_every_notice_is_found():
    rng = random.Random(7)
    for _ in range(400):
        i = rng.randrange(len(L.NOTICES))
        k = L.edits(L.NOTICES[i][1])
        notice = edited(rng, L.NOTICES[i][1], rng.randint(0, k))
        text = "some words before it " + notice.replace(" ", rng.choice([" ", "\n"])) + " and after it"
        hits = SCAN.scan(text)
        assert hits and all(e <= L.edits(L.NOTICES[n][1]) for n, _, _, e in hits)
        assert any(s <= 21 + len(notice) and e >= 21 for _, s, e, _ in hits)


def without_seeds(text, patterns):
    """Every pattern over the whole text, and of overlapping matches those that stay, pair by pair."""
    low, found = L.fold(text), []
    for i, p in enumerate(patterns):
        for m in p.finditer(low):
            found.append((sum(m.fuzzy_counts) / len(L.NOTICES[i][1]), m.start() - m.end(), m.start(), i, m.end(), sum(m.fuzzy_counts)))
    kept = []
    for x in sorted(found):
        if all(x[4] <= y[2] or x[2] >= y[4] for y in kept):
            kept.append(x)
    return sorted((i, s, e, k) for _, _, s, i, e, k in kept)


def test_spans_and_edits_as_by_matching_without_seeds():
    rng = random.Random(8)
    patterns = [regex.compile(f"(?e)(?:{regex.escape(L.fold(t))}){{e<={L.edits(t)}}}") for _, t in L.NOTICES]
    words = lambda: " ".join(rng.choice(["the", "license", "under", "version", "free", "of", "terms"]) for _ in range(rng.randint(0, 8)))
    hits = 0
    for _ in range(24):
        text = words()
        for _ in range(rng.randint(1, 3)):
            notice = rng.choice(L.NOTICES)[1]
            text += " " + edited(rng, notice, rng.choice([0, 1, L.edits(notice), 2 * L.edits(notice)])) + " " + words()
        got = sorted(SCAN.scan(text))
        assert got == without_seeds(text, patterns), text
        hits += len(got)
    assert hits > 24


def test_many_notices_and_ties_in_one_text():
    n = 4000
    text = "Released under the MIT License. " * n
    begun = time.perf_counter()
    assert len(SCAN.scan(text)) == n and time.perf_counter() - begun < 60
    tie = L.Scanner([("A", "some notice of one kind"), ("B", "some notice of two kind"), ("A2", "some notice of one kind")])
    assert tie.scan("some notice of one kind") == [(0, 0, 23, 0)]
    assert [h[0] for h in tie.scan("some notice of xyz kind")] in ([], [0])


def test_closest_notice_wins_and_exact_ones_have_no_errors():
    for name, text in L.NOTICES:
        ((i, s, e, k),) = SCAN.scan(f"Foo. {text.upper()}\nbar")
        assert L.NOTICES[i] == (name, text) and (s, e, k) == (5, 5 + len(text), 0)
    assert [L.NOTICES[h[0]][0] for h in SCAN.scan("Licensed under CC BY-SA 4.0, not Licensed under CC BY-NC 4.0")] == ["CC-BY-SA-4.0", "CC-BY-NC-4.0"]
    assert SCAN.scan("The licence of this house was under review") == []


def test_license_table(spark):
    mit = "Released under the MIT License."
    rows = [(1, mit, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing", "x"), (None, mit, "x"), (1, mit, "x"), (5, "w " * 200_000 + mit + mit, "x"), (6, "İİ " + mit, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = L.license_scan(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "5", "5", "6", "None"]
    assert all(r.matched == mit[:-1] and r.errors == 0 and r.license == "MIT" for r in got)
    assert next(r.start for r in got if r.doc_id == 6) == 3
    assert L.license_scan(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{color:red}</style><script>var x="</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>About us now</a></li></ul></nav><div class=ad>Buy things here today.</div>
<article><h1>Heading of it</h1><p>First paragraph with a good number of words, which go on &mdash; and on.<p>Second one &lt;too&gt; with <a href=x>one link</a> in a long line of many words.</p><!-- <p>hidden</p> --></article>
<footer>&copy; Someone <a href=/t>Terms</a></footer></body></html>"""


def test_content_of_a_page():
    r = H.extract(PAGE)
    assert r["content"] == "Heading of it\nFirst paragraph with a good number of words, which go on — and on.\nSecond one <too> with one link in a long line of many words."
    assert r["title"] == "A & B" and r["top_tag"] == "article"


def brute(page):
    """The same measures by recursion over the tree."""
    import math

    t = H.Tree(page)
    kids = {i: [j for j in range(len(t.tag)) if t.parent[j] == i] for i in range(len(t.tag))}
    text = {i: sum(len(re.sub(r"\s+", " ", H.entities.unescape(x)).strip()) for n, x in t.texts if n == i) for i in kids}
    below = lambda i: [i, *[x for k in kids[i] for x in below(k)]]
    up = lambda i: [] if i < 0 else [i, *up(t.parent[i])]
    link = lambda i: any(t.tag[x] == "a" for x in up(i))
    C = lambda i: sum(text[x] for x in below(i))
    LC = lambda i: sum(text[x] for x in below(i) if link(x))

    def density(i):
        if not C(i):
            return 0.0
        T, LT = max(1, len(below(i)) - 1), max(1, sum(t.tag[x] == "a" for x in below(i)[1:]))
        base = math.log(C(i) / max(1, C(i) - LC(i)) * LC(i) + LC(t.body) / max(1, C(t.body)) * C(i) + math.e)
        v = math.log(C(i) / max(1, LC(i)) * T / LT)
        return C(i) / T * (v / math.log(base) if base > 1 else v)

    sums = {i: sum(density(k) for k in kids[i]) for i in kids}
    top = max(below(t.body), key=lambda i: (sums[i], -i))
    path = up(top)[: up(top).index(t.body) + 1]
    return t.tag[top], sums[top], min(density(i) for i in path)


def test_measures_as_by_recursion():
    rng = random.Random(5)
    tags = ["div", "p", "a", "ul", "li", "b", "section", "br"]
    for _ in range(60):
        page = "<body>" + "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some words of text ", "x &amp; y"]) for _ in range(40))
        r = H.extract(page)
        tag, total, threshold = brute(page)
        assert r["top_tag"] == tag and abs(r["density_sum"] - total) < 1e-6 and abs(r["threshold"] - threshold) < 1e-6


class Independent(HTMLParser):
    """A tree of well-formed pages by the standard library's parser: nodes are [tag, children], children nodes or texts."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", []]
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        if tag not in ("br", "img"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        if self.stack[-1][0] not in ("script", "style"):
            self.stack[-1][1].append(data)


def content_by_recursion(page):
    """What the method's definition gives, over the independent tree."""
    body = next(x for x in Independent(page).root[1][0][1] if x[0] == "body")
    flat = []

    def visit(node, parent, link):
        k = len(flat)
        flat.append({"tag": node[0], "parent": parent, "c": 0, "lc": 0, "t": 0, "lt": 0, "kids": [], "parts": []})
        link = link or node[0] == "a"
        for x in node[1]:
            if isinstance(x, str):
                n = len(re.sub(r"\s+", " ", x).strip())
                flat[k]["c"] += n
                flat[k]["lc"] += n * link
                flat[k]["parts"].append(x)
            else:
                j = visit(x, k, link)
                flat[k]["kids"].append(j)
                flat[k]["parts"].append(j)
                for y in ("c", "lc", "t", "lt"):
                    flat[k][y] += flat[j][y]
                flat[k]["t"] += 1
                flat[k]["lt"] += x[0] == "a"
        return k

    visit(body, -1, False)
    whole = flat[0]
    for x in flat:
        x["d"] = 0.0
        if x["c"]:
            base = math.log(x["c"] / max(1, x["c"] - x["lc"]) * x["lc"] + whole["lc"] / max(1, whole["c"]) * x["c"] + math.e)
            v = math.log(x["c"] / max(1, x["lc"]) * max(1, x["t"]) / max(1, x["lt"]))
            x["d"] = x["c"] / max(1, x["t"]) * (v / math.log(base) if base > 1 else v)
    for x in flat:
        x["sum"] = sum(flat[j]["d"] for j in x["kids"])
    below = lambda k: [k, *[y for j in flat[k]["kids"] for y in below(j)]]
    best = lambda k: max(below(k), key=lambda j: (flat[j]["sum"], -j))
    top = k = best(0)
    threshold = flat[top]["d"]
    while k:
        k = flat[k]["parent"]
        threshold = min(threshold, flat[k]["d"])
    chosen = {top} | {best(k) for k in range(len(flat)) if flat[k]["d"] >= threshold and flat[best(k)]["sum"] > 0}
    out = []

    def write(k, block, inside):
        block = k if flat[k]["tag"] in H.BLOCK else block
        inside = inside or k in chosen
        for x in flat[k]["parts"]:
            if isinstance(x, int):
                write(x, block, inside)
            elif inside and x.strip():
                out.append((block, re.sub(r"\s+", " ", x).strip()))

    write(0, 0, False)
    return "".join(("" if i == 0 else " " if out[i - 1][0] == b else "\n") + x for i, (b, x) in enumerate(out))


def test_content_as_by_an_independent_parser():
    rng = random.Random(12)
    attribute = lambda: rng.choice(["", "", ' class="a"', " title='x > y'", ' data-x="<p>hello</p>"', ' onclick="if(a<b)go()"', " hidden", ' alt="it\'s"'])

    def build(depth):
        out = []
        for _ in range(rng.randint(1, 5)):
            r = rng.random()
            if r < 0.45 or depth == 0:
                out.append(" ".join(rng.choice(["word", "longer", "a", "&amp;", "text&nbsp;x", "some"]) for _ in range(rng.randint(1, 30))))
            elif r < 0.55:
                out.append(rng.choice(["<br>", "<img src='a>b'>", "<script>x=\"<!--\"; if(a</b/.test(c)){}</script>", "<!-- <div> -->", "<style>p>a{}</style>"]))
            else:
                t = rng.choice(["div", "section", "article", "a", "b", "span", "h2", "blockquote"])
                out.append(f"<{t}{attribute()}>{build(depth - 1)}</{t}>")
        return "".join(out)

    seen = 0
    for _ in range(300):
        page = f"<html><head><title>t</title></head><body>{build(5)}</body></html>"
        want = content_by_recursion(page)
        assert H.extract(page)["content"] == want, page
        seen += bool(want)
    assert seen > 250


def test_tags_that_are_hard_to_read():
    text = "Hello there, this is a text of some length."
    for page in (f'<script>x="<!--";</script><div><p>{text}</p></div>', f'<div data-x="<p>no</p>"><p>{text}</p></div>', f"<div onclick='if(a<b)c(\"x\")'><p>{text}</p></div>", f'<div title="never closed><p>{text}</p></div>', f"<div it's><p>{text}</p></div>", f"<div><p>{text}</p></div><!-- open"):
        assert H.extract(f"<body>{page}")["content"] == text
    assert H.extract("<body><p>1 <2 and a<b then x</p>")["content"] == "1 <2 and a<b then x"


@pytest.mark.parametrize("page", ["<b>{n}<p>x</p>{n}", "<pre>{n}<li>x</li>{n}", "<a x='{n}<a x=\"{n}", "<a x=\"<{n}", "<title{n}", "<!--{n}", "</b>{n}", "<script>{n}", "<a \"{n}", "<p x=\"<p y='{n}", "<i>{n}</b>{n}", "<td>{n}<tr>{n}"])
def test_time_is_linear(page):
    def seconds(n):
        parts = page.split("{n}")
        text = "".join(x * n for x in parts)
        begun = time.perf_counter()
        H.extract(text)
        return time.perf_counter() - begun

    seconds(1000)
    assert min(seconds(16_000) for _ in range(2)) < 8 * 2 * min(seconds(2_000) for _ in range(3)) + 0.2


def test_html_table(spark):
    deep = "<div>" * 3000 + "deep words" + "</div>" * 3000
    rows = [(1, PAGE, "c"), (2, None, "c"), (3, "", "c"), (4, "just text", "c"), (5, deep, "c"), (None, PAGE, "c"), (1, PAGE, "c"), (6, "<p>" + "long text " * 100_000, "c"), (7, "<<a href='<'>><p", "c")]
    got = H.html_text(spark.createDataFrame(rows, "page_id long, html string, content string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.content for r in got}
    assert by[2] is None and by[3] == "" and by[4] == "just text" and by[5] == "deep words" and len(by[6]) == 999_999
    assert len({r.content for r in got if r.page_id in (1, None)}) == 1
    assert H.html_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
