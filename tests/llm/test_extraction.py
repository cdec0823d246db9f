"""Page text, license scans and decontamination against plain re-computations and hand-made cases."""

import re
from collections import Counter
from html import unescape

import numpy as np
import pytest

from tidemark.llm import decontaminate, html, licenses


def article_by_hand(page):
    """The article's blocks, by plain text handling that suits the test tables."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not inner:
        return ""
    blocks = re.split(r"</?(?:h1|p|div|ul|li|section|blockquote|pre)[^>]*>", inner[1])
    texts = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_pages_match(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r.page_id: r for r in html.extract_text(pages).collect()}
    source = pages.collect()
    assert len(out) == len(source)
    for p in source:
        r = out[p.page_id]
        assert r.text == article_by_hand(p.html) and r.n_chars == len(r.text) and r.url == p.url


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>One<p>Two &amp; <b>three</b> &lt;x&gt;</article>", "One\n\nTwo & three <x>"),
        ("<nav>menu</nav><article><header><h1>Title</h1></header>a<br>b <form>no</form><script>var a='</p>';</script>c</article><footer>f</footer>", "Title\n\na b\n\nc"),
        ("<article><p>text</p><section class='user-comments'><article><p>reader</p></article></section><div id=\"ad-slot\">buy</div></article>", "text"),
        ("<header>top</header><main><h2>H</h2><ul><li>a<li>b</ul></main>", "H\n\na\n\nb"),
        ("<div class='cookie-notice'>ok?</div><p>plain  \n page</p><!-- no -->", "plain page"),
        ('<p title="a>b">kept</p><p hidden>gone</p><p>&amp;amp; &#233; &am</p>', "kept\n\n&amp; é &am"),
        ("<article><p>a</p><aside>side</aside><p>b</p>", "a\n\nb"),
        ("<article>x < y and 1 <2</article>", "x < y and 1 <2"),
        ("no markup at all", "no markup at all"),
        ("", ""),
        (None, ""),
        ("<p>open <i>end", "open end"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<main><article>story</article></main><article class='teaser'>another text that is longer</article>", "story"),
        ("<article>the long story of the day</article><article>teaser</article>", "the long story of the day"),
        ("<main><p>a long introduction to the list of stories</p><article>one</article><article>two</article></main>", "a long introduction to the list of stories\n\none\n\ntwo"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"),
        ("<article><p>az<span class=\"ad\">buy <span>now</span></span>z and <span hidden>no</span>b</p><p>c</p></article>", "azz and b\n\nc"),
        ("<article><p>a <span class='ad'>open</p><p>next</p></article>", "a\n\nnext"),
    ],
)
def test_markup(page, text):
    assert html.Page(page or "").text(set()) == text


def test_site_templates(spark):
    rows = [(i, f"https://A.example.com:80/{i}", f"<div><span>Site of all things</span><p>Welcome back</p></div><div><p>story number {i} of many</p></div>", 1) for i in range(20)]
    rows += [(100 + i, f"http://b.example.com/{i}", f"<div><p>Welcome back</p></div><p>b {i}</p>", 1) for i in range(2)]
    rows += [(200, None, None, 1), (201, "odd", "<p>x</p>", 1), (202, "odd", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    assert out[3] == "story number 3 of many" and out[100] == "Welcome back\n\nb 0" and out[200] == "" and out[201] == "x"
    assert html.extract_text(pages.limit(0)).count() == 0


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    """One page under several addresses, without article: it is one page, and nothing of it a template."""
    page = "<h1>Title</h1><div><p>one long paragraph of the page</p></div><div><ul><li>a</li><li>b</li></ul></div>"
    out = texts_of(spark, [(i, f"http://k.example.com/{i}", page) for i in range(5)])
    assert set(out.values()) == {"Title\n\none long paragraph of the page\n\na\n\nb"}


def test_headings_short_answers_and_shared_lists_stay(spark):
    recipe = "<ul><li>1 pinch of salt</li><li>2 eggs</li></ul><table><tr><td>4 g<td>sugar</table>"
    rows = [(i, f"http://l.example.com/{i}", f"<h2>Introduction</h2><p>question {i} of many here</p><p>{'Yes.' if i % 7 == 0 else f'No {i}.'}</p><h2>Results</h2><p>result {i}</p>") for i in range(40)]
    rows += [(100 + i, f"http://m.example.com/{i}", f"<article><p>{f'dish number {i} is made as follows '*4}</p>{recipe if i < 3 else ''}</article>") for i in range(60)]
    out = texts_of(spark, rows)
    assert out[7] == "Introduction\n\nquestion 7 of many here\n\nYes.\n\nResults\n\nresult 7"
    assert out[101].endswith("\n\n1 pinch of salt\n\n2 eggs\n\n4 g\n\nsugar") and out[150] == ("dish number 50 is made as follows " * 4).strip()


def templates_by_hand(rows):
    """host: hashes on enough pages with different main texts, by counting in plain dictionaries."""
    seen, loose = {}, {}
    for _, url, page in rows:
        parts = url.split("/")
        text, found = html.Page(page).subtrees()
        for place in ((parts[2],), (parts[2], parts[3] if len(parts) > 4 else "")):
            for h in [None, *found]:
                seen.setdefault((place, h), set()).add(text)
                loose[h] = loose.get(h, True) and found.get(h, False)
    return {(place[0], h) for (place, h), texts in seen.items() if h is not None and len(texts) >= 3 and len(texts) * (2 if loose[h] else 10) >= len(seen[place, None])}


def test_templates_match_a_count_by_hand(spark):
    import random

    rng = random.Random(8)
    pool = [f"<div><p>box {k} of the site</p></div>" for k in range(12)] + [f"<p>line {k}</p>" for k in range(5)]
    rows = []
    for i in range(300):
        host, section = rng.choice("pppq"), rng.randrange(6)
        body = "".join(rng.choice(pool[section * 2 :]) for _ in range(rng.randrange(3))) + f"<p>{'own text of the page ' * 3}{i // 2}</p>"
        rows.append((i, f"http://{host}.example.com/{section}/{i}", f"<article>{body}</article>" if i % 3 else body))
    got = {(r.host, r.hash) for r in html.site_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == templates_by_hand(rows) and got


def test_templates_spare_the_article(spark):
    rows = [(i, f"http://c.example.com/{i}", "<div><p>Same</p></div><article><p>Same</p><p>Copied article</p></article>") for i in range(10)]
    out = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"Same\n\nCopied article"}


def test_recurring_box_inside_articles(spark):
    """An unnamed box on every page of a host goes; a container of copied articles and a paragraph on all pages stay."""
    box = "<div><p>Get our letter every week</p><p>Write to us</p></div>"
    rows = [(i, f"http://d.example.com/{i}", f"<article><h1>Story {i}</h1><p>What happened on day number {i} of the long year, told in full</p><p>As ever</p>{box}</article>") for i in range(12)]
    rows += [(50 + i, f"http://e.example.com/{i}", f"<main><p>copied words of one article in full</p>{box}</main>") for i in range(12)]
    rows += [(80 + i, f"http://f.example.com/{i}", f"<article><div><p>One long body of an article that is shown under several addresses</p></div><p>seen {i}</p></article>") for i in range(12)]
    out = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[7] == "Story 7\n\nWhat happened on day number 7 of the long year, told in full\n\nAs ever"
    assert out[55] == "copied words of one article in full\n\nGet our letter every week\n\nWrite to us"
    assert out[83] == "One long body of an article that is shown under several addresses\n\nseen 3"


@pytest.mark.parametrize("broadcast, hot", [(200_000, 10**6), (0, 10**6), (0, 2), (0, 6)])
def test_templates_of_sections_of_a_large_host(spark, monkeypatch, broadcast, hot):
    """Each of 40 sections has a menu on 5 of the host's 200 pages; results are those of a small host on every path."""
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", broadcast)
    monkeypatch.setattr(html, "HOT_ROWS", hot)
    page = lambda i: f"<div><p>All pages</p></div><div><p>Menu of section {i % 40}</p></div><p>only {i}</p>"
    rows = [(i, f"http://g.example.com/{i % 40}/{i}", page(i)) for i in range(200)] + [(200, "http://g.example.com/again", page(3)), (201, "http://h.example.com/", page(3))]
    rows += [(None, None, None)]
    out = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 203 and out[200] == out[3] == "only 3" and all(out[i] == f"only {i}" for i in range(200))
    assert out[201] == "All pages\n\nMenu of section 3\n\nonly 3" and out[None] == ""


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h2 id='related-work' class='form'>Related</h2><section id='search-algorithms'><p>a</p></section><section id=social-history class='notice-of-1848'><p>b</p></section></article>", "Related\n\na\n\nb"),
        ("<article class='post sponsored-by-x'><p>a</p><div id='search'>b</div><div class='share-price'>c</div></article>", "a\n\nb\n\nc"),
        ("<article class='sponsored'><p>a</p><div class='share box'>x</div><div class='related-posts'>x</div><div role=search>x</div><div id=comments>x</div><article class=comment>x</article></article>", "a"),
        ("<main class=form><div class='comment_list'>x</div><p class='form-of-words'>a</p></main>", "a"),
    ],
)
def test_names_inside_the_article(page, text):
    assert html.Page(page).text(set()) == text


def folded(text):
    return [w.rstrip(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""") for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()]


def leaks_by_hand(docs, items):
    """Every window of an item's size against the item."""
    found = {}
    for d, text in docs:
        words = folded(text)
        for i, item in items:
            w = folded(item)
            if not w or len(words) < len(w):
                continue
            k = min(5, len(w))
            grams = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
            target, size = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)), len(w) - k + 1
            if not set(grams) & set(target):
                continue
            for s in range(len(words) - len(w) + 1):
                own = Counter(grams[s : s + size])
                common = sum((own & target).values())
                similarity = common / (2 * size - common)
                if similarity >= 0.8 and similarity > found.get((d, i), (0,))[0]:
                    found[d, i] = (similarity, s, len(w))
    return found


def test_leaks_match_every_window(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    hand = leaks_by_hand([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.contaminated(documents, items).collect()}
    assert hand and got == hand
    left = {r.doc_id for r in decontaminate.decontaminated(documents, items).collect()}
    assert left == {r.doc_id for r in documents.collect()} - {d for d, _ in hand}


def test_edited_passages(spark):
    rng = np.random.default_rng(0)
    item = [f"w{i}" for i in rng.integers(0, 10**6, 50)]
    filler = [f"f{i}" for i in rng.integers(0, 10**6, 60)]
    edited = [*item[:20], "other", *item[21:]]
    broken = [w if i % 6 else "z" for i, w in enumerate(item)]
    docs = [(1, " ".join([*filler, *item, *filler])), (2, " ".join([*filler, *edited])), (3, " ".join([*broken, *filler])), (4, " ".join(w.upper() + "," for w in item)), (5, None), (6, ""), (None, " ".join(item))]
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, " "), (4, "one two three")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, round(r.similarity, 3), r.start_word) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {1: (1, 1.0, 60), 2: (1, round(41 / 51, 3), 60), 4: (1, 1.0, 0), None: (1, 1.0, 0)}
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminated(d, b).collect()) == ["3", "5", "6"]
    assert decontaminate.decontaminated(d, b).columns == d.columns
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_items_in_several_passes(spark, sf, documents, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(documents, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 60)
    assert sorted(map(tuple, decontaminate.contaminated(documents, items).collect())) == whole


def test_blocks_guarantee_the_radius():
    """Fingerprints at every distance up to RADIUS share a block up to one bit."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        b = a ^ sum(1 << int(f) for f in flips)
        cuts = decontaminate._CUTS
        assert any(bin((a >> x ^ b >> x) & ((1 << (y - x)) - 1)).count("1") <= 1 for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def test_patience_alignment():
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert licenses.align(list("xabcdy"), list("abcd")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert licenses.align(list("aXbbYc"), list("abbc")) == [(0, 0), (2, 1), (3, 2), (5, 3)]
    assert licenses.align([], [1]) == []


def test_license_lines(spark, sf, documents):
    rows = licenses.license_scan(documents).collect()
    notices = [(k, name, t) for k, (name, t) in licenses.TEMPLATES.items() if k.endswith("-notice")]
    texts = {r.doc_id: r.text for r in documents.collect()}
    hand = {(d, name) for d, t in texts.items() for _, name, notice in notices if notice in t}
    assert hand <= {(r.doc_id, r.license) for r in rows} and all(r.coverage >= 800 for r in rows)


def test_license_odd(spark, odd):
    grant = licenses.TEMPLATES["mit-grant"][1]
    cut = grant.replace("free of charge, ", "").upper()
    d = spark.createDataFrame([(1, "intro words " + grant + " more"), (2, cut), (3, "the software is free"), (4, None), (None, grant), (5, " ".join(grant.split()[:20]))], "doc_id long, text string")
    got = {(r.doc_id, r.template): (r.start_word, r.n_words) for r in licenses.license_scan(d).collect()}
    assert got == {(1, "mit-grant"): (2, len(grant.split())), (2, "mit-grant"): (0, len(cut.split())), (None, "mit-grant"): (0, len(grant.split()))}
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(d.limit(0)).count() == 0


def test_licenses_are_told_apart(spark):
    """One row per license and copy: names and versions must stand in the text; overlapping matches give the best one."""
    t = {k: text for k, (_, text) in licenses.TEMPLATES.items()}
    prose = "in the end of the day to the people of the town it is said that the work of the year is the best of any of it " * 3
    cases = {
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "Licensed under CC BY 4.0. Released under the MIT License.": ["CC-BY-4.0", "MIT"],
        "Licensed under CC BY-NC 3.0.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License v3": ["GPL-3.0"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Released under the BSD License.": [],
        f"{t['mit-grant']} {prose} {t['mit-grant']} {prose}": ["MIT", "MIT"],
        f"{t['mit-grant']} {t['mit-grant']}": ["MIT", "MIT"],
        f"{prose} {t['agpl-header']} {prose} {t['apache-header']}": ["AGPL-3.0", "Apache-2.0"],
        t["isc-grant"]: ["ISC"],
        t["bsl-grant"]: ["BSL-1.0"],
        prose: [],
    }
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {i: [] for i in range(len(cases))}
    for r in sorted(licenses.license_scan(d).collect(), key=lambda r: r.start_word):
        got[r.doc_id].append(r.license)
    assert list(got.values()) == list(cases.values())
    alone = licenses.license_scan(spark.createDataFrame([(i, x) for i, x in enumerate(t.values())], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.template, r.coverage, r.start_word) for r in alone) == [(i, k, 1000, 0) for i, k in enumerate(t)]
