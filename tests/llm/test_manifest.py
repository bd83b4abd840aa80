"""Extraction of main texts, divergence of sources and Merkle manifests against plain versions."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkfind.llm import divergence, htmltext, merkle


# ------------------------------------------------------------------ main texts
def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


PAGES = [
    # (url, html, text)
    ("http://a.example/1", page("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three<p>Four <b>five</b>.</article><footer>&copy; a</footer>"), "A & B\nOne two three\nFour five."),
    ("http://a.example/2", page("<header><h1>Site</h1></header><main><div class='post has-sidebar'><p>Body text.</p></div></main><aside>Side</aside>"), None),
    ("http://a.example/3", page("<article class='comment'>I say</article><article><header><h1>Head</h1></header><p>x<span class='ad'>buy</span>y</p><section id=comments><p>me too</p></section></article>"), "Head\nx\ny"),
    ("http://a.example/4", page("<script>var a = '<article>no</article>';</script><article>bare<p>para</p>tail<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>"), "bare\npara\ntail\none\ntwo\nc1\nc2"),
    ("http://a.example/5", page("<article><form>Name <input></form><p>&lt;kept&gt; &#233;&nbsp;&quot;</p><div role=alert>Look</div><!-- gone --><noscript>no</noscript></article>"), '<kept> é "'),
    ("http://a.example/6", "<article><p>cut off", "cut off"),
    ("http://a.example/7", "", ""),
    (None, None, ""),
    (None, "plain words", "plain words"),
    ("http://b.example/1", page("<div class='cookie-bar'>We use cookies</div><div><p>Alone</p></div>"), "Alone"),
]


def test_main_texts(spark):
    rows = [(i, u, h, "extra", 1) for i, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2], "again", 2), (None, *PAGES[0][:2], "no id", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rid string, host long")
    got = htmltext.main_texts(pages).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append((r["url"], r["text"]))
        assert r["n_chars"] == len(r["text"])
    for i, (url, _, want) in enumerate(PAGES):
        assert by_id[i][0] == (url, "Body text." if want is None else want)
    assert by_id[0][0] == by_id[0][1] == by_id[None][0]
    assert htmltext.main_texts(pages.limit(0)).count() == 0


def test_site_style_tree(spark):
    """Without any word that names them, branches that a host repeats on its pages go, and links with them."""

    def plain(i, copies=1):
        shape = "".join(f"<p>Thought {i}.{k} of this page.</p>" for k in range(i % 5 + 1))
        links = "".join(f"<a href=/{k}>Topic {(i + k) % 7}</a> " for k in range(3 + i % 2))
        return page(f"<div class=x1>{links}</div><div class=x2><h2>Page {i}</h2>{shape}</div><div class=x3>All rights with us since 1999</div>")

    rows = [(i, f"http://c.example/{i}", plain(i)) for i in range(20)] + [(100 + i, f"http://c.example/copy/{i}", plain(3)) for i in range(30)]
    rows += [(200 + i, f"http://d.example/{i}", plain(3)) for i in range(3)]  # too few pages to tell
    # an article's unnamed box that all pages have goes, too; its plain paragraphs stay whatever repeats
    rows += [(300 + i, f"http://e.example/{i}", page("<article><p>The same everywhere.</p><div>Tell your friends</div></article>" + f"<p>{i}</p>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows:
        n = i if i < 100 else 3
        own = "\n".join([f"Page {n}", *(f"Thought {n}.{k} of this page." for k in range(n % 5 + 1))])
        if i < 200:
            assert got[i] == own, i
        elif i < 300:
            assert own in got[i] and "All rights" in got[i]
        else:
            assert got[i] == "The same everywhere."


def test_entropies(spark):
    """Importances of a host equal the formulas, computed page by page."""
    rows = [(i, "http://f.example/", page(f"<div class=u><p>{'same' if i < 6 else i}</p></div><div class=v>w{'<i>x</i>' * (i % 3)}</div>")) for i in range(9)]
    from sparkfind.llm.common import Workspace

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rid", F.col("page_id"))
    ws = Workspace(spark, "test-html")
    staged = ws.save(pages.select("rid", "page_id", "url", "html").mapInArrow(htmltext._stage, htmltext._STAGED), "staged")
    got = sorted(r["importance"] for r in htmltext.importances(ws, staged).collect())
    seen = {}
    for i, _, h in rows:  # pages of equal blocks count once
        seen.setdefault(tuple(re.findall(r"<p>(.*?)</p>.*>(w.*?)</div>", re.sub("</?i>", "", h))), i)
    kept = sorted(seen.values())

    def entropy(counts):
        t = sum(counts)
        return -sum(c / t * math.log(c / t) for c in counts)

    m = len(kept)
    texts_p, texts_v = Counter("same" if i < 6 else i for i in kept), Counter("w" + "x" * (i % 3) for i in kept)
    content = [1 - sum(math.log(c) for c in t.values()) / len(t) / math.log(m) for t in (texts_p, texts_v)]
    # every node has one style (inline elements are none), so its presentation has no entropy
    branch = [0.9 * c for c in content]
    top = 0.9 * sum(content) / 2
    assert got == pytest.approx(sorted(min(b, top) for b in branch))


def test_articles_of_the_tables(spark, sf):
    """The driver's pages: what stands between the article's tags, cut at its block elements."""
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.op11_html_extraction(spark, sf).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


# ------------------------------------------------------------------ divergence
def plain_audit(rows, min_docs, top):
    """The definition, term by term and pair by pair."""
    groups, langs, having = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(terms)
        langs[lang].update(terms)
        having[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in having.items()}

    def shares(counts, lang):
        ts = kept.get(lang, [])
        total = sum(counts[t] for t in ts)
        return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(ts)) for t in ts}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    p = {g: shares(c, g[0]) for g, c in groups.items()}
    q = {lang: shares(c, lang) for lang, c in langs.items()}
    out = set()
    for g in groups:
        pairs = [(sum(f(x, p[h][t]) for t, x in p[g].items()), h[1]) for h in groups if h[0] == g[0] and h != g]
        terms = [(f(x, q[g[0]][t]), t) for t, x in p[g].items() if groups[g][t] and x > q[g[0]][t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most], 1):
                out.add((*g, part, item, value, rank))
    return out


@pytest.mark.parametrize("min_docs,top", [(1, 3), (2, 10), (3, 1)])
def test_divergence(spark, min_docs, top):
    words = ["The", "the", "Éa", "éa", "x1y", "日本", "a_b", "z" * 50, "q", "r", "s"]
    rows = [(" ".join(words[(i * k) % len(words)] for k in range(i % 9)), ["en", "de", None][i % 3], [f"s{i % 5}", None, "hot"][i % 3 if i % 2 else 2]) for i in range(120)]
    rows += [(None, "en", "bare"), ("", "none", "a"), ("123 --", "none", "b"), ("only here", "solo", "a"), (" ".join(words) + " q" * 40_000, "de", "hot")]
    rows += rows[:10]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string")
    got = [tuple(r) for r in divergence.audit(docs, min_docs, top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, min_docs, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_slices(spark, monkeypatch):
    """A text longer than a slice counts as one document, with no term cut."""
    text = ("Alpha beta " * 2000 + "gamma" * 1000 + " ") * 3
    monkeypatch.setattr(divergence, "SLICE", 1000)
    assert Counter(w for part in divergence._slices(text.encode().translate(divergence._BYTES)) for w in part) == Counter(text.lower().encode().split())


def test_divergence_in_rounds(spark):
    """Many counts of one group, so the search takes several rounds and leaves buckets out."""
    text = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)} " * (i + 1) for i in range(300))
    rows = [(text, "en", "big"), (text, "en", "big"), *[("waa " * 5 + "wab wac", "en", f"s{k}") for k in range(3)]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(docs, 1, 5).collect()} == plain_audit(rows, 1, 5)


# ------------------------------------------------------------------ manifest
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Trees built level by level; every proof walked by itself."""

    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def walk(levels, i, cur):
        proof = ""
        for level in levels[:-1]:
            run, at = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
            proof += "".join(run[:at] + run[at + 1 :])
            cur = H(*run[:at], cur, *run[at + 1 :])
            i //= 8
        return proof, cur

    langs = defaultdict(list)
    for r in rows:
        other = r[4]
        if other is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            other = re.sub("[A-Z]", lambda m: m.group().lower(), other)
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, other), r[0]))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([e[2] for e in sorted(langs[x])]) for x in names}
    top = tree([trees[x][-1][0] for x in names])
    out = []
    for n, x in enumerate(names):
        for i, (_, _, own, altered, doc_id) in enumerate(sorted(langs[x])):
            proof, cur = walk(trees[x], i, altered)
            more, cur = walk(top, n, cur)
            root = top[-1][0]
            out.append((doc_id, own, trees[x][-1][0], root, H(proof + more), cur, cur == root))
    return sorted(out, key=repr)


MANY = [(i, "s", "en", 3, f"Text {i}") for i in range(700)] + [(i, None, f"l{i % 11}", None, ["Ab", "ab", None, ""][i % 4]) for i in range(700, 760)]
MANY += [(None, "s", None, 1, "No id É"), (None, "s", None, 1, "No id É"), (5, "s", "en", 3, "Text 5"), (5, "t", "en", 3, "Another"), (9_000_000_000_000, "s", "", 0, "x" * 100_000)]


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("rows", [MANY, MANY[:1], MANY[:8], MANY[:9], MANY[:65]], ids=["many", "1", "8", "9", "65"])
def test_manifest(spark, monkeypatch, levels, rows):
    if levels < 4 and len(rows) < 65:
        pytest.skip("one bucket")
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", 8**levels)
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(docs, F.when(tampered, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).count() == 0
