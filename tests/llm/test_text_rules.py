"""HTML, URL, quality and personal-data operators against plain Python on small tables."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from barweave.llm import html_text, pii, quality, urls

CLASH = "score double, kept string, kind string, row int, text_ string"


# --- main text -----------------------------------------------------------------------------------------------------


def test_article_between_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header><a href="/">Home</a> Site</header><nav><ul><li><a href=x>menu</a></li></ul></nav>
    <div class="ad">Buy, now, cheap, things, here.</div><div class=cookie-notice>We use cookies, yes, many.</div>
    <article><h1>Title &amp; more</h1><p><b>First&nbsp;  part<br>second.<p>Third,
       with <a href=y>a link</a> &lt;tag&gt;.</p><aside>Side</aside><form><p>Mail, please</p><input></form></article>
    <section id="comments"><article class="comment"><p>Great, great, great, so long a comment, really, it is.</p></article></section>
    <footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst part second.\nThird, with a link <tag>."


def test_scoring_without_article():
    page = """<body><div id="sidebar-wrap"><div class="sidebar"><p>Side text, with commas, long enough to count as one.</p></div>
    <div class="content"><h2>Head</h2><p>Short</p><p>Another, longer.</p><ul><li>one<li>two</ul><pre>x
    y</pre><table><tr><td>c1<td>c2</table></div></div></body>"""
    assert html_text.main_text(page) == "Head\nShort\nAnother, longer.\none\ntwo\nx y\nc1\nc2"


@pytest.mark.parametrize(
    "page,text",
    [(None, ""), ("", ""), ("<", "<"), ("<p", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("</p></div>x", "x"), ("<article></article>", ""), ("<!-- a", "")],
)
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 30000 + "x") == "x"
    long = "<article>" + "<p>" + "word, " * 50000 + "</p></article>"
    assert len(html_text.main_text(long)) == 300000 - 1


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>é x</p>", 1.0), (1, "u", "<p>é x</p>", 1.0), (2, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text double")).collect()
    assert sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in got) == [(1, "u", "é x", 3), (1, "u", "é x", 3), (2, "", "", 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- urls ----------------------------------------------------------------------------------------------------------

URLS = [
    "http://A.Example.COM/en/1?x=/net/", "https://www.example.com/en/2#f", "ftp://x.net/es/9.html", "http://x.net/fr/9", "http://x.net/en/7",
    "http://x.org/en/1", "http://x.com", "http://x.com?a", "no scheme/en/", "", None, "a://b://c/d", "http://xcom/en/", "http://É.net/es/", "http://x.net/es",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[0].host, got[0].path, got[0].rule, got[0].verdict] == ["a.example.com", "/en/1", "example.com/en/", "block"]
    assert [got[1].rule, got[1].verdict] == ["www.example.com/en/", "allow"]
    assert [got[i].rule for i in (2, 3, 4, 5, 6, 7)] == ["net/es/", "net/fr/", None, None, None, None]
    assert all(got[i].host == "" and got[i].path == "" for i in (8, 9, 10))
    assert [got[11].host, got[11].path] == ["b:", "//c/d"] and got[12].rule is None and got[13].host == "É.net" and got[14].rule is None


def test_alike_siblings_are_merged(spark):
    """A few blocked pages of a mixed branch weigh with branches like it, not with ones that differ; no label, no block."""
    rules = (("block", "m.org/x/a/7"), ("block", "m.org/x/b/7"), ("allow", "m.org/x/c/"), ("block", "m.org/y/"), ("allow", "m.org/y/ok/1"))
    rows = [f"http://m.org/x/a/7{i}" for i in range(3)] + [f"http://m.org/x/b/7{i}" for i in range(60)] + ["http://m.org/x/a/1", "http://m.org/x/b/1"]
    rows += [f"http://m.org/x/c/{i}" for i in range(30)] + ["http://m.org/x/d/1"]
    rows += [f"http://m.org/y/ok/1{i}" for i in range(10)] + [f"http://m.org/y/ok/2{i}" for i in range(11)] + [f"http://m.org/y/no/{i}" for i in range(400)]
    got = {r.path: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()}
    # a has three labels, too few to be blocked alone; b's say the same
    assert got["/x/a/1"].verdict == "block" and got["/x/b/1"].verdict == "block"
    assert got["/x/d/1"].verdict == "allow" and got["/x/c/1"].verdict == "allow"
    found = spark.createDataFrame(
        [("h", f"/{t}/{i}", 1, "allow" if i < g else "block", f"p/{t}/*") for t, g, n in (("half", 10, 21), ("bad", 0, 400), ("few", 0, 2)) for i in range(n)] + [("h", "/none", 1, None, "p/none/*")],
        "host string, path string, n long, label string, template string",
    )
    assert {r.template: r.rejected for r in urls.rejected(found).collect()} == {"p/half/*": False, "p/bad/*": True, "p/few/*": True, "p/none/*": False}


def test_siblings_share_labels(spark):
    rows = [f"http://s.net/fr/{i}" for i in range(12)] + ["http://s.net/en/1", "http://o.org/en/1", "http://s.net/x/y/z"]
    rows += [f"http://wide.org/v/{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert got[12].verdict == "allow" and got[12].template == "en/*"  # it has no label of its own
    assert got[13].verdict == "allow" and got[14].verdict == "allow"
    assert {got[i].template for i in range(15, 41)} == {"v/*"}


def test_urls_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    rows = [u for u in URLS if u is None or "\n" not in u] * 3 + [f"http://h.net/{a}/{i}" for a in ("fr", "en", "q") for i in range(9)]
    df = pd.DataFrame({"page_id": range(len(rows)), "url": rows})
    con = duckdb.connect()
    con.register("pages", df)
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urls.judge_sql()})").fetchall(), key=repr)
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).drop("template")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- quality -------------------------------------------------------------------------------------------------------


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_counts(spark):
    texts = [None, "", " \t\n", "a b c", "a b c a b c", "x\ny\nx\n\n \nx", "a # $b\u00a0c é|", "the cat sat on a mat " * 400, " ".join(map(str, range(300))), "a a a a a", "w " * 51]
    rows = [(i, t, 1.0, "k", "x", 2, "t") for i, t in enumerate(texts)] + [(3, "a b c", 1.0, "k", "x", 2, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + CLASH)
    got = quality.base_counts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])


def test_ratio_keeps_clean_and_rejects_junk(spark):
    import random

    rng = random.Random(1)
    clean = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(40)) for _ in range(150)) for _ in range(60)]
    junk = [" ".join(rng.choice("win cash now".split()) + rng.choice(["!!", "$$", "%%"]) + str(rng.randrange(9)) for _ in range(150)) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(clean + junk)) + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(61, 0, 0), (62, 0, None), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 75))
    assert not got[None].kept
    none = quality.judge(df, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.judge(df.limit(0), labels).count() == 0


# --- personal data -------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = [
    None, "", "no data", "é a@b.c_d@e.f x@y..z a@b@c.d.e.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.2.3 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 x4111111111111111y",
    "+44 (20) 7946-0958 -, +1 2, +123456789012345678", "😀 z@q.io " * 600, "1" * 3000 + "." + "2" * 30, "a" * 3000 + "@", "mail a.b@c-d.example +1 (301) 555-0346 10.0.0.1",
]


def test_base_spans(spark):
    rows = [(i, t, 1.0, "k", "x", 2, "t") for i, t in enumerate(PRIVATE)] + [(10, PRIVATE[10], 1.0, "k", "x", 2, "t")]
    spans, model = pii.find(spark.createDataFrame(rows, "doc_id long, text string, " + CLASH))
    got = pii.digest(spans).collect()
    assert len(got) == len(rows)
    import hashlib

    for r in got:
        want = base_spans(PRIVATE[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",") if r.spans else [])
        assert r.n_email == sum(w.startswith("email") for w in want)


def test_cards_in_ones_and_twos(spark):
    texts = ["41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "paid by 41-11 11-11 1-1-1 1 11 11, thanks", "4 1 1 1 1 1 1 1 1 1 1 1"]
    spans, _ = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("card")] for r in pii.digest(spans).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)} and [len(got[i]) for i in range(4)] == [1, 1, 1, 0]


def test_wide_mail_needs_no_other_word(spark):
    long = "joe at " + "a" * 70 + ".b" * 3000
    texts = ["joe at example.com", "joe@ example.com", "joe @example.com", "joe (AT) a.b.c.d.e.f.g", "j" * 70 + " [at] example.com", "joe@example [dot] com", long, "joe at home"]
    df = spark.createDataFrame([(i, f"# {t} #") for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()
    found = {r.doc_id: [x.text for x in r.c if x.kind == "email"] for r in rows}
    assert found == {i: [t] if i < 7 else [] for i, t in enumerate(texts)}


def test_prose_with_at_stays(spark):
    rows = [(i, f"mail user{i}@mail.example.com or look at home. Then go, number {i}") for i in range(40)]
    rows += [(100 + i, f"contact user{i} at example.com for more") for i in range(10)]
    spans, _ = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [s.base for s in r.spans] for r in spans.collect()}
    assert got == {i: [i < 100] for i, _ in rows}


def test_wide_forms_are_learnt(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (301) 555-03{i:02d} from 10.0.0.{i}") for i in range(40)]
    rows += [(100 + i, f"contact user{i} [at] mail [dot] com, phone 301-555-03{i:02d}, thanks") for i in range(20)]
    spans, model = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    added = {r.doc_id: [s.kind for s in r.spans if not s.base] for r in spans.collect()}
    assert all(not added[i] for i in range(40))
    assert sum(added[100 + i] == ["email", "phone"] for i in range(20)) >= 18
    yes, no = model.reliability[("email", "shape")][1]
    assert yes > no


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.io, 10.0.0.1."), (2, None), (3, "plain")], "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    rows = df.withColumn("s", pii.decide(pii.candidates(text), pii.SpanModel())).select("doc_id", pii.redact(text, F.col("s")).alias("t"))
    assert {r.doc_id: r.t for r in rows.collect()} == {1: "é <email>, <ip>.", 2: "", 3: "plain"}


def test_no_rows(spark):
    spans, model = pii.find(spark.createDataFrame([], "doc_id long, text string"))
    assert pii.digest(spans).count() == 0 and model.weights == {}


def test_a_long_attribute_may_hold_an_end_of_tag(spark):
    page = '<html><body><p data-x="' + "a" * 9000 + 'b>c" class=x>Some text, with commas, that is long enough to be kept as an article.</p></body></html>'
    got = html_text.extract(spark.createDataFrame([(None, "u", page), (1, "u", '<p title="' + ">" * 200_000)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got}[None] == "Some text, with commas, that is long enough to be kept as an article."
