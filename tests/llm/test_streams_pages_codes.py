"""Turn reassembly, main texts and vector codes against brute force, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import html
import math
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from stallmark.llm import maintext, op11, op12, op13, turns, vectorcodes

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def saved(df, folder, name):
    """A folder with one table, as queries read it."""
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected_events(rows):
    """The contract, one batch after another, turn by turn."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if t is not None]
    firsts = {}
    for c, t, _, _ in rows:
        firsts[c] = min(t, firsts.get(c, t))
    batches = defaultdict(dict)
    for c, t, role, text in rows:
        h = int(sha(f"{'' if c is None else c}:{t}")[:8], 16)
        for batch, r in [(h % 8, role)] + [((h + 3) % 8, "user")] * (h % 7 < 2):
            arrival = (f"{r}|{text}".encode(), r)
            batches[batch][c, t] = min(arrival, batches[batch].get((c, t), arrival))
    kept, heard, closed, released, out = defaultdict(dict), {}, {}, defaultdict(int), []

    def close(c, batch):
        closed[c] = batch
        own = kept[c]
        rest = [t for t in sorted(own) if t >= firsts[c] + released[c]]
        missing = sum(t not in own for t in range(firsts[c], max(own) + 1))
        breaks = sum(t - 1 in own and own[t - 1][1] == own[t][1] for t in own)
        out.append(("close", sha(",".join(map(str, rest))), c, -1, batch, missing, breaks))

    for batch in range(8):
        for (c, t), arrival in batches[batch].items():
            if c in closed:
                out.append(("reject", hashlib.sha256(arrival[0]).hexdigest(), c, t, batch, None, None))
            else:
                heard[c] = batch
                kept[c].setdefault(t, arrival)
        for c in [c for c in heard if c not in closed]:
            while (t := firsts[c] + released[c]) in kept[c]:
                out.append(("release", hashlib.sha256(kept[c][t][0]).hexdigest(), c, t, batch, None, None))
                released[c] += 1
            if batch - heard[c] >= 3:
                close(c, batch)
    for c in [c for c in heard if c not in closed]:
        close(c, 8)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_turns(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t), ("user", "assistant", None)[rng.integers(3)], f"text {rng.integers(9)}") for c in range(60) for t in rng.choice(14, rng.integers(1, 9), replace=False)]
    rows += [(7, -3, "user", "before"), (7, None, "user", "no turn"), (None, 4, "user", "no id"), (None, 5, None, None), (61, 10**12, "a|b", "c"), (61, 0, "a", "b|c"), (62, 5, "ü", "z" * 300_000), (62, 5, "u", "é\n")]
    rows += rows[:40] + [(c, t, r, (x or "") + " changed") for c, t, r, x in rows[:40]]
    return rows


def test_turn_events(spark, odd_turns, tmp_path):
    # A long gap would be slow to walk through by hand: its row is checked apart.
    near = [r for r in odd_turns if r[0] != 61]
    df = spark.createDataFrame([(*r, "x", 1) for r in near], "conv_id long, turn long, role string, text string, batch string, first int").repartition(3)
    got = rows_of(op11.query(spark, saved(df, tmp_path, "conversations")))
    want = expected_events(near)
    assert got == want and {e[0] for e in want} == {"release", "reject", "close"}


def test_turns_far_apart(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(0, 61, 10**12, 0, "a", "b"), (0, 61, 0, 0, "a", "b"), (0, 62, high, low, "a", "b"), (0, 62, low, low, "a", "b")]
    got = turns.reassembled(spark.createDataFrame(rows, "batch int, conv_id long, turn long, first long, role string, text string"), 1).where("event = 'close'")
    assert {(r["conv_id"], str(r["unreleased"]), r["n_missing"]) for r in got.collect()} == {(61, f"[{10**12}]", 10**12 - 1), (62, f"[{high}]", high)}


def test_turns_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows_of(op11.query(spark, saved(df, tmp_path, "conversations"))) == []


def test_released_texts_and_lists(spark):
    rows = [(0, 1, 0, 0, "user", "a"), (0, 1, 2, 0, "user", "c"), (1, 1, 0, 0, "user", "again"), (1, 1, 1, 0, "user", "b"), (1, 2, 4, 3, "x", "late")]
    got = turns.reassembled(spark.createDataFrame(rows, "batch int, conv_id long, turn long, first long, role string, text string"), 5)
    found = {(r["event"], r["conv_id"], r["turn"], r["batch"], r["role"], r["text"], str(r["unreleased"]), r["n_missing"], r["n_breaks"]) for r in got.collect()}
    assert found == {
        ("release", 1, 0, 0, "user", "a", "None", None, None),
        ("release", 1, 1, 1, "user", "b", "None", None, None),
        ("release", 1, 2, 1, "user", "c", "None", None, None),
        ("close", 1, -1, 4, None, None, "[]", 0, 2),
        ("close", 2, -1, 4, None, None, "[4]", 1, 0),
    }


def test_state_of_a_bucket():
    """What is released leaves the state; what waits is there after a round trip."""
    conv, wait = turns.unpacked(None, turns.CONVERSATIONS), turns.unpacked(None, turns.WAITING)
    n = 5000
    rows = {"conv_id": np.repeat([3, 9], n), "turn": np.tile(np.arange(n), 2), "first": np.zeros(2 * n, int), "role": np.full(2 * n, "user", object), "text": np.array([f"text {i}" for i in range(2 * n)], object)}
    rows = {k: v[np.r_[0:n, n + 1 : 2 * n]] for k, v in rows.items()}
    conv, wait, out = turns.step({k: v.copy() for k, v in conv.items()}, wait, rows, 0, False)
    assert len(pd.concat(out)) == n and list(conv["next"]) == [n, 0] and len(wait["turn"]) == n - 1
    packed = turns.packed(wait, turns.WAITING)
    back = turns.unpacked(packed, turns.WAITING)
    assert all((back[k] == wait[k]).all() for k in wait) and len(packed) < 60_000


def code_rows(rows):
    """The contract in whole numbers of any size, without any shortcut."""
    kept = sorted(((i, [math.floor(Fraction(x) * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = len(kept[0][1]) // 4
    cut = [[v[p * part : (p + 1) * part] for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[math.floor(Fraction(sum(x), len(own[e]))) for x in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    return sorted([(i, c, e, sums[label], digest) for i, c, e, label in out], key=str)


@pytest.mark.parametrize("n", [40, 700])
def test_codes(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) * (1 if i % 3 else 0.001))], int(i % 4) if i % 5 else None) for i in range(n)]
    rows += rows[3:6] + [(None, rows[0][1], 1), (9000, None, 1), (9001, [1.0, None, *[0.0] * 6], 1), (9002, [math.nan, *[0.0] * 7], 2), (9003, [math.inf, *[0.0] * 7], 2), (-5, [100.0, -100.0] * 4, 2)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, part int, code string").repartition(3)
    assert rows_of(op13.query(spark, saved(df, tmp_path, "embeddings"))) == code_rows(rows)


def test_codes_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rows_of(op13.query(spark, saved(empty, tmp_path / "a", "embeddings"))) == []
    ragged = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 7, 1), (3, [], 2)], "vec_id long, embedding array<float>, label int")
    got = rows_of(op13.query(spark, saved(ragged, tmp_path / "b", "embeddings")))
    assert [r[:4] for r in got] == [(1, "00000000", 0, 0), (2, None, None, 0), (3, None, None, None)]
    huge = spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], "vec_id long, embedding array<float>, label int")
    assert [r[1] for r in rows_of(op13.query(spark, saved(huge, tmp_path / "c", "embeddings")))] == ["00" * 4, "01" * 4]


def test_nearest_entries_with_ties():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 4000):
        rows, book = rng.integers(-spread, spread + 1, (600, 16)), rng.integers(-spread, spread + 1, (256, 16))
        entry, least = vectorcodes.searched(rows, book)
        whole = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == whole.argmin(axis=1)).all() and (least == whole.min(axis=1)).all()


def article_of(page):
    """Text of the synthetic pages, whose article is marked: paragraphs and the heading."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_main_texts_of_all_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op12.query(spark, SF).collect()
    assert len(got) == len(pages) and all(r["text"] == article_of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in got)


PLAIN = """<body class="with-sidebar"><div id="cookie-banner">We use cookies to do things to you today</div><div class="site-header"><a href="/">Home</a><h2>My site</h2></div>
<ul class="menu"><li><a>One</a><li><a>Two</a></ul><div><h1>Title &eacute; here</h1><p>First para with <a href=x>link words</a> inside it and\n more words<p>Second&nbsp;para has <b>bold<div class="advert">Buy now and save money at our store</div>
<p>Third para &lt;has&gt; enough words<form><input> Your name</form></div><section id="comments"><p>Great post, thank you for all this and more words here</p></section>
<div><a>About</a> <a>Contact us</a></div><footer>(c) x</footer><script>if(a<b){"</p>"}</script><noscript>no</noscript>"""


def test_pages_without_an_article(spark):
    weights = maintext.learned(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "url", "html")
    assert maintext.main_text(PLAIN, weights) == "Title é here\nFirst para with link words inside it and more words\nSecond para has bold\nThird para <has> enough words"
    assert all(w < 0 for (tag, _), w in weights.items() if tag) and weights[False, "p in"] > 0


RICH = """<html><head><title>T</title></head><body><header><a href=/>Home</a> Big Site</header><nav>Menu one two</nav><main><article><header><h1>Head line</h1><p class="byline">By Jane</p></header><div class="notice">An old notice</div><p>Para one is here.</p>
<figure><img src=x><figcaption>Cap tion</figcaption></figure><blockquote>Quote text</blockquote><ul><li>item one</li><li>item <a href=y>two link</a></li></ul><form class="newsletter">Subscribe now <input></form><table><tr><td>a</td><td>b c</td></tr></table><pre>code  here
 x</pre><p>End<br>line &amp; more.</p><footer>Posted in x</footer></article><section class="comments"><h2>Comments</h2><p>I love this article very much indeed it is great</p></section></main><aside>Side bar stuff</aside><footer>foot</footer></body></html>"""


def test_elements_that_no_page_has_taught():
    """Inside a page's one article everything but furniture is content, whatever the element."""
    assert maintext.main_text(RICH, {}).split("\n") == ["Head line", "By Jane", "Para one is here.", "Cap tion", "Quote text", "item one", "item two link", "a", "b c", "code here x", "End line & more."]


def test_main_text_is_the_best_region():
    """The scan against all regions."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<li>", "<a>", "</a>", "one ", "two three ", "four "], 14))
        found, holder = maintext.items(page)
        scores = []
        for item in found:
            tag, kind = maintext.keyed(item, holder)
            w = maintext.weight(kind, tag, 0, 0)
            scores.append(w if tag else w * len(item.text.split()))
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        text = maintext.main_text(page, {})
        if best <= 1e-9:
            assert text == ""
            continue
        i, j = next((i, j) for j in range(1, len(scores) + 1) for i in range(j) if sum(scores[i:j]) >= best - 1e-9)
        assert text.split() == "".join(x.text for x in found[i:j] if x.text is not None).split()


def test_odd_pages(spark, tmp_path):
    texts = [None, "", "plain words only", "<p>cut <b", "<article><p>one</p></article>", "<p></p>", "<nav>menu only</nav>", "<p>x &amp y &#233; &lt;b&gt;</p>", "<article><p>" + "long words " * 50_000 + "</p></article>"]
    rows = [(i, f"u{i}" if i % 2 else None, t, "h") for i, t in enumerate(texts)] + [(4, None, texts[4], "h"), (None, None, texts[4], "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = {}
    for r in op12.query(spark, saved(df, tmp_path, "pages")).collect():
        assert r["n_chars"] == len(r["text"]) and got.setdefault(r["page_id"], r["text"]) == r["text"]
    assert got == {0: "", 1: "", 2: texts[2], 3: "cut", 4: "one", 5: "", 6: "", 7: "x & y é <b>", 8: ("long words " * 50_000).strip(), None: "one"}
    assert rows_of(op12.query(spark, saved(df.limit(0), tmp_path / "none", "pages"))) == []


@pytest.mark.parametrize("evil", ["<" * 300_000, "<!--" * 100_000, "<a " * 100_000, '<a "' * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000, "<p><li>" * 30_000, "<title>" * 50_000 + "</title", '<div class="' + "a-" * 200_000 + '">x'])
def test_hostile_pages_take_linear_time(evil):
    began = time.time()
    maintext.main_text(evil, {})
    assert time.time() - began < 10


@pytest.mark.parametrize("name, query, sql", [("conversations", op11.query, op11.SQL), ("embeddings", op13.query, op13.SQL)])
def test_equals_sql(spark, name, query, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert rows_of(query(spark, SF).select(*columns)) == sorted(found.fetchall(), key=str)
