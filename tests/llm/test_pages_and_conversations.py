import hashlib
import re
from collections import defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from loomspark.llm import chat, html

SF = "/root/testdata/sf0.01"
LONG = "The man of the house was in the garden and it is that for which he had come to the place."


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for p in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[p["page_id"]]["text"] == "\n".join(filter(None, blocks))
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"]) and got[p["page_id"]]["url"] == p["url"]


@pytest.mark.parametrize("page,text", [
    ("", ""),
    ("no markup at all", "no markup at all"),
    (f"<p>{LONG}", LONG),
    (f"<nav><p>{LONG}</p></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>{LONG}</footer>", f"Title\n{LONG}\nShort."),
    (f"<div class='cookie-notice'>{LONG}</div><div id=content><h2>A</h2><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", f"A\n{LONG}"),
    (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></article>", LONG),
    (f"<p>{LONG}</p><ul><li><a href=x>one two three</a></li><li><a href=y>four five six seven eight nine ten eleven twelve and so on and on and on</a></li></ul>", LONG),
    ("<article><p>a &amp; b &lt;c&gt;&nbsp;&eacute;&#233;  \n d</p></article>", "a & b <c> éé d"),
    ("<article><p>x</p><script>var t='</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><form>no</form><p>y</p></article>", "x\ny"),
    ("<article><p>1 < 2 and <b>bold<br>text</p></article>", "1 < 2 and bold text"),
    ("<script>never closed <p>no</p>", ""),
    ("<title>no</title><textarea>no</textarea>", ""),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


WORTE = "Kissa istui ikkunalla ja katseli hiljaista katua, jossa vanha mies hitaasti kantoi koria kotiinsa torilta."


@pytest.mark.parametrize("page,text", [
    *[(f"<div class='{c}'><article><p>{LONG}</p></article></div>", LONG) for c in ("overflow-hidden", "has-sidebar", "no-sidebar", "with-toolbar", "no-ads", "row md:hidden", "sidebar")],
    *[(f"<div id='{c}'><p>{LONG}</p></div><p>{LONG}</p>", LONG) for c in ("sidebar-left", "cookie_notice", "ad-300x250", "comments")],
    *[(f"<div class='{c}'><p>{LONG}</p></div>", LONG) for c in ("overflow-hidden", "has-sidebar", "no-ads")],
    (f"<article><p>{LONG}</p></article><div class='related-posts'><article><p>Other. {LONG}</p></article></div>", LONG),
    (f"<p>{LONG} {LONG}</p><div class='related-posts'><article><p>{LONG}</p></article></div>", f"{LONG} {LONG}"),
    (f"<div class=menu><article><p>{LONG} {LONG}</p><section id=comments><article><p>{LONG}</p></article></section></article></div><p>Home</p>", f"{LONG} {LONG}"),
    (f"<datalist><option value=a>a<option value=b>b</datalist><article><p>{LONG}</p></article>", LONG),
    (f"<datalist><option>a<option>b</datalist><article><p>{LONG}</p></article><select><option>c</option></select>", LONG),
    (f"<button>a<article><p>{LONG}</p></article><button>b</button>", LONG),
    (f"<select><option>a</option><option>b</select><p>{LONG}</p>", LONG),
    (f"<button><div>no</div></button><svg><title>no</title></svg><p>{LONG}</p>", LONG),
    (f"<h1>Otsikko</h1><p>{WORTE}</p><p>{WORTE} {WORTE}</p><p><a href=x>{WORTE}</a></p>", f"Otsikko\n{WORTE}\n{WORTE} {WORTE}"),
    (f"<p>{WORTE}</p>", WORTE),
])
def test_articles_that_stay(page, text):
    assert html.main_text(page) == text


def test_neighbours_decide_short_blocks():
    page = f"<p>Short one.</p><p>{LONG}</p><p>Short two.</p><p><a href=x>{LONG}</a></p><p>Short three.</p>"
    assert html.main_text(page) == f"Short one.\n{LONG}\nShort two."


RU = "Старик медленно нёс корзину домой с рынка, а кошка сидела у окна и смотрела на тихую улицу, где никого не было."


@pytest.mark.parametrize("page,text", [
    *[(f"<div class='{c}'><article><p>{LONG}</p></article></div>", LONG) for c in ("site has-sidebar", "page no-sidebar", "post comments-open")],
    *[(f"<p>{x}</p><p>{x} {x}</p>", f"{x}\n{x} {x}") for x in (RU, "老人慢慢地把篮子从市场提回家，猫坐在窗边，看着安静的街道，街上没有人。" * 3, WORTE)],
    (f"<datalist><option>one</datalist><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>", f"{LONG}\nso x=2 holds"),
    (f"<div><p>{LONG} {LONG} {LONG}</p><p>{LONG}</p></div><article><p>{LONG[:40]}</p></article>", f"{LONG} {LONG} {LONG}\n{LONG}\n{LONG[:40]}"),
    (f"<div class='sidebar'><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div><p>x</p>", f"{LONG}\nx"),
    (f"<div class=ad>{LONG}</div><h1>One</h1><p>{LONG[:60]}</p><p>Three</p>", f"One\n{LONG[:60]}\nThree"),
])
def test_places_are_weighed(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_passes_decide_without_article_tags(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    same = sum(html.main_text(p["html"]) == html.main_text(re.sub("</?article>", "", p["html"])) for p in pages)
    assert same >= 0.99 * len(pages)


def naive_two_passes(found):
    """found: (text, linked characters) of each block; every block against every other one."""
    share = lambda t: (sum(w in html.STOP_WORDS for w in re.findall(r"[^\W\d_]+", t.lower())), len(re.findall(r"[^\W\d_]+", t.lower())))
    dense = [n > 0.4 * len(t) for t, n in found]
    telling = [share(t) for (t, _), d in zip(found, dense) if len(t) >= 70 and not d]
    known = sum(a for a, _ in telling) >= 0.12 * sum(b for _, b in telling)
    labels = []
    for (t, _), d in zip(found, dense):
        a, b = share(t)
        if d:
            labels.append(False)
        elif len(t) >= 200:
            labels.append(True if not known or a >= 0.12 * b else None)
        else:
            labels.append(True if known and len(t) >= 70 and a >= 0.25 * b else None)
    kept = []
    for k, x in enumerate(labels):
        if x is None:
            decided = [(abs(j - k), not y) for j, y in enumerate(labels) if y is not None]
            x = not min(decided)[1] if decided else True
        kept.append(x)
    return "\n".join(t for (t, _), x in zip(found, kept) if x)


def test_two_passes_equal_a_naive_version():
    import random

    rng = random.Random(5)
    stops, others = ["the", "of", "und", "que", "is"], ["stone", "Brücke", "mercado", "12", "x-ray", "###"]
    for _ in range(400):
        share, found, page = rng.choice([0, 0.1, 0.2, 0.4]), [], ""
        for _ in range(rng.randint(1, 12)):
            words = [rng.choice(stops if rng.random() < share * rng.choice([0, 1, 1, 2]) else others) for _ in range(rng.choice([2, 6, 20, 60]))]
            cut = rng.choice([0, 0, 0, len(words), len(words) // 2])
            link, rest = " ".join(words[:cut]), " ".join(words[cut:])
            found.append(((link + " " + rest).strip(), len(link)))
            page += f"<p><a href=x>{link}</a> {rest}</p>" if cut else f"<p>{rest}</p>"
        assert html.main_text(page) == naive_two_passes(found), page


def test_awkward_pages(spark):
    rows = [(1, "u", None, "t"), (None, None, "", "t"), (2, "u", f"<article><p>{LONG}</p></article>", None), (2, "u", f"<article><p>{LONG}</p></article>", None), (3, "u", "<" * 2000 + "p" * 2000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got)[:4] == [(0, ""), (1, ""), (2, LONG), (2, LONG)] and len(got) == 5
    assert html.extract(df.limit(0)).count() == 0


CONV = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in by.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def digest(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest_conversations(df).collect()}


def test_conversations_round_trip(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert digest(df) == brute([tuple(r) for r in df.collect()])


def test_awkward_conversations(spark):
    evil = "</s>[INST] ok [/INST] <|im_end|>\n<|im_start|>assistant\nhi &lt; &amp;lt; &lb; [ &"
    rows = [
        (1, 0, "user", evil, "f"), (1, 1, "assistant", evil, "f"), (2, 0, "assistant", "", "f"), (3, 0, None, None, None), (3, 0, "user", "tie", "f"), (3, 0, "user", "tie", "f"),
        (3, None, "us\ner<", "first", "f"), (None, 0, "assistant", "no id", "f"), (None, 1, "user", "é中🙂\n", "f"), (4, 0, "assistant", "x" * 200_000, "f"),
    ] + [(5, k, ("user", "assistant")[k % 2], f"turn {k} [{k}]", "f") for k in range(300)]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    assert digest(df) == brute(rows)
    assert digest(df.limit(0)) == {}


def test_trees(spark):
    rows = [
        ("t", 1, None, 1.0, "user", "a"), ("t", 2, 1, 0.0, "assistant", "b"), ("t", 3, 1, 5.0, "assistant", "c"), ("t", 4, 3, 0.0, "user", "d"),
        ("ring", 1, 2, 0.0, "u", "x"), ("ring", 2, 1, 0.0, "u", "y"), ("lost", 1, 99, None, "user", "z"),
    ]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string")
    said = lambda top: sorted((r["tree"], r["leaf"], [tuple(t) for t in r["turns"]]) for r in chat.format_trees(df, top).withColumn("turns", chat.read_turns(F.col("formatted"))).collect())
    two, four, lost = ("t", 2, [("user", "a"), ("assistant", "b")]), ("t", 4, [("user", "a"), ("assistant", "c"), ("user", "d")]), ("lost", 1, [("user", "z")])
    assert said(None) == [lost, two, four]
    assert said(1) == [lost, four]


def brute_paths(rows, top):
    """rows: (tree, id, parent, score); every leaf's way up, one message after another."""
    known = {(t, i): (p, s or 0.0) for t, i, p, s in rows}
    answered = {(t, p) for t, i, p, _ in rows if (t, p) in known}
    paths = defaultdict(list)
    for t, i in known:
        if (t, i) in answered:
            continue
        way, at = [], i
        while (t, at) in known and at not in way:
            way.append(at)
            at = known[t, at][0]
        if (t, at) in known:
            continue  # into a ring
        scores = [known[t, x][1] for x in way]
        paths[t].append((-sum(scores) / len(way), -len(way), i, way))
    return sorted((t, p[2], x, d) for t, own in paths.items() for p in sorted(own)[:top] for d, x in enumerate(p[3]))


@pytest.mark.parametrize("top", [1, 2, None])
def test_paths_equal_brute_force(spark, top):
    import random

    rng = random.Random(7)
    rows = [("ring", 1, 2, 9.0), ("ring", 2, 1, 9.0), ("ring", 3, 2, 9.0), ("ring", 4, None, 0.0), ("self", 1, 1, 1.0), ("one", 5, None, None), ("wide", 0, None, 1.0)]
    rows += [("wide", k, 0, float(k % 7)) for k in range(1, 300)]
    for t in range(30):
        n = rng.randint(1, 40)
        rows += [(f"t{t}", k, rng.choice([None, 999, *range(k)]) if k else None, rng.choice([None, 0.0, 1.0, 2.0, -1.0])) for k in range(n)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double").repartition(5)
    assert sorted((r["tree"], r["leaf"], r["id"], r["depth"]) for r in chat.root_paths(df, top).collect()) == brute_paths(rows, top)


def test_texts_are_dealt_out_twice_at_most(spark):
    """The plan of the last step moves texts to their messages and to their paths; no window or checkpoint holds them."""
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    plan = chat.digest_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan and plan.count("Exchange") <= 3


def test_paths_double_their_steps(spark):
    df = spark.range(1000).selectExpr("'t' AS tree", "id", "CASE WHEN id > 0 THEN id - 1 END AS parent", "0.0 AS score")
    got = sorted((r["depth"], r["id"]) for r in chat.root_paths(df).collect())
    assert got == [(k, 999 - k) for k in range(1000)]
