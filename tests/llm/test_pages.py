import collections
import hashlib
import html
import re

import numpy as np
import pytest

from evenkeel.llm import chat_format, html_extract, url_filter

TALKS = "conv_id bigint, turn bigint, role string, text string, loss string, segment string, rows int"


def talk_rows():
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_start|>user\n"), (1, 2, "assistant", "hello <|im_end|>\nthere"), (1, 3, "user", None), (1, 4, "assistant", "1  </s> [INST] <<SYS>>"),
        (2, 0, "assistant", ""), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, None, "x"), (3, 1, "user\nrole", "y"), (None, 1, "assistant", "z" * 300_000), (None, 0, "user", None), (4, 0, "user", "only"),
    ]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "l", "s", k) for k, r in enumerate(talk_rows())], TALKS).repartition(3)


def test_conversations_are_read_back(talks):
    groups = {}
    for c, turn, role, text in talk_rows():
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat_format.format_report(talks).collect()}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_have_all_turns_before_and_train_on_the_reply(talks):
    whole = {r["conv_id"]: r["formatted"] for r in chat_format.streams(talks).collect()}
    rows = chat_format.expand(talks).collect()
    assert len(rows) == sum(r[2] == "assistant" for r in talk_rows())
    for r in rows:
        assert whole[r["conv_id"]].startswith(r["example"])
        assert r["example"].endswith(chat_format.END)
        masked = r["example"][r["loss_start"] : r["loss_end"]]
        assert r["example"][: r["loss_start"]].endswith("<|im_start|>assistant\n") and r["loss_end"] == len(r["example"]) - len(chat_format.END)
        assert chat_format.START not in masked and chat_format.END not in masked


def test_fixed_conversation(spark):
    r = chat_format.format_report(chat_format.fixed_conversation(spark)).first()
    text = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert "</s>" not in chat_format.streams(chat_format.fixed_conversation(spark)).first()["formatted"]


def test_no_conversations(spark):
    assert chat_format.format_report(spark.createDataFrame([], TALKS)).count() == 0


PAGES = "page_id bigint, url string, html string, host string, n int, bad int, lower int, rule string"
URLS = [
    ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("ftp://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://x.com/de", "x.com", "/de", None, None),
    ("http://x.org?q=/a", "x.org", "", None, None),
    ("http://x.net#frag", "x.net", "", None, None),
    ("://", "", "", None, None),
    ("no scheme/at/all", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://ÀB.ORG/", "Àb.org", "/", "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i % 9, u[0], None, "h", 1, 2, 3, "r") for i, u in enumerate(URLS)], PAGES)
    labels = spark.createDataFrame([(1, 1), (1, None), (2, None)], "page_id bigint, bad int")
    got = url_filter.judged(pages, labels).collect()
    want = sorted(str((i % 9, u[1], u[2], u[3])) for i, u in enumerate(URLS))
    assert sorted(str((r["page_id"], r["host"], r["path"], r["rule"])) for r in got) == want
    verdicts = {(u[1], u[2]): u[4] for u in URLS if u[4]}
    assert all(r["verdict"] in ("allow", "block") and verdicts.get((r["host"], r["path"]), r["verdict"]) == r["verdict"] for r in got)
    assert url_filter.judged(spark.createDataFrame([], PAGES), labels).count() == 0
    assert url_filter.judged(pages, labels.where("false")).where("verdict = 'block' AND rule IS NULL").count() == 0


def test_bad_hosts_are_blocked_and_siblings_shrink_to_their_domain(spark):
    rows = [(i, f"http://bad{i % 4}.spam.net/x/{i}") for i in range(200)] + [(1000 + i, f"http://h{i % 20}.fine.net/x/{i}") for i in range(400)] + [(5000, "http://new.spam.net/x"), (5001, "http://new.fine.net/x")]
    pages = spark.createDataFrame([(i, u) for i, u in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int("bad" in u)) for i, u in rows if i < 5000], "page_id bigint, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labels).collect()}
    assert {got[i] for i in range(200)} == {"block"} and {got[1000 + i] for i in range(400)} == {"allow"}
    assert got[5000] == "block" and got[5001] == "allow"


def test_domains(spark):
    hosts = spark.createDataFrame([("a.b.example.co.uk",), ("x.example.org",), ("example.org",), ("localhost",), ("",)], "h string")
    got = [tuple(r) for r in hosts.select(url_filter.registered_domain(hosts.h), url_filter.suffix(hosts.h)).collect()]
    assert got == [("example.co.uk", "co.uk"), ("example.org", "org"), ("example.org", "org"), ("localhost", "localhost"), ("", "")]


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_extract.extracted(pages).collect()
    assert len(rows) == len(raw)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


BODY = "<p>It was a long day, and nobody had thought that it would end like this. They went home.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""),
        (f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{BODY}<aside><p>Read this too, please.</p></aside><section class='comments'><h2>Comments</h2><div class=comment><p>Nice one. Really, I liked it.</p></div></section></article>", "T It was a long day, and nobody had thought that it would end like this. They went home."),
        (f"<div class='cookie-banner'><p>We use cookies.</p></div><main>{BODY}<div class=ad>Buy!</div></main><div id=sidebar><p>Side words.</p></div>", "It was a long day, and nobody had thought that it would end like this. They went home."),
        ("<article><p>one<p>two &amp; &#233;&nbsp;three <b>fo</b>ur<br>five", "one two & é three four five"),
        ("<article><p>a <!-- <p>no</p> --> b</p><form><p>Sign up now</p></form><p>c\n\t d</p></article", "a b c d"),
        ("<article><p class=it's>Hello world one.</p><p>don't go</p></article>", "Hello world one. don't go"),
        ('<article><p title=a">First words here.</p><p>Second <a href="x">link</a> words here now.</p></article>', "First words here. Second link words here now."),
        ("<body><div>hello there world</div></body>", "hello there world"),
        ("<body><div class='foo'><p>hello there world</p></div></body>", "hello there world"),
        ("<article><p title='a > b'>x</p><p title=\"unclosed>y</p></article>", "x y"),
    ],
)
def test_pages(page, want):
    assert html_extract.main_text(page) == want


def test_deep_and_long_pages():
    assert html_extract.main_text("<div>" * 20_000 + "x") is not None
    long = "<article>" + "<p>word and word.</p>" * 50_000 + "</article>"
    assert html_extract.main_text(long) == " ".join(["word and word."] * 50_000)


def test_marginals_match_enumeration():
    from itertools import product
    from math import exp

    nodes = html_extract.parse("<div class=ad><p>a b c</p><a>x</a></div><p>some more words here</p>")
    p = html_extract.model()
    score = []
    for labels in product((0, 1), repeat=len(nodes)):
        s = p.root[labels[0]]
        for i in range(1, len(nodes)):
            s += p.edge[html_extract.kind(nodes[i])][labels[nodes[i].parent]][labels[i]] + sum(p.node[f][labels[i]] for f in html_extract.seen(nodes, i) if f in p.node)
        score.append((labels, exp(s)))
    total = sum(s for _, s in score)
    for i, m in enumerate(html_extract.marginals(nodes, p)):
        assert m == pytest.approx(sum(s for labels, s in score if labels[i]) / total)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None, "h", 1, 2, 3, "r"), (1, "u", f"<article>{BODY}</article>", "h", 1, 2, 3, "r")] * 2, PAGES)
    got = html_extract.extracted(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 86, 86]
    assert html_extract.extracted(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("opened", ["<body>", "<BODY class=x>", "", "</title><meta name=a><body>", "<noscript><style>b{}</style><body>"])
def test_an_omitted_end_of_the_head_hides_nothing(opened):
    article = f"<article>{'<p>' + 'The river rose by night, and the mill was lost. ' * 4 + '</p>'}</article>"
    closed = html_extract.main_text(f"<html><head><title>T</title></head><body>{article}</body></html>")
    assert "the mill was lost" in closed
    assert html_extract.main_text(f"<html><head><title>T</title>{opened}{article}</html>") == closed


def test_text_in_an_open_head_begins_the_body():
    nodes = html_extract.parse("<head><title>T</title> <script>x</script>Words of the page")
    assert [(n.text, n.hidden) for n in nodes if n.text.strip() not in ("", "T")] == [("Words of the page", False)]


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</b>" * 20_000, "<" * 200_000, "<ul><li><ul>" + "<b>" * 20_000 + "<li>x" * 20_000, "<a b='" * 30_000, "<!" * 100_000, "<a " + "= " * 100_000])
def test_odd_pages_take_time_in_proportion(page):
    import time

    start = time.time()
    html_extract.main_text(page)
    assert time.time() - start < 20


def test_held_out_pages_without_telling_names(spark):
    """Fitted on pages of the corpus; on others, with article tags and class words masked, nearly all words are told apart."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    p = html_extract.potentials(html_extract.together(html_extract.written(), html_extract.summed(html_extract.count(html_extract.self_labelled(h)) for h in pages[::2])))
    hit = kept = there = 0
    for h in pages[1::2]:
        want = html_extract.main_text(h, p).split()
        masked = re.sub(r"(</?)article>", r"\1div>", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|\S+)", "", h))
        got = html_extract.main_text(masked, p).split()
        hit, kept, there = hit + (got == want), kept + len(got), there + len(want)
    assert hit >= 0.97 * len(pages[1::2]) and abs(kept - there) <= 0.01 * there


def test_the_method_blocks_in_the_query(spark, tmp_path):
    """Tables in which one host is bad: the query blocks its pages by the posterior bound."""
    rows = [(i, f"http://www.{'bad' if i % 5 == 0 else 'ok'}{i % 10}.net/p/{i}") for i in range(500)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1, int("bad" in u)) for i, u in rows[:400]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = url_filter.op3_host_reputation(spark, str(tmp_path)).collect()
    assert {r["verdict"] for r in got if "bad" in r["host"]} == {"block"} and {r["verdict"] for r in got if "ok" in r["host"]} == {"allow"}
    assert all(r["rule"] is None for r in got)


def test_strengths_come_from_the_hosts(spark):
    """Simulated beta-binomial hosts: the strength of their level is found however large it is; without scatter there is none."""
    rng = np.random.default_rng(11)
    for strength in (5.0, 60.0, 4000.0):
        rates = rng.beta(0.3 * strength, 0.7 * strength, 600)
        n = rng.integers(400, 20_000, 600)
        hosts = [(f"h{i}.net", int(k), int(rng.binomial(k, p))) for i, (k, p) in enumerate(zip(n, rates))]
        r = url_filter.reputations(spark.createDataFrame(hosts, "host string, n bigint, bad bigint")).first()
        assert 0.75 * strength < r["k1"] < 1.35 * strength
    even = [(f"h{i}.net", 100, 30 + i % 2) for i in range(200)]
    made = url_filter.reputations(spark.createDataFrame(even, "host string, n bigint, bad bigint"))
    assert made.where("k1 is not null or k2 is not null").count() == 0
    # hosts stand on the suffix then, whose own posterior they have
    assert made.select("lower").distinct().count() == 1


def test_thousands_of_rules(spark):
    rules = tuple(("block" if i % 2 else "allow", f"h{i}.org/a{i}/") for i in range(3000)) + (("allow", "org/"), ("block", "org/"))
    pages = spark.createDataFrame([(1, "http://x.h7.org/a7/z"), (2, "http://h8.org/a8/"), (3, "http://h9.org/b"), (4, "http://h9.net/a9/")], "page_id bigint, url string")
    got = url_filter.judged(pages, spark.createDataFrame([], "page_id bigint, bad int"), url_filter.rules_table(spark, rules)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {1: ("h7.org/a7/", "block"), 2: ("h8.org/a8/", "allow"), 3: ("org/", "allow"), 4: (None, "allow")}


def written_by_hand():
    """Pages of other layouts than those given, each with its text as a reader would copy it; no label here comes from the model."""
    s = "It began early, and nobody had seen it coming; the river rose in the night and the town woke to water. "
    long = [s * n for n in (2, 3, 1, 4)]
    body, text = "".join(f"<p>{x}</p>" for x in long), " ".join(x.strip() for x in long)
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
    return {
        "comments under a name that isn't known": (f"<html><body>{menu}<article><h1>Flood</h1>{body}</article><section class='user-notes'><div><b>Jo</b><p>Great story, I was there too.</p></div></section></body></html>", f"Flood {text}"),
        "readers' articles inside the article": (f"<body><main><article><h1>Flood</h1>{body}<article class='note'><h4>Jo</h4><p>I was there too.</p></article><article><p>So was I, and my aunt.</p></article></article></main></body>", f"Flood {text}"),
        "parts named in another language": (f"<body>{menu}<main><h1>Flut</h1>{body}</main><div class='bemerkungen'><p>Danke, sehr schön geschrieben.</p></div><div class='fuss'>Impressum Datenschutz 2020</div></body>", f"Flut {text}"),
        "a paragraph that is one link": (f"<body><article><p>{s}</p><p><a href=x>The whole report of the committee</a></p>{body}</article></body>", f"{s.strip()} The whole report of the committee {text}"),
        "formulas": (f"<body><article>{body}<p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article></body>", f"{text} Then x=2 holds."),
        "a picture inside a word": (f"<body><article>{body}<p>foo<img src=x>bar and so on it went</p></article></body>", f"{text} foobar and so on it went"),
        "drawings": (f"<body><article>{body}<p>Level <svg><text>high</text></svg> all day.</p></article></body>", f"{text} Level high all day."),
        "no marks at all": (f"<body>{menu}<div id=x1><div><h1>Flood</h1>{body}</div></div><div class=footer><a href=/i>Imprint</a> 2020</div></body>", f"Flood {text}"),
    }


@pytest.mark.parametrize("trained", [False, True])
def test_pages_written_by_hand(spark, trained):
    p = html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")) if trained else html_extract.model()
    right = there = got = 0
    for name, (page, want) in written_by_hand().items():
        text = html_extract.main_text(page, p)
        a, b = text.split(), want.split()
        right += sum((collections.Counter(a) & collections.Counter(b)).values())
        got, there = got + len(a), there + len(b)
        assert text == want, name
    assert right == got == there
