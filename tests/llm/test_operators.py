"""Each operator against a brute-force version, and its defined cases."""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelog.llm import queries as Q
from tidelog.llm._common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls, empty, blank, very long, repeated rows, ties, odd characters.
ODD = [None, "", " \n\t", "a", "a b", "x " * 3000, "x " * 3000, "é" * 5000, "  two  spaces\n\n\nlines\t", "<|endoftext|> text", "▁ ▁▁x", "\x1c\x85\xa0　mixed ", "don't I'll 's 've 123abc!!", "漢字 😀 ½ ²", "a" * 20_000]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with extra columns whose names the operators use themselves."""
    rows = [(k, t, "x", 1, 2, "n", 0.5) for k, t in enumerate(ODD)]
    rows += [(None, None, "x", 1, 2, "n", 0.5), (3, "a", "x", 1, 2, "n", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, token string, size int, length int, node string, score double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(12)] + [(None, 1, 1), (99, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_queries_are_registered():
    assert sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0])) == [f"op{n}_{x}" for n, x in enumerate(["sharding", "quality_rules", "html_extraction", "token_counts", "quality_classifier", "nearest", "toxicity", "packing", "near_dedup", "byte_bpe", "whitening", "chat_format", "fill_middle"], 1)]


# --- 1


def test_sharding(spark, sf_dir, texts):
    rows = Q.op1_sharding(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights_and_odd_rows(spark, odd, empty):
    from tidelog.llm.sharding import assign_shards, rendezvous

    rows = assign_shards(odd, [1.0, 2.0], [1.0, 2.0, 0.5]).collect()
    assert len(rows) == len(ODD) + 2
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 0} == {(16, 0)}
    assert assign_shards(empty, [1.0]).count() == 0
    share = spark.range(20_000).where(rendezvous(F.col("id"), [1.0, 3.0]) == 1).count() / 20_000
    assert 0.73 < share < 0.77
    with pytest.raises(ValueError):
        rendezvous(F.lit(1), [0.0])


def test_gapless_rank_over_blocks(spark, monkeypatch):
    from tidelog.llm import _common

    monkeypatch.setattr(_common, "BLOCK_ROWS_LOG2", 3)
    rows = _common.gapless_rank(_common.materialize(spark.range(500).withColumn("k", (F.col("id") % 10 == 0).cast("int")), "t"), ["k"], "r").collect()
    for k in (0, 1):
        own = [r.r for r in rows if r.k == k]
        assert sorted(own) == list(range(len(own)))


def test_scratch_is_removed(spark, sf_dir, tmp_path):
    from tidelog.llm import _common

    docs = table(spark, sf_dir, "documents")
    with _common.scratch(spark):
        Q.op1_sharding(spark, sf_dir).write.parquet(f"{tmp_path}/out")
        kept = list(_common._written[-1])
        assert kept and all(spark.read.parquet(p).count() for p in kept)
    assert not _common._written and spark.read.parquet(f"{tmp_path}/out").count() == docs.count()
    for path in kept:
        with pytest.raises(Exception):  # noqa: B017
            spark.read.parquet(path)


# --- 2


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(grams)
    covered = {p + k for p, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_rules(spark, sf_dir, texts):
    rows = Q.op2_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_words, chars, symbols, dup, repeated = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dup, repeated)
        assert r.base_failed == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert not (r.base_failed and r.kept)


def test_rule_learning():
    from tidelog.llm.quality_rules import describe, learn

    rng = np.random.default_rng(1)
    x = {"a": rng.uniform(0, 1, 3000), "b": rng.uniform(0, 1, 3000)}
    bad = (x["a"] > 0.7) & (x["b"] > 0.5)
    rules = learn(x, bad)
    held = np.zeros(3000, dtype=bool)
    for r in rules:
        one = np.ones(3000, dtype=bool)
        for c in r:
            one &= c.holds(x[c.measure])
        held |= one
    assert rules and (held == bad).mean() > 0.97 and "reject if" in describe(rules)
    assert learn(x, np.zeros(3000, dtype=bool)) == [] and describe([]) == "keep all"


def test_verdict_as_in_python(spark, sf_dir):
    """The CASE WHEN against the rules, applied to the same statistics one by one."""
    from tidelog.llm.quality_rules import Condition, judge, learn_rules, measures

    docs = table(spark, sf_dir, "documents")
    learned = learn_rules(docs, table(spark, sf_dir, "labels"))
    made = [(Condition("n_words", False, 120.0), Condition("distinct_share", True, 0.5)), (Condition("word_length", True, 6.0),), (Condition("upper_share", True, 0.05), Condition("digit_share", False, 0.01))]
    for rules in (learned, made, []):
        judged = judge(docs, rules, ["doc_id"]).select("doc_id", "base_failed", "kept", *[c.alias(n) for n, c in measures().items()]).collect()
        for r in judged:
            rejected = any(all(r[c.measure] > c.cut if c.above else r[c.measure] <= c.cut for c in rule) for rule in rules)
            assert r.kept == (not r.base_failed and not rejected)
    assert any(not r.kept and not r.base_failed for r in judge(docs, made, ["doc_id"]).collect())


def test_quality_rules_odd_rows(odd, empty, labels):
    from tidelog.llm.quality_rules import judge, learn_rules

    rules = learn_rules(odd, labels)
    rows = judge(odd, rules, ["doc_id"]).collect()
    assert len(rows) == len(ODD) + 2 and all(r.base_failed and not r.kept for r in rows if r.doc_id in (None, 0, 1, 2))
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(ODD[r.doc_id])
    assert judge(empty, learn_rules(empty, labels.limit(0)), ["doc_id"]).count() == 0


# --- 3


def test_html_extraction(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in Q.op3_html_extraction(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(htmllib.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="content post-{n}"><header><h1>Title &amp; more</h1></header><p>Para one with <a href=x>link</a> text, long enough to count as main text.<p>Second&nbsp;para <em>yes</em>
 more words<div class="share-buttons">Share me</div><ul><li>item one<li>item two</ul><form><input>Sub</form></div><aside>side</aside><div class="sidebar">links</div>
<section id="comments"><article class="comment">Nice post I really like this one and write a long comment about it, longer than the article itself, to be sure that length alone
does not decide what is taken for the main text of this page, as readers write much</article></section></div><footer>foot</footer></body></html>"""


def test_html_boilerplate_and_odd_pages(spark):
    from tidelog.llm.html_extraction import extract, path_votes

    rows = [(k, f"https://h.example/{k}", PAGE.replace("{n}", str(k))) for k in range(5)]
    rows += [(10, None, "<p>no host</p>"), (11, "https://h.example/x", None), (12, "", ""), (13, "not a url", "<div class=ad>only an advert</div>"), (14, "https://H.example:8/y", "<body><div><p>cut off in a tag <a hre"), (14, "https://H.example:8/y", "<body><div><p>cut off in a tag <a hre")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("paths", F.lit("clash")).withColumn("host", F.lit("clash"))
    out = defaultdict(list)
    for r in extract(pages).collect():
        out[r.page_id].append(r.text)
    main = "Title & more\nPara one with link text, long enough to count as main text.\nSecond para yes more words\nitem one\nitem two"
    assert all(out[k] == [main] for k in range(5))
    assert out[10] == ["no host"] and out[11] == [""] and out[12] == [""] and out[14] == ["cut off in a tag"] * 2
    top = path_votes(pages).where("host = 'h.example'").orderBy(F.desc("vote")).first()
    assert top.path == "body.has-sidebar>div.wrap>div.content.post-#"
    assert extract(pages.limit(0)).count() == 0


LONG = "words that go on and on, " * 120
NESTED = {
    "article": ("<body><nav><a href=/>Home</a></nav><div>Site line</div><article><h1>Title</h1><p>Lead</p><div class=body><p>{long}</p></div><div class=end>The end</div></article><div class=footer>foot</div></body>", ["Title", "Lead", "{long}", "The end"]),
    "divs": ("<body><div class=page><h1>Title</h1><div class=body><div class=a>{long}</div><div class=b>Second</div></div><div class=end>The end</div></div><div><a href=/1>One more</a> <a href=/2>and more</a></div></body>", ["Title", "{long}", "Second", "The end"]),
    "main": ("<body><div>Site line</div><main><h1>Title</h1><article><section>{long}</section><section>Second</section></article></main></body>", ["Title", "{long}", "Second"]),
    "links": ("<body><table><tr><td><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a><td><p>{long}</p><div>The end</div></table></body>", ["{long}", "The end"]),
}


@pytest.mark.parametrize("name", NESTED)
def test_html_nested_parts(name):
    from tidelog.llm.html_extraction import read_page

    html, want = NESTED[name]
    page = read_page(html.replace("{long}", LONG))
    text = "\n".join(want).replace("{long}", LONG.strip())
    assert page.main_text([]) == text
    assert page.main_text([p for p, _ in page.votes()]) == text


def test_html_host_path_with_a_part_only(spark):
    """The host's path holds all of most pages, and only a stub or a part of two."""
    from tidelog.llm.html_extraction import extract

    usual = f"<body><div class=body><p>{LONG}</p></div></body>"
    odd = {100: f"<body><div class=body>Stub</div><article><h1>Title</h1>{LONG}</article></body>", 101: f"<body><article><h1>Title</h1></article><div class=other><p>{LONG}</p><div class=body>Part</div></div></body>"}
    rows = [(k, f"https://h.example/{k}", odd.get(k, usual)) for k in [*range(20), *odd]]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == LONG.strip() for k in range(20))
    assert got[100] == f"Title\n{LONG.strip()}" and got[101] == f"Title\n{LONG.strip()}\nPart"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<style>/* <a don't */</style><div class=\"x\"><p>Hello <b>world</b> first</p><p>it's Second</p></div>", "Hello world first\nit's Second"),
        ("<script>if (a <b && c > 'd) // <p \"</script><p>One</p><script>x = '</p>'</script><p>Two \"quoted\"</p>", 'One\nTwo "quoted"'),
        ("<p>a <a don't>x</a> <b title=it's>it's</b> c</p><p data-x='a>b' data-y=\"<p>\">d</p>", "a x it's c\nd"),
        ("<textarea><p>no</p></textarea><title>no</title><noscript><p>no</p></noscript><p>yes<!-- <p>no</p> > --> too</p>", "yes too"),
        ("<SCRIPT>no</Script ><P>yes</P><script>no <p>no", "yes"),
        ("<div class=hidden-gem><p>kept</p></div>", "kept"),
        ("<p>a < b and 3 <4</p><p>x</p></p></div></article>", "a < b and 3 <4\nx"),
    ],
)
def test_html_raw_elements_and_quotes(html, text):
    from tidelog.llm.html_extraction import read_page

    page = read_page(html)
    assert page.main_text([]) == text and page.main_text([p for p, _ in page.votes()]) == text


NESTS = ["<div>", "<div class=c{k}>", "<ul><li>x", "<table><tr><td>x", "<span class=ad>x", "<p>x</div>", "<form><p>x", "<p><span class=ad>x", "<div><span class=ad>x</div>", "<section><article>x", "<a href='", "<script>x", "<a = ", "<!--"]


@pytest.mark.parametrize("unit", NESTS)
def test_html_deep_pages_take_linear_time_and_memory(unit):
    import time
    import tracemalloc

    from tidelog.llm.html_extraction import read_page

    html = "".join(unit.replace("{k}", str(k)) for k in range(50_000)) + "<p>the end"
    began = time.perf_counter()
    page = read_page(html)
    page.main_text([p for p, _ in page.votes()])
    assert time.perf_counter() - began < 15
    tracemalloc.start()
    read_page(html[: len(html) // 5])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000


def test_html_long_page_and_null_ids(spark):
    from tidelog.llm.html_extraction import extract

    long = "<body><nav>menu</nav><article>" + "".join(f"<p>paragraph {k} &amp; more</p>" for k in range(30_000)) + "</article></body>"
    rows = [(None, None, long), (None, "https://h.example", long), (1, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "_html", "_host", "path", "vote", "paths", "host")})
    got = extract(pages).collect()
    want = "\n".join(f"paragraph {k} & more" for k in range(30_000))
    assert sorted((r.page_id is None, r.text) for r in got) == [(False, ""), (True, want), (True, want)]
    assert all(r.n_chars == len(r.text) for r in got)


PARA = "A paragraph of the article with some words in it, enough to be main text."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><form action=x><div class=content><p>{PARA}</p></div></form></body>", [PARA]),
        (f"<body><form action=x><p>{PARA}</p><p>Two</p><input name=q><button>Go</button><select><option>1</select></form></body>", [PARA, "Two"]),
        (f"<body><form id=aspnet><nav><a href=/>Home</a></nav><div class=main><h1>T</h1><p>{PARA}</p></div><div class=footer>foot</div></form></body>", ["T", PARA]),
        (f"<body><article><p>{PARA}</p></article><form><label>Your mail</label><input><p>Short</p></form></body>", [PARA]),
        (f"<body><form><label>Search</label><input></form><form action=y><p>{PARA}</p></form></body>", [PARA]),
        (f"<body><article><p>Intro <span class=share>Share this<p>{PARA}<p>More <span>of</span> it</article>", ["Intro", PARA, "More of it"]),
        (f"<article><p>Before <span class=ad>buy <span>now</span> cheap stuff</span> after</p><p>{PARA}</p></article>", ["Before after", PARA]),
        (f"<article><p>{PARA}</p><div>Text <span class=ad><div>Buy</div></span> goes on</div></article>", [PARA, "Text goes on"]),
        (f"<article><div>Text <span class=ad>Buy</div><p>{PARA}</p><p>x <span>y</span></article>", ["Text", PARA, "x y"]),
        (f"<article><p>{PARA}</p><div class=related-work><p>Others found this.</p></div><div class=notice-of-motion><p>It was moved.</p></div></article>", [PARA, "Others found this.", "It was moved."]),
        (f"<article><p>{PARA}</p><div class=ad-container>Buy</div><div class=share-buttons>Share</div><div class='related-posts-block'>More</div></article>", [PARA]),
        (f"<article><p>a <span class=ad>x<script>'<p>'</script> y<p>{PARA}</article>", ["a", PARA]),
    ],
)
def test_html_forms_inline_tags_and_article_sections(html, want):
    from tidelog.llm.html_extraction import read_page

    page = read_page(html)
    assert page.main_text(()) == "\n".join(want)
    assert page.main_text([p for p, _ in page.votes()]) == "\n".join(want)


@pytest.mark.parametrize(("names", "away"), [("ad", True), ("ad-container", True), ("site-footer", True), ("commentList", True), ("comments-wrapper", True), ("has-sidebar", False), ("content-with-sidebar", False), ("sidebar-layout", False), ("post content", False), ("header-ad", True), ("shadow", False), ("", False)])
def test_names_of_parts(names, away):
    from tidelog.llm.html_extraction import _away

    assert bool(_away(names)) is away


# --- 4


def test_token_counts(spark, sf_dir, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in Q.op4_token_counts(spark, sf_dir).collect():
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_token_counts_odd_rows(odd, empty, head):
    import sentencepiece

    from tidelog.llm.token_counts import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = count_tokens(odd, path, head=head).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r.n_tokens == len(model.encode((ODD[r.doc_id] if r.doc_id is not None else None) or ""))
    if head == 5:
        assert count_tokens(empty, path).count() == 0


# --- 5, 7


def accuracy(rows, marks, column):
    known = [(r, marks[r.doc_id]) for r in rows if r.doc_id in marks and r.held_out]
    return sum(r.predicted == m[column] for r, m in known) / len(known)


@pytest.mark.parametrize(("query", "column", "of", "rest", "least"), [(Q.op5_quality_classifier, "quality", 4, 2, 0.96), (Q.op7_toxicity, "toxic", 3, 1, 0.95)])
def test_classifiers(spark, query, column, of, rest, least):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).collect()
    marks = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len(rows) == table(spark, sf, "documents").count()
    assert accuracy(rows, marks, column) > least


def test_classifiers_odd_rows(odd, empty, labels):
    from tidelog.llm import quality_classifier, toxicity

    for module in (quality_classifier, toxicity):
        model = module.fit_documents(odd, labels, F.lit(True))
        rows = module.score_documents(odd, model, ["doc_id"]).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
        none = module.fit_documents(empty, labels.limit(0), F.lit(True))
        assert module.score_documents(empty, none, ["doc_id"]).count() == 0
        assert abs(module.score_documents(odd, none, ["doc_id"]).first().score - 0.5) < 1e-9
        one_class = module.fit_documents(odd, labels.where("quality = 1 AND toxic = 1"), F.lit(True))
        assert module.score_documents(odd, one_class, ["doc_id"]).first().score > 0.5


def test_discriminant_is_the_log_density_difference():
    from tidelog.llm.quality_classifier import fit

    rng = np.random.default_rng(3)
    y = (np.arange(400) % 2).astype(int)
    x = rng.normal(size=(400, 3)) * np.where(y, 1.0, 2.0)[:, None] + y[:, None]
    model = fit(x, y, to_pooled=0.0, to_mean=0.0)
    z = (x - model.centre) / model.scale
    want = []
    for k in (0, 1):
        m, c = z[y == k].mean(0), np.cov(z[y == k], rowvar=False, bias=True)
        d = z - m
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.discriminant(x), want[1] - want[0])


def test_deobfuscation(spark, sf_dir):
    from tidelog.llm.toxicity import Decoder, language_model, letter_counts

    docs = table(spark, sf_dir, "documents")
    counts = letter_counts(docs)
    words = ["idiot", "stupid", "pathetic", "scum", "trash", "loser", "moron", "clown", "worthless", "disgusting"]
    decoder = Decoder(language_model(counts, words))
    for raw, word in {"1d10t": "idiot", "stuuupid": "stupid", "p@th3t1c": "pathetic", "s.c.u.m": "scum", "t-r-a-s-h": "trash", "l0s3r": "loser", "$tupid": "stupid", "m0r0n!!": "moron", "wor7hle55": "worthless", "word***": "word", "the,": "the"}.items():
        assert decoder[raw] == word
    assert "clown" in decoder.restore("what a c l o w n\nreally") and "idiot" in decoder.restore("1 d 1 0 t")
    assert decoder.restore(None) == set() and decoder.restore("*** !!! 123") == set()
    assert counts.sum() > 0 and letter_counts(docs.limit(0)).sum() == 0


def test_viterbi_against_all_readings(spark, sf_dir):
    """The search's reading of short tokens has the least cost of all the lattice's readings."""
    from itertools import product

    from tidelog.llm.toxicity import EDGE_CODE, Decoder, code, language_model, lattice, letter_counts

    model = language_model(letter_counts(table(spark, sf_dir, "documents")), ["idiot", "scum", "trash"])
    decoder, rng = Decoder(model), np.random.default_rng(13)
    tokens = ["1d10t", "s.c.m", "t r 4", "$$s", "a*b", "aaa", "!|1", "b00", "(lo", "é1é"] + ["".join(rng.choice(list("ab1!$.* 0eé"), 5)).strip() for _ in range(150)]
    for token in filter(None, tokens):
        for whole in (False, True):
            readings = {}
            for path in product(*lattice(token, whole)):
                cost, a, b, text = 0.0, EDGE_CODE, EDGE_CODE, ""
                for letters, own in path:
                    cost += own
                    if letters:
                        d = EDGE_CODE if letters == " " else code(letters)
                        if not d == b == EDGE_CODE:
                            cost, a, b, text = cost + model[a, b, d], b, d, text + letters
                cost += model[a, b, EDGE_CODE]
                readings[text] = min(cost, readings.get(text, np.inf))
            least = min(readings.values())
            got = decoder.search(token, whole)
            if not got and (whole or not any(c.isalpha() for c in token)):
                best = min(readings, key=readings.get)
                assert least >= (len(best) + 1) * np.log(28) - 1e-9 or not best.strip()
            else:
                assert min(c for t, c in readings.items() if t.strip() == got) == pytest.approx(least)


def test_deobfuscation_at_edges_and_of_doubled_letters(spark, sf_dir):
    from tidelog.llm.toxicity import Decoder, language_model, letter_counts

    words = ["idiot", "stupid", "scum", "clown", "ass", "worthless"]
    decoder = Decoder(language_model(letter_counts(table(spark, sf_dir, "documents")), words))
    forms = {"stuupid": "stupid", "iddiot": "idiot", "|diot": "idiot", "(lown": "clown", "{lown": "clown", "<lown": "clown", "idio+": "idiot", "as$": "as ass", "a$$": "as ass", "455": "ass", "@$$": "ass", "455!": "ass", "worthless": "worthless", "(word": "word", "word)": "word", "word!": "word", "123": "", "2019": "", "10:30": ""}
    assert {raw: decoder[raw] for raw in forms} == forms
    for text, word in {"i d i o t.": "idiot", "i d i o t!": "idiot", 'you "i d i o t" there': "idiot", "(s c u m)": "scum", "s t u p i d!!! and": "stupid", "stuupid good": "good", "such 4 5 5!": "ass"}.items():
        assert word in decoder.restore(text), text
    assert decoder.restore("1 2 3 *** !!! 123") == set()


# --- 6


def brute_nearest(vectors, k, every):
    usable = {i: np.array(v, dtype=float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    size = Counter(map(len, usable.values())).most_common(1)[0][0] if usable else 0
    usable = {i: v for i, v in usable.items() if len(v) == size}
    return {q: sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)[:k] for q in usable if q % every == 0}


def recall_of(vectors, got, k, every):
    """Share of the true k nearest that were found; checks order and scores of what was."""
    want, own = brute_nearest(vectors, k, every), dict(vectors)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id]) <= k
    assert found.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        assert len(found[q]) == len(near) and found[q] == sorted(found[q]) and len({i for _, i in found[q]} - {q}) == len(near)
        exact = [float(np.sqrt(((np.array(own[i], dtype=float) - np.array(own[q], dtype=float)) ** 2).sum())) for _, i in found[q]]
        assert np.allclose([s for s, _ in found[q]], exact, rtol=0, atol=1e-12)
        hits += len({i for _, i in near} & {i for _, i in found[q]})
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest(spark, sf):
    """By hashing at every size: nothing switches to an exact search."""
    vectors = [(r.vec_id, r.embedding) for r in table(spark, f"/root/testdata/{sf}", "embeddings").collect()]
    assert recall_of(vectors, Q.op6_nearest(spark, f"/root/testdata/{sf}"), 10, 100) >= 0.9


def clustered(n, d=64, clusters=200, spread=0.3, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((clusters, d))[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, d))


def vector_table(spark, x, path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float32)), x.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": lists}), f"{path}/vectors.parquet", row_group_size=20_000)
    return spark.read.parquet(f"{path}/vectors.parquet")


def points_met(index, x, queries):
    """Distances that a query's probes ask for, on average."""
    met = 0
    for t in range(len(index.directions)):
        found, counts = np.unique(index.cells(x, t), return_counts=True)
        for cells in index.probes(queries, t):
            assert len(np.unique(cells)) == len(cells)
            at = np.minimum(np.searchsorted(found, cells), len(found) - 1)
            met += counts[at][found[at] == cells].sum()
    return met / len(queries)


@pytest.mark.parametrize(("n", "every", "most"), [(10_000, 100, 0.05), (50_000, 200, 0.025), (200_000, 1000, 0.02)])
def test_nearest_among_clusters(spark, tmp_path, monkeypatch, n, every, most):
    """Tables far larger than the fitted sample: recall, and a share of the table that falls with its size."""
    from tidelog.llm import nearest as N

    used = []
    monkeypatch.setattr(N, "fit", lambda *a, real=N.fit: used.append(real(*a)) or used[-1])
    x = clustered(n).astype(np.float32).astype(float)
    got = N.nearest(vector_table(spark, x, tmp_path), 10, every).toPandas()
    queries = np.arange(0, n, every)
    hits = 0
    for low in range(0, len(queries), 500):
        q = queries[low : low + 500]
        squares = (x[q] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[q] @ x.T
        squares[np.arange(len(q)), q] = np.inf
        top = np.argpartition(squares, 10, 1)[:, :10]
        found = got[got.query_id.isin(q)].groupby("query_id").vec_id.agg(set)
        hits += sum(len(found[i] & set(t.tolist())) for i, t in zip(q.tolist(), top, strict=True))
    assert len(got) == 10 * len(queries) and hits / len(got) >= 0.9
    assert points_met(used[0], x, x[queries[:100]]) < most * n


def test_nearest_in_dense_and_sparse_regions(spark, tmp_path):
    """Tight clusters, loose ones, and points far from everything, which take wider indexes and at last an exact search."""
    from tidelog.llm.nearest import nearest

    rng = np.random.default_rng(5)
    x = np.concatenate([clustered(2_000, 32, 20, 0.02, 2), clustered(2_000, 32, 20, 0.6, 3), 20 * rng.standard_normal((60, 32))])
    rng.shuffle(x)
    vectors = vector_table(spark, x, tmp_path)
    assert recall_of([(r.vec_id, r.embedding) for r in vectors.collect()], nearest(vectors, 10, 25), 10, 25) >= 0.95


def test_nearest_of_mixed_scales(spark, tmp_path, monkeypatch):
    """Points at log-normal distances from one centre: few queries, those far from all others, end in one cell."""
    from tidelog.llm import nearest as N

    asked = []
    monkeypatch.setattr(N, "candidates", lambda points, queries, index, *a, real=N.candidates, **kw: asked.append((index.directions.shape[1], queries.count())) or real(points, queries, index, *a, **kw))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 16)) * np.exp(rng.normal(size=(12_000, 1)))
    got = N.nearest(vector_table(spark, x, tmp_path), 10, 100).toPandas()
    hits = sum(len(set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist()) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert len(got) == 1200 and hits / len(got) >= 0.9
    assert asked[0] == (asked[0][0], 120) and sum(n for k, n in asked if not k) <= 0.25 * 120


def test_nearest_copies_and_hot_cells(spark, monkeypatch):
    """A vector that a third of all rows share, and cells larger than a part."""
    from tidelog.llm import nearest as N

    monkeypatch.setattr(N, "PART_POINTS", 64)
    monkeypatch.setattr(N, "PART_QUERIES", 16)
    rng = np.random.default_rng(4)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else (rng.standard_normal(3) * (0.01 if k % 3 == 1 else 1)).tolist()) for k in range(1_500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.nearest(vectors, 10, 10)
    assert recall_of(rows, got, 10, 10) >= 0.9
    ids = {r.query_id: [x.vec_id for x in got.where(f"query_id = {r.query_id}").orderBy("rank").collect()] for r in got.where("query_id IN (0, 300)").select("query_id").distinct().collect()}
    assert ids == {0: list(range(3, 33, 3)), 300: list(range(0, 30, 3))}  # ties: the least ids


def test_probes_come_in_order_of_their_chance():
    """Against all cells around a query."""
    from itertools import product

    from tidelog.llm.nearest import _normal, hash_functions

    rng = np.random.default_rng(8)
    index = hash_functions(5, 1, 3, 1.5, 1.0, 0.9)
    x = rng.standard_normal((20, 5))
    for q, cells in zip(x, index.probes(x, 0), strict=True):
        at = index.places(q[None], 0)[0]
        chances = {}
        for cell in product(*[range(int(np.floor(a)) - 6, int(np.floor(a)) + 7) for a in at]):
            low = np.array(cell)
            number = int((low * index.codes[0]).sum())
            chances[number] = float(np.prod(_normal((low + 1 - at) * index.width / index.near) - _normal((low - at) * index.width / index.near)))
        order = [chances[int(c)] for c in cells]
        assert order == sorted(order, reverse=True) and sum(order) >= 0.9 - 1e-6 and sum(order[:-1]) < 0.9
        assert np.allclose(order, sorted(chances.values(), reverse=True)[: len(order)])


def test_part_search_is_exact():
    """A part's blocks and listed pairs against all its pairs."""
    from tidelog.llm import nearest as N

    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 4))
    names, cells = rng.permutation(700), np.where(rng.random(700) < 0.5, 0, rng.integers(1, 40, 700))
    asked = rng.standard_normal((30, 4))
    visits = [np.unique(np.append(rng.integers(0, 60, 12), [0] if q % 2 else [])).astype(np.int64) for q in range(30)]
    q, p, distance = N.search_part(names, cells, x, asked, visits, 5)
    for k in range(30):
        want = sorted((float(np.sqrt(((x[i] - asked[k]) ** 2).sum())), int(names[i])) for i in range(700) if cells[i] in visits[k])[:6]
        assert [(float(d), int(names[i])) for d, i in zip(distance[q == k], p[q == k], strict=True)] == want


def test_nearest_odd_rows(spark):
    from tidelog.llm.nearest import nearest

    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(1, 60)] + [(0, [0.0, 1.0, 0.0]), (100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [None, 1.0, 1.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0]), (None, [1.0, 1.0, 1.0])]
    extra = {c: F.lit("clash") for c in ("v", "point", "id", "query", "cell", "part", "score", "rank")}
    for kind in ("float", "double"):
        vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns(extra)
        assert recall_of(rows, nearest(vectors, 10, 10), 10, 10) >= 0.9
    assert nearest(vectors.limit(0)).count() == 0
    few = vectors.where("vec_id IN (0, 1, 2)")
    assert nearest(few, 10, 10).count() == 2 and nearest(vectors.where("vec_id = 0"), 10, 10).count() == 0
    twice = spark.createDataFrame([(0, [5.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in nearest(twice, 10, 10).orderBy("rank").collect()] == [(1, 1.0), (2, 3.0)]


# --- 8


def check_packing(rows, ids, size):
    tokens, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and 0 < r.length <= size
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.piece == 0 or r.length == size
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return tokens, len(sequences)


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    tokens, n = check_packing(Q.op8_packing(spark, sf_dir).collect(), ids, 2048)
    assert tokens == {i: len(x) for i, x in ids.items()}
    assert n <= -(-sum(tokens.values()) // 2048) * 1.02 + 1


def test_packing_odd_rows(odd, empty):
    from tokenizers import Tokenizer

    from tidelog.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(ODD)} | {None: [0]}
    rows = pack_documents(odd, path, size=64).collect()
    tokens, _ = check_packing(rows, ids, 64)
    assert all(tokens[k] == len(x) * (2 if k == 3 else 1) for k, x in ids.items())
    assert pack_documents(empty, path).count() == 0
    whole = pack_documents(odd, path, with_ids=True).where("doc_id = 4").first()
    assert list(np.frombuffer(whole.ids, dtype="<u4")) == ids[4]


def test_plan_is_best_fit():
    """The plan over counts against best fit, piece by piece."""
    from tidelog.llm.packing import plan

    rng = np.random.default_rng(5)
    for size in (10, 37, 128):
        lengths = rng.integers(1, size + 1, 400).tolist()
        rooms = []
        for length in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                rooms.append(size - length)
            else:
                rooms[rooms.index(fit)] -= length
        rows = plan(dict(Counter(lengths)), size)
        used, placed = defaultdict(int), Counter()
        for length, lo, hi, first, each, offset in rows:
            for r in range(lo, hi):
                q = first + (r - lo) // each
                assert used[q] == offset + (r - lo) % each * length
                used[q] += length
            placed[length] += hi - lo
        assert placed == Counter(lengths) and max(used.values()) <= size and len(used) == len(rooms)
    assert plan({}, 8) == []


# --- 9


def brute_components(rows, words, percent):
    """rows: (doc_id, text). Components by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for k, s in enumerate(sets):
        seen = Counter(j for g in s for j in by_shingle[g])
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            by_shingle[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def test_near_dedup(spark, sf_dir, texts):
    rows = Q.op9_near_dedup(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(brute_components(list(texts.items()), 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_dedup_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({Q.oracle_sql()['op9_near_dedup']})").fetchall()
    ours = Q.op9_near_dedup(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, ours)) == sorted(theirs)


def edited(rng, base, n):
    out = list(base)
    for at in rng.integers(0, len(base), n):
        out[at] = f"w{rng.integers(0, 10**9)}"
    return " ".join(out)


def test_near_dedup_large_group(spark, monkeypatch):
    """A group of many different near-copies around the threshold, over several blocks."""
    from tidelog.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, edited(rng, base, int(rng.integers(0, 9)))) for k in range(150)]
    rows += [(200 + k, " ".join(f"o{k}x{j}" for j in range(30))) for k in range(20)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_components(rows, 3, 85))


def test_near_dedup_between_blocks(spark, monkeypatch):
    """Buckets of several blocks: one large group, smaller ones, and texts that only a chain joins, against all pairs."""
    from tidelog.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(21)
    base = [f"b{k}" for k in range(120)]
    texts = [edited(rng, base, int(rng.integers(0, 3))) for _ in range(120)]  # one group
    for part in range(6):  # groups and single texts that meet the first in buckets, but are mostly too far from it
        own = edited(rng, base, 7).split()
        texts += [edited(rng, own, int(rng.integers(0, 3))) for _ in range(4 + 5 * part)]
    step = list(base)
    for k in range(60):  # each is near the one before
        step[2 * k] = f"c{k}"
        texts.append(" ".join(step))
    rows = [(k, texts[at]) for k, at in enumerate(rng.permutation(len(texts)).tolist())]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_components(rows, 3, 85))


def test_near_dedup_hot_bucket_rows(spark, monkeypatch):
    """A bucket of different near-copies that are one group: its rows grow with its nodes, not with their square."""
    from tidelog.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = [f"b{k}" for k in range(200)]
    dealt = []
    inner = near_dedup.active_nodes
    monkeypatch.setattr(near_dedup, "active_nodes", lambda paired, *rest: (dealt.append(paired.count()), inner(paired, *rest))[1])
    for n in (300, 600):
        rows = [(k, " ".join([*base, f"d{k}"])) for k in range(n)]
        dealt.append(None)
        out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
        assert {r.component_id for r in out} == {0}
    cut = dealt.index(None, 1)
    first, second = sum(dealt[1:cut]), sum(dealt[cut + 1 :])
    assert 300 * 10 < first < 300 * 30 and second < 2.5 * first


def test_near_dedup_unlike_blocks(spark, monkeypatch):
    """Each pair of nodes of different labels in a bucket meets in just one block pair, and no block has too many."""
    from tidelog.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    labels = [b"big"] * 40 + [b"mid"] * 9 + [f"s{k}".encode() for k in range(25)] + [b"three"] * 3
    rows = [(bucket, 0, hashlib.md5(f"{bucket} {k}".encode()).digest(), 10, x) for bucket in (1, 2) for k, x in enumerate(rng.permutation(labels).tolist())]  # noqa: S324
    members = spark.createDataFrame(rows, "bucket long, band int, node binary, n_shingles long, label binary")
    met, of = Counter(), {bytes(r[2]): (r[0], r[4]) for r in rows}
    groups = defaultdict(list)
    for r in near_dedup.unlike_blocks(members).collect():
        groups[r.bucket, r.i, r.j].append((bytes(r.node), r.side))
    for (_, i, j), nodes in groups.items():
        assert len(nodes) < 60
        for a, (x, s) in enumerate(nodes):
            for y, t in nodes[a + 1 :]:
                if of[x] != of[y] and (i == j or s != t):
                    met[frozenset((x, y))] += 1
    wanted = {frozenset((x, y)) for x in of for y in of if of[x][0] == of[y][0] and of[x][1] != of[y][1]}
    assert met == Counter(wanted)


def test_near_dedup_blocks_by_shingles(spark, monkeypatch):
    """Long texts: a block's sets are bounded, too."""
    from tidelog.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2_000)
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(1_500)]
    rows = [(k, edited(rng, base, int(rng.integers(0, 60)))) for k in range(40)] + [(50, "one two three four"), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = near_dedup.sketch(docs, 3, 128).where("node IS NOT NULL").select("node", "n_shingles", "registers")
    bands, per = near_dedup.banding(0.85)
    blocks = near_dedup.candidate_blocks(sketches, bands, per, 0.85).groupBy("bucket", "i", "j").agg(F.sum("n_shingles").alias("n")).collect()
    assert blocks and len({(r.i, r.j) for r in blocks}) > 1
    assert max(r.n for r in blocks) < 20_000  # all 40 together have 60,000
    out = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_components(rows, 3, 85))


def test_components(spark):
    """Paths, stars, cycles and a large random graph against union and find."""
    from tidelog.llm.near_dedup import components

    rng = np.random.default_rng(12)
    names = [hashlib.md5(str(k).encode()).digest() for k in range(3_000)]  # noqa: S324
    pairs = [(k, k + 1) for k in range(400)] + [(500, 500 + k) for k in range(1, 300)] + [(900 + k, 900 + (k + 1) % 50) for k in range(50)] + [(1000, 1000)]
    pairs += [tuple(map(int, rng.integers(1500, 3000, 2))) for _ in range(900)]
    root = list(range(3_000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    links = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in components(links).collect()}
    ends = {x for p in pairs if p[0] != p[1] for x in p}
    assert got.keys() == {names[x] for x in ends}
    groups = defaultdict(set)
    for x in ends:
        groups[find(x)].add(got[names[x]])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_sieve(spark, monkeypatch, n):
    """Whatever its size, no row that has a partner is lost."""
    from tidelog.llm import _common

    rows = spark.range(20_000).withColumn("_hash", F.xxhash64("id"))
    for bits in ((20, 27), (7, 8)):
        monkeypatch.setattr(_common, "SIEVE_BITS_LOG2", bits)
        out = _common.sieve(rows, rows.where(F.col("id") < n).select("_hash"))
        assert out.count() == 20_000 and out.where(F.col("id") < n).where("_maybe").count() == n
        if bits[0] == 20:
            assert out.where(F.col("id") >= n).where("_maybe").count() < 1_000


def test_near_dedup_odd_rows(spark, odd, empty):
    from tidelog.llm.near_dedup import banding, drop_near_duplicates, near_duplicates, registers, shingle_set

    rows = near_duplicates(odd, 3, 85).collect()
    assert len(rows) == len(ODD) + 2
    got = {(r.doc_id, r.n_shingles): r for r in rows}
    assert not got[0, 0].n_shingles and got[0, 0].kept and got[1, 0].component_id == 1  # empty ones aren't linked
    assert got[6, 1].component_id == 5 and not got[6, 1].kept
    assert not got[None, 0].kept and got[None, 0].component_id is None
    assert near_duplicates(empty, 3, 85).count() == 0
    left = drop_near_duplicates(odd, 3, 85)
    assert left.columns == odd.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[3] == 1 and ids[None] == 1 and ids[0] == 1
    assert drop_near_duplicates(empty).count() == 0
    whole = shingle_set("a b c d e f g h", 3)
    assert len(whole) == 6 and len(shingle_set("A b", 3)) == 1 and np.array_equal(shingle_set("A B C", 3), shingle_set("a b c", 3))
    bands, per = banding(0.85)
    halves = registers([whole[:3], whole[3:], whole], bands * per)
    assert np.array_equal(np.maximum(halves[0], halves[1]), halves[2])  # mergeable


def test_likelihood_estimate():
    from tidelog.llm.near_dedup import likeliest, registers

    rng = np.random.default_rng(2)
    for similarity in (0.6, 0.85, 0.95):
        errors = []
        for _ in range(20):
            both = int(2000 * similarity / (1 + similarity))
            pool = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
            a, b = pool[: both + (1000 - both)], np.concatenate([pool[:both], pool[1000 : 2000 - both]])
            x, y = registers([np.sort(a), np.sort(b)], 120)
            true = both / (len(a) + len(b) - both)
            found = likeliest(np.array([(x == y).sum()]), np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
            errors.append(found - true)
        assert abs(np.mean(errors)) < 0.04


# --- 10


@pytest.fixture(scope="module")
def encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe(spark, sf_dir, texts, encoding):
    rows = Q.op10_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(encoding, texts[r.doc_id]) for r in rows)


def test_byte_bpe_odd_rows(odd, empty, encoding):
    from tidelog.llm.byte_bpe import encode_documents, round_trip_digests

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = round_trip_digests(odd, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(encoding, ODD[r.doc_id] if r.doc_id is not None else None) for r in rows)
    assert round_trip_digests(empty, path, public_tokenizers.PATTERN).count() == 0
    assert encode_documents(odd, path, public_tokenizers.PATTERN).where("doc_id = 12").first().ids == encoding.encode_ordinary(ODD[12])


@pytest.mark.parametrize("kind", ["letters", "one", "words", "han"])
def test_byte_bpe_long_matches(encoding, kind):
    """Matches of up to a megabyte, in seconds and in bounded memory."""
    import time
    import tracemalloc

    from tidelog.llm.byte_bpe import SegmentTreeBpe, load_ranks

    rng = np.random.default_rng(6)
    text = {"letters": "".join(map(chr, rng.integers(97, 123, 1_000_000))), "one": "a" * 200_000, "words": "".join(rng.choice(["the", "ing", "straße", "tion"], 50_000)), "han": "".join(map(chr, rng.integers(0x4E00, 0x5E00, 60_000)))}[kind]
    own = SegmentTreeBpe(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    began = time.perf_counter()
    ids = np.frombuffer(own.encode_many([text.encode()])[0], dtype="<u4").tolist()
    assert time.perf_counter() - began < 60
    assert own.decode(ids) == text.encode()
    assert ids == encoding._encode_single_piece(text)
    tracemalloc.start()
    own.encode_many([text[:20_000].encode()])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000


def test_one_by_one_as_in_lock_step(encoding):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tidelog.llm.byte_bpe import SegmentTreeBpe, load_ranks

    own = SegmentTreeBpe(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abcdeinrst é漢"), min_size=2, max_size=80))
    def same(text):
        piece = text.encode()
        width = max(2, 1 << (len(piece) - 1).bit_length())
        assert own._merge_one(piece, width) == own._merge([piece], width)[0]

    same()


def test_segment_tree_on_random_strings(encoding):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tidelog.llm.byte_bpe import text_encoder

    own = text_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab \n\t's")), max_size=60))
    def same(text):
        assert own.encode([text])[0].tolist() == encoding.encode_ordinary(text)

    same()


def test_members_of_shared_buckets_are_told_before_a_shuffle(spark):
    """Nodes that are alone in their buckets mostly stay where they are, and all others go on."""
    from pyspark.sql import functions as F

    from tidelog.llm import near_dedup

    members = spark.range(20_000).select(F.when(F.col("id") < 400, F.col("id") % 200).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").cast("binary").alias("node"), F.lit(5).cast("long").alias("n_shingles"))
    members = members.select("node", "n_shingles", F.lit(0).alias("band"), F.xxhash64("k").alias("bucket"))
    shared = near_dedup.shared_buckets(members)
    left = near_dedup.in_shared(members, shared)
    assert left.columns == members.columns and left.count() < 2_000
    assert left.join(shared, "bucket").count() == 400 == members.join(shared, "bucket").count()
