"""Operators 3 to 9 and the pipeline on small fixtures."""

import html
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolake.llm import html_text, mixing, packing, quality, tokens, toxicity, warc
from pyspark.sql import functions as F

EXTRA = "source string, n_chars long, score double"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "Don't STOP, now. 3.5 times; naïve ÉTÉ Straße…"), (5, "x" * 200_000), (6, "a " * 5000), (7, "<|endoftext|> <|StartOfText|> end."), (8, "tie"), (9, "tie"), (9, "tie"), (None, "no id"), (10, "Σίσυφος ΟΔΟΣ é ß z")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 0.5) for i, t in rows], f"doc_id long, text string, {EXTRA}")


def no_docs(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(spark, tokenizer):
    got = packing.best_fit_packing(docs(spark, ODD), size=64).collect()
    want = []
    for i, t in ODD:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(no_docs(spark)).count() == 0


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert fit.put(3) == (1, 7)  # the tightest fit, full now
    assert fit.put(9) == (2, 0)
    assert fit.put(8) == (3, 0)  # at two open bins the fullest, 2, has closed
    assert fit.put(1) == (3, 8) and fit.put(4) == (0, 6)


def test_lengths(spark, tokenizer):
    counted = tokens.lengths(docs(spark, ODD))
    n = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in ODD)
    assert sorted(r.n_tokens for r in counted.collect()) == n
    h = tokens.length_histogram(counted, block=16)
    for limit in (0, 1, 2, 7, 100, 10**9):
        assert tokens.truncated_total(h, limit) == sum(min(limit, x) for x in n)
    for q in (0, 0.25, 0.5, 0.9, 1):
        assert tokens.quantile(h, q) == n[int(q * (len(n) - 1))]
    for r in h.collect():
        assert r.n_docs == n.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.n_tokens) and r.truncated_total == sum(min(x, r.n_tokens) for x in n)
    assert tokens.length_histogram(tokens.lengths(no_docs(spark))).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>{n}</a></ul></nav><!-- x --><div class='ad'>buy {n}</div><article><h1>{t}</h1><p>{b}<p>More <b>of</b> it{t}<br>end</p><p>Share this story now</p></article><section id='comments'><p>first!</p></section><footer>&copy; {n}</footer></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 3) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars long")


def test_pages(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(t=f"Title {i} &amp; co", n=f"nav{i}", b=f"Body {'word ' * i}\n\t of {i}")) for i in range(12)]
    odd = [(100, None, None), (101, "", ""), (102, "http://a/", "plain &lt;text&gt; &eacute;"), (103, "http://a/", "<p>cut <b>off</p><p"), (104, "http://a/", "<script>x</script>"), (105, "http://b/", "<main>m<aside>s</aside></main>rest")]
    got = {r.page_id: r for r in html_text.page_texts(pages(spark, rows + odd)).collect()}
    for i in range(12):
        t = f"Title {i} & co"
        assert got[i].text == " ".join(f"{t} Body {'word ' * i} of {i} More of it{t} end".split())  # the shared line is the template's
        assert got[i].n_chars == len(got[i].text) and got[i].url == f"https://h.example/{i}"
    assert [got[k].text for k in range(100, 106)] == ["", "", "plain <text> é", "cut off", "", "m"]
    assert html_text.page_texts(pages(spark, [])).count() == 0


def test_copies_are_no_template():
    page = PAGE.format(t="Same", n="n", b="one article")
    assert "one article" in html_text.extract([page] * 20)[3]


def test_template_of_odd_few_and_untitled_pages():
    """Pages without markup, a constant title and small hosts do not switch the template off; copies still are no evidence."""
    varied = [PAGE.format(t="Site", n=f"nav{i}", b=" ".join(f"w{i}x{k}" for k in range(9))) for i in range(20)]
    for some in (varied, varied[:2], varied[:5]):
        got = html_text.extract([*some, "", "no markup"])
        assert [("Share this" in g, f"w{i}x8" in g) for i, g in enumerate(got[: len(some)])] == [(False, True)] * len(some)
        assert got[len(some) :] == ["", "no markup"]
    odd = html_text.extract([*varied, "<p>gone</p>"])
    assert not any("Share this" in g for g in odd) and odd[-1] == "gone"
    near = html_text.extract([PAGE.format(t=f"Copy {i}", n="n", b="one article of many words") for i in range(3)])
    assert all("one article of many words" in g for g in near)


def test_everyday_names_within_an_article_stay():
    kept = "<div class='entry-header'><h1>title</h1></div><p class='byline'>by me</p><h2 id='search'>find</h2><h2 id='cookies'>baking</h2><section id='discussion'>results <b>mean</b></section><section id='related-work'>others</section><p id='legal'>law</p><div class='notice'>seen</div>"
    gone = "<div class='ad'>a1</div><div class='cookie-bar'>a2</div><div id='sidebar'>a3</div><section id='comments'>a4</section><div role='navigation'>a5</div><nav>a6</nav>"
    for region in ("article", "main"):
        page = f"<body><div class='menu'>b1</div><{region} class='discussion'>{kept}{gone}{'<article class=reply>a7</article>' * (region == 'article')}</{region}><div id='respond'>b2</div></body>"
        assert html_text.extract([page]) == ["title by me find baking results mean others law seen"]
    assert html_text.extract(["<body><div class='menu'>b1</div><h2 id='contact'>head</h2><p>text</p><div id='respond'>b2</div></body>"]) == ["head text"]


PLAIN = "<html><body><div><a href='/'>{n}</a> <a href='/b'>{n}b</a></div><div>buy {n} now</div><div><h1>{t}</h1>{b}</div><div>about {n} us</div></body></html>"


@pytest.mark.parametrize("n", [2, 3, 12])
def test_article_of_pages_without_telling_names(monkeypatch, n):
    """Plain divs alone: the template finds the article, and without it the text is wrong."""
    bodies = [" ".join(f"<p>{' '.join(f'w{i}x{k}x{j}' for j in range(8 + i))}" for k in range(2 + i % 3)) for i in range(n)]
    some = [PLAIN.format(n=f"nav{i}", t=f"Title {i}", b=b) for i, b in enumerate(bodies)]
    want = [f"Title {i} " + " ".join(re.sub("<p>", " ", b).split()) for i, b in enumerate(bodies)]
    assert html_text.extract(some) == want
    monkeypatch.setattr(html_text, "template", lambda pages: html_text.Template())
    assert all(g != w and w in g for g, w in zip(html_text.extract(some), want, strict=True))


def test_article_of_two_containers_and_a_heading_beside_it():
    words = lambda i, k: " ".join(f"w{i}x{k}x{j}" for j in range(30))
    some = [f"<body><div><a href='/'>home{i} sweet home{i}</a></div><h1>Title {i}</h1><div><p>{words(i, 0)}</div><div>tiny ad {i}</div><div><p>{words(i, 1)}<p>{words(i, 2)[: 80 + i]}</div></body>" for i in range(4)]
    assert html_text.extract(some) == [f"Title {i} {words(i, 0)} {words(i, 1)} {words(i, 2)[: 80 + i]}".strip() for i in range(4)]


def prose(i, k, n):
    return " ".join(f"w{i}x{k}x{j}" for j in range(n))


OUTER = "<html><body><div class='top'><a href='/'>Home</a> <a href='/b'>Blog</a></div>{}<div class='end'>About us all</div></body></html>"


@pytest.mark.parametrize("pages_", [4, 20])
@pytest.mark.parametrize(
    "inside",
    [
        "<article><div class='lead'><p>{a}</p></div><div class='text'><p>{c}</p></div></article>",
        "<div class='content'><div class='lead'><p>{a}</p></div><div class='text'><p>{c}</p></div></div>",
        "<div class='post'><section><p>{a}</p></section><section><p>{b}</p></section><section><p>{c}</p></section></div>",
        "<section><p>{a}</p></section><section><p>{b}</p></section><section><p>{c}</p></section>",
        "<div class='outer'><div class='inner'><div><p>{a}</p></div><div><div><p>{b}</p></div><p>{c}</p></div></div></div>",
    ],
)
def test_no_part_of_the_article_is_lost_for_its_size(inside, pages_):
    bodies = [{"a": prose(i, "a", 25), "b": prose(i, "b", 60), "c": prose(i, "c", 300 + i)} for i in range(pages_)]
    some = [OUTER.format(inside.format(**b)) for b in bodies]
    assert html_text.extract(some) == [" ".join(b[k] for k in "abc" if "{" + k + "}" in inside) for b in bodies]


@pytest.mark.parametrize("name", ["share-layout", "page search", "notice-board", "has-header", "with-sidebar"])
@pytest.mark.parametrize("element", ["div", "section"])
def test_names_of_wrappers_do_not_empty_a_page(name, element):
    bodies = [f"{prose(i, 'a', 30)} {prose(i, 'b', 150 + i)}" for i in range(12)]
    some = [f"<body><{element} class='{name}'><div class='sidebar'>Newest {prose(i, 's', 12)}</div><div class='x'><p>{b}</p></div></{element}><div class='cookie-notice'>We use {prose(i, 'k', 9)}</div></body>" for i, b in enumerate(bodies)]
    assert html_text.extract(some) == bodies


def test_long_named_comments_go():
    bodies = [prose(i, "a", 60) for i in range(10)]
    some = [OUTER.format(f"<div class='post'><p>{b}</p></div><div class='comments'>" + "".join(f"<div class='c'><p>{prose(i, f'k{k}', 40)}</p></div>" for k in range(5 + i % 3)) + "</div>") for i, b in enumerate(bodies)]
    assert html_text.extract(some) == bodies


def test_long_and_repeated_pages(spark):
    long = PAGE.format(t="Long", n="n", b="word " * 400_000)
    short = [(i, "http://h/", PAGE.format(t=f"T{i}", n=f"n{i}", b=f"b{i} " * 9)) for i in range(3)]
    got = [(r.page_id, r.n_chars, r.text[:9]) for r in html_text.page_texts(pages(spark, [*short, (9, "http://h/", long), short[0], short[0]])).collect()]
    assert [g[0] for g in sorted(got)] == [0, 0, 0, 1, 2, 9] and len({g for g in got if g[0] == 0}) == 1
    assert dict((g[0], g[1]) for g in got)[9] > 2_000_000


def test_real_pages(spark, tiny):
    for r in html_text.op3_html_text(spark, tiny).join(spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())


def test_warc(spark):
    big = "é" * 1_500_000
    rows = [(1, "u", big), (2, None, big), (3, "a\nb", None), (4, "u", "x"), (5, "u", "x"), (None, "q", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (6, "u", "y" * 100), (7, "u", "y" * 100), (7, "u", "y" * 100)]
    import hashlib

    got = warc.round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, h in rows:
        data = (h or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (rs[0].record_type, rs[0].refers_to) for i, rs in by.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None), 6: ("response", None), 7: ("revisit", 6)}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_chunks(spark):
    from aerolake.runtime import fresh_path, materialize

    data = "ab" * 1_700_000
    folder = fresh_path(spark, "warc-test")
    rows = warc.choose_originals(pages(spark, [(1, "u", data), (2, "v", "")]))
    chunks = warc.read_chunks(materialize(warc.write_archives(rows, folder), "list"), folder).orderBy("page_id", "chunk_no").collect()
    first = [r for r in chunks if r.page_id == 1]
    assert b"".join(bytes(r.data) for r in first) == data.encode() and len(first) == 4 and all(len(r.data) <= warc.CHUNK for r in first)
    assert [r.last for r in first] == [False, False, False, True] and len({r.digest_so_far for r in first}) == 4
    assert [r.bytes_so_far for r in chunks if r.page_id == 2] == [0]


def test_archives_are_read_by_many_tasks(spark):
    """24 archives are read by more than one task, with adaptive execution on."""
    from aerolake.runtime import fresh_path, materialize

    folder = fresh_path(spark, "warc-many")
    rows = pages(spark, [(i, "u", f"page {i} " * 50) for i in range(240)]).repartition(24, "page_id")
    written = materialize(warc.write_archives(warc.choose_originals(rows).repartition(24, "page_id"), folder), "list")
    n = written.count()
    assert n >= 16 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    read = warc.read_chunks(written, folder, with_data=False)
    parts = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > n / 2 and read.where("last").count() == 240


def corpus(n=400):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 60))
        bad, toxic = i % 6 == 0, i % 5 == 1 and i % 6 != 0
        if bad:
            text = " ".join(x + "***" for x in text.split())
        if toxic:
            text += " you horrid blockhead " + text[:50] + " blockheads"
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
        elif i % 4 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_quality(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(1000, None), (1001, ""), (None, "w1 w2 w3"), (1, rows[1][1])])
    sampler = quality.fit(d, lab)
    kept = {r.doc_id for r in quality.resample(d, lab).where("kept").collect()}
    assert all((i in kept) == (i % 6 != 0) for i, _ in rows)
    assert {r.doc_id for r in sampler.rows(d).collect()} == kept and sampler.rows(d).columns == d.columns
    assert quality.resample(d, lab, keep=50).where("kept").count() == 50
    assert quality.resample(no_docs(spark), lab).count() == 0
    assert quality.resample(d, lab.where("quality = 1")).where("not kept").count() == 0


def test_top_k_cut(spark):
    rng = np.random.default_rng(9)
    values = [(float(v), int(t)) for v, t in zip(np.round(rng.normal(0, 3, 500), 1), rng.permutation(500), strict=True)]
    df = spark.createDataFrame(values, "key double, tie long")
    for k in (1, 7, 250, 499):
        cut, tie = quality.top_k_cut(df, k)
        assert sorted(v for v in values if v > (cut, tie) or v == (cut, tie)) == sorted(values, reverse=True)[:k][::-1]


def test_top_k_cut_of_many_ties(spark):
    rng = np.random.default_rng(19)
    ties = rng.integers(-(1 << 63), (1 << 63) - 1, 300).tolist() + [-(1 << 63), (1 << 63) - 1, 0, -1, 5, 5]
    df = spark.createDataFrame([(1.5, t) for t in ties] + [(2.0, 3)], "key double, tie long")
    for k in (2, 3, 150, 306):
        cut, tie = quality.top_k_cut(df, k)
        assert cut == 1.5 and tie == sorted(ties, reverse=True)[k - 2]


def test_log_weights_by_brute_force(spark):
    """Log ratios and weights by counting whole-text n-grams in plain Python; a very long text and repeated rows too."""
    import math
    from collections import Counter

    from aerolake.llm.grams import Grams

    rows = [(1, "good words here"), (2, "good words there"), (3, "bad bad things"), (4, "good bad"), (5, "words " * 60_000), (4, "good bad"), (6, None)]
    marks = {1: 1, 2: 1, 3: 0}
    seed = next(s for s in range(100) if not any(r.h for r in spark.createDataFrame([(i,) for i in marks], "doc_id long").select(quality.held_back(F.col("doc_id"), s).alias("h")).collect()))
    lab = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = {(r.doc_id, r.n_grams): r.log_weight for r in quality.resample(docs(spark, rows), lab, buckets=64, seed=seed, keep=3).collect()}
    own, counts = Grams(64), {0: Counter(), 1: Counter()}
    for i, t in rows:
        counts[0].update(own.of((t or "").encode()).tolist())
        if marks.get(i) == 1:
            counts[1].update(own.of((t or "").encode()).tolist())
    p = lambda c, b: (counts[c][b] + 1) / (sum(counts[c].values()) + 64)
    for i, t in rows:
        grams_ = own.of((t or "").encode()).tolist()
        assert math.isclose(got[i, len(grams_)], sum(math.log(p(1, b) / p(0, b)) for b in grams_), rel_tol=1e-9, abs_tol=1e-9)


def test_quality_of_labels_held_out(spark):
    """Rows whose labels are not given are kept and rejected as theirs would say."""
    rows, labels = corpus(900)
    lab = spark.createDataFrame([x for x in labels if x[0] % 7], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(docs(spark, rows), lab).where("kept").collect()}
    unseen = [(i, q) for i, q, _ in labels if not i % 7]
    assert sum((i in kept) == (q == 1) for i, q in unseen) / len(unseen) > 0.97


def test_toxicity_of_long_repeated_and_empty_tables(spark):
    rows, labels = corpus(900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    long = "w1 w2 " * 100_000
    d = docs(spark, [*rows, (6001, long + " you horrid blockhead " * 40), (6000, long), (6000, long), rows[1], rows[1]])
    model = toxicity.learn(d, lab)
    got = toxicity.scored(d, model).collect()
    assert len(got) == len(rows) + 5 and len({r.score for r in got if r.doc_id == 6000}) == 1
    score = {r.doc_id: r.score for r in got}
    assert score[6001] > score[6000]
    assert toxicity.learn(no_docs(spark), lab).weights is None and toxicity.scored(no_docs(spark), model).count() == 0


def test_copies_teach_no_toxic_words():
    """Copies of one toxic document do not make its ordinary words toxic."""
    rows, labels = corpus(900)
    known = {i: t for i, _, t in labels}
    texts = [(t.encode(), known[i]) for i, t in rows if i in known] + [(b"only here said quite plain things today", 1)] * 60
    model = toxicity.train([t for t, _ in texts], [y for _, y in texts])
    content = toxicity.split_dictionary(model.toxic)[1]
    assert b"blockh" in content and b"quite" not in content and b"plain" not in content


def test_toxicity(spark):
    rows, labels = corpus(900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(5000, None), (5001, ""), (None, "w1")])
    got = {r.doc_id: r for r in toxicity.scored(d, toxicity.learn(d, lab)).collect()}
    for i in (3, 4, 5001):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i, _ in rows if got[i].held_out]
    right = sum(got[i].predicted == int(i % 5 == 1 and i % 6 != 0) for i in held)
    assert right / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got.values()) and got[5000].predicted == 0
    assert toxicity.scored(no_docs(spark), toxicity.Model()).count() == 0
    assert {r.score for r in toxicity.scored(d, toxicity.learn(d, lab.where("toxic = 0"))).collect()} == {0.0}


def test_mixing(spark):
    rows, labels = corpus(900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(5000, None), (5001, "")])
    got = mixing.mixed(d, lab, targets={"good": 0.9, "poor": 0.05, "toxic": 0.05}).collect()
    by = {r.doc_id: r for r in got}
    right = sum(max(("good", "poor", "toxic"), key=lambda k: by[i][f"p_{k}"]) == ("poor" if i % 6 == 0 else "toxic" if i % 5 == 1 else "good") for i, _ in rows)
    assert right / len(rows) > 0.95
    total = {k: sum(r.rate * r.tokens * r[f"p_{k}"] for r in got) for k in ("good", "poor", "toxic")}
    whole = sum(total.values())
    assert all(abs(total[k] / whole - t) < 0.01 for k, t in (("good", 0.9), ("poor", 0.05), ("toxic", 0.05)))
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)
    assert max(r.copies for r in mixing.mixed(d, lab, most=1.0).collect()) <= 1
    assert mixing.mixed(no_docs(spark), lab).count() == 0
    assert {r.rate for r in mixing.mixed(d, lab.where("doc_id < 0")).collect()} == {1.0}


def test_mixing_counts_ids(spark, tokenizer):
    """Tokens are those of the tokenizer, and posteriors those of the whole text's stems."""
    from aerolake.llm.grams import Grams

    rows = [*ODD, (11, "Straße.Haus, foo*** a.b c... <b>x</b> foo*** again again again. " * 3)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.tokens for r in mixing.mixed(docs(spark, rows), none).collect()) == sorted(len((t or "").encode().split()) for _, t in rows)
    got = mixing.mixed(docs(spark, rows), none, vocabulary=public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r.tokens for r in got) == sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    chunks, own = mixing.Chunks(public_tokenizers.path("word_bpe_49k.json"), most=50), Grams(*mixing.KIND)
    for _ in range(2):
        for _, t in rows:
            n, buckets = chunks.of([(t or "").encode()])[0]
            assert buckets.tolist() == own.of((t or "").encode()).tolist()
            assert n == len(tokenizer.encode(t or "", add_special_tokens=False).ids)


def test_steps_reach_the_least_squares(spark):
    """Bounded rates against a plain projected gradient in numpy."""
    rng = np.random.default_rng(10)
    p = np.round(rng.dirichlet((1, 1), 40), 3)
    p[:, 1] = 1 - p[:, 0]
    t = rng.integers(1, 100, 40).astype(float)
    df = spark.createDataFrame([(int(n), v.tolist()) for n, v in zip(t, p, strict=True)], "tokens long, p array<double>")
    goal = [0.6 * t.sum(), 0.45 * t.sum()]
    steps = mixing.fit_rates(df, goal, 2.0, rounds=100, within=1e-9)
    rate = np.array([r.rate for r in df.select("p", mixing.rate_of(F.col("p"), steps, 2.0).alias("rate")).collect()])
    assert np.abs((rate * t) @ p - goal).max() < 1e-3 * t.sum() and rate.min() >= 0 and rate.max() <= 2


def test_pipeline(spark, tiny):
    import corpus_pipeline

    before = spark.read.parquet(f"{tiny}/documents.parquet")
    docs_, ids = before, {r.doc_id for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, tiny)
        assert docs_.columns == before.columns, name
        now = [r.doc_id for r in docs_.collect()]
        assert len(now) == len(set(now)) and set(now) <= ids
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, tiny)
    assert {r.doc_id for r in packed.collect()} == ids


@pytest.mark.parametrize("stage", ["keep_good", "drop_copies", "drop_near_copies", "mix"])
def test_pipeline_stages_on_odd_rows(spark, tiny, stage, tmp_path):
    """Nulls, empty and very long texts, repeated ids with different texts, repeated rows, an empty table, extra columns."""
    import corpus_pipeline

    rows, labels = corpus(300)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    near = rows[2][1].split()
    near = " ".join(near + near[:30] + near[30:])
    odd = [(700, near), (2, "quite another text of its own " * 3), (None, near), (None, "a text without id that stands alone " * 3), (None, None), (701, ""), (702, "w1 " * 100_000), (None, "a text without id that stands alone " * 3)]
    df = docs(spark, [*rows, *odd])
    got = getattr(corpus_pipeline, stage)(spark, df, str(tmp_path))
    assert got.columns == df.columns
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert {t for _, t in texts} <= {t for _, t in [*rows, *odd]}
    if stage in ("drop_copies", "drop_near_copies"):  # no text goes but with a copy of it
        assert (2, odd[1][1]) in texts and any(t == odd[3][1] for _, t in texts)
        assert sum(t == odd[3][1] for _, t in texts) == 1
        assert sum(t in (None, "") for _, t in texts) == 1
    if stage == "mix":
        assert all(any(t == row[1] for _, t in texts) for row in rows if row[0] % 6 and row[0] % 5 != 1)
    assert getattr(corpus_pipeline, stage)(spark, no_docs(spark), str(tmp_path)).count() == 0


def test_pack_of_odd_rows(spark, tiny):
    import corpus_pipeline

    got = corpus_pipeline.pack(spark, docs(spark, ODD), tiny)
    assert got.where("piece = 0").count() == len(ODD) and corpus_pipeline.pack(spark, no_docs(spark), tiny).count() == 0


def test_pipeline_copies(spark, tiny):
    import corpus_pipeline

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (None, " q "), (2, "zz"), (3, "zz"), (3, "y")]
    got = corpus_pipeline.drop_copies(spark, docs(spark, rows), tiny).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(1, "a b c d e f"), (2, "zz"), (3, "y"), (None, " q ")], key=str)
