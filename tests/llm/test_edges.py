"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import article, bpe, decontaminate, licenses, merkle, mixture, neardup, passages, private, quality, toxicity, warc
from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k}" for k in range(30_000))
ROWS = [
    (1, None, "en", "src1", None), (2, "", "en", "src1", 0), (3, " \t\n\r\n ", None, None, 6), (None, "a short one", "en", "src2", 11),
    (None, None, None, None, None), (5, LONG, "en", "src1", len(LONG)), (6, LONG, "en", "src1", len(LONG)), (7, LONG + " more", "de", "src2", len(LONG) + 5),
    (8, "mail me at jo@ex.org now or call +1 555 123 4567", "en", "src1", 48), (8, "mail me at jo@ex.org now or call +1 555 123 4567", "en", "src1", 48),
    (8, "the same id with another text that is short", "en", "src0", 43), (9, "!!! ??? ...", "en", "src9x", 11), (10, "x", "en", "", 1),
    (11, "Released under the MIT License.\n" * 3, "en", "src1", 96), (None, LONG, "fr", None, len(LONG)),
]
CLASHING = ["leaf", "presented", "tree", "pos", "size", "part", "place", "ids", "bytes", "level", "n_tokens_", "key_a", "key_b", "id", "hash", "host", "row", "s", "words", "domain", "n_tokens", "copies", "bad", "terms", "root", "start", "_row", "doc", "band", "kept", "whole", "class_id"]
ITEMS = [(1, "word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 word17"), (2, None), (3, ""), (None, "a short one"), (1, "zzz"), (1, "zzz")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def labels_of(spark):
    return spark.createDataFrame([(1, 0, 1), (None, 1, 1), (8, 0, None), (77, 1, 1)], "doc_id long, quality int, toxic int")


def operators(spark, benchmark):
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), *[c for c in d.columns if c in CLASHING and c not in ("page_id", "url", "html")])
    return {
        "op2": lambda d: decontaminate.contamination(d, benchmark), "op3": lambda d: mixture.select(d), "op4": private.findings,
        "op5": lambda d: article.extract(pages(d)), "op6": passages.repeated, "op6 remove": passages.remove, "op7": neardup.near_duplicates,
        "op8": licenses.scan, "op9": lambda d: toxicity.score(d, toxicity.train(d, labels_of(spark))), "op10": quality.assess,
        "op1": lambda d: warc.records(pages(d)), "op11": lambda d: merkle.proofs(merkle.manifest(d)),
        "op12": lambda d: bpe.decode(bpe.encode(d)).drop("bytes"),
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op6 remove", "op7", "op8", "op9", "op10", "op11", "op12"]


@pytest.mark.parametrize("name", NAMES)
def test_operator(spark, docs, clashing, benchmark, name):
    run = operators(spark, benchmark)[name]
    plain, other, none = run(docs), run(clashing), run(docs.limit(0))
    own = [c for c in plain.columns if c not in ("copies", "text_hash")]
    key = lambda rows: sorted(map(repr, rows))
    assert key(other.select(*own).collect()) == key(plain.select(*own).collect())
    assert none.collect() == []
    if name in ("op1", "op2", "op4", "op5", "op6 remove", "op7", "op9", "op10", "op11", "op12"):
        assert plain.count() == len(ROWS)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage(spark, docs, clashing, benchmark, stage, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda d: stage[1](spark, d, str(tmp_path))
    plain, other, none = run(docs), run(clashing), run(docs.limit(0))
    last = stage is corpus_pipeline.STAGES[-1]
    assert plain.columns == docs.columns + ["copies"] * last
    assert other.columns == ([c for c in clashing.columns if c != "copies"] + ["copies"] if last else clashing.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(other.select(*docs.columns).collect()) == key(plain.select(*docs.columns).collect())
    assert none.collect() == [] and none.columns == plain.columns


def test_results_on_edge_rows(spark, docs, benchmark):
    def rows(df, *columns):
        return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

    got = rows(decontaminate.contamination(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items")
    assert got.count((8, 13, 0, 0)) == 2 and (None, 3, 3, 1) in got and (1, 0, 0, 0) in got and (5, 30_000, 11, 1) in got
    got = rows(neardup.near_duplicates(docs), "doc_id", "class_id", "class_size", "kept")
    assert (1, 1, 1, True) in got and (None, None, 1, True) in got and (6, 5, 4, False) in got and (7, 5, 4, False) in got and got.count((8, 8, 2, True)) == 2
    kept = rows(neardup.keep_one(docs), "doc_id", "n_chars")
    assert kept.count((8, 48)) == 1 and (8, 43) in kept and (5, len(LONG)) in kept and (6, len(LONG)) not in kept and (7, len(LONG) + 5) not in kept
    got = rows(quality.assess(docs), "doc_id", "n_words", "base_failed", "kept")
    assert (1, 0, True, False) in got and (5, 30_000, False, True) in got
    got = rows(licenses.scan(docs), "doc_id", "license", "containment")
    assert got == [(11, "MIT", 1.0)]
    assert {r["severity"] for r in toxicity.score(docs, toxicity.Model()).collect()} == {3 / (1 + __import__("math").exp(50.0))}
    got = rows(mixture.select(docs, mixture.Plan(budget_percent=100)), "doc_id", "copies")
    assert got and all(c >= 1 for _, c in got)


def test_pages():
    for page, text in (
        (None, ""), ("", ""), ("<p>", ""), ("no markup", "no markup"), ("<p>a<p>b<div>c", "a b c"), ("<article><p>x &amp; y&nbsp;z<!-- n --><br>w</article><p>out", "x & y z w"),
        ("<script>var a='<p>no</p>'</script><p>yes, yes.</p>", "yes, yes."), ("<nav><a href=/>m</a></nav><main><h1>T</h1><p>t</p><form>f</form></main><footer>f</footer>", "T t"),
        ("<p>5 < 6 and 7 > 3, or so.</p>", "5 < 6 and 7 > 3, or so."), ("<article><p>one</p><div class='comments'><p>two</p></div></article>", "one"),
    ):
        assert article.main_text(page) == text, page


_SENTENCES = "Here is a sentence of the real text, with commas, and it goes on for a while. Another one follows it, as it should."
_BODY = "".join(f"<p>{_SENTENCES} Paragraph {k}.</p>" for k in range(6))
_TEXT = " ".join(f"{_SENTENCES} Paragraph {k}." for k in range(6))
_TOOLS = "".join(f"<div>{word}</div>" for word in ("Print", "Send", "Save", "Rate", "Follow"))


@pytest.mark.parametrize("teaser", ["<article><a href=/x>Read this next</a></article>", "<div class='entry'><p>Short teaser</p></div>", "<article><h2>Next</h2><p>A short teaser</p></article>"])
def test_text_beside_a_teaser_is_kept(teaser):
    assert _TEXT in article.main_text(f"<body><div>{_BODY}</div>{teaser}</body>")


@pytest.mark.parametrize("inner", [f"<h1>Title of it</h1>{_BODY}{_TOOLS}", f"<h1>Title of it</h1>{_TOOLS}{_BODY}"])
def test_unnamed_boilerplate_inside_the_article_is_dropped(inner):
    assert article.main_text(f"<article>{inner}</article><footer>foot</footer>") == f"Title of it {_TEXT}"


@pytest.mark.parametrize("opening", ["<div class='layout has-sidebar'>", "<div id='with-header'>", "<section class='side-by-side'>", "<div class='sidebar'>", "<form>", "<div style='overflow:hidden'>", "<div title='a hidden class=ad x'>"])
@pytest.mark.parametrize("inner", [f"<article>{_BODY}</article>", f"<div>{_BODY}</div>"])
def test_names_around_the_text_do_not_drop_it(opening, inner):
    assert article.main_text(f"{opening}{inner}</{opening[1:].split()[0].strip('>')}><footer>foot</footer>") == _TEXT


def test_what_names_tell_boilerplate_stays_out():
    for rest in (f"<div class='comments'>{_BODY * 4}</div>", f"<div class='related'><article><p>{_SENTENCES}</p></article></div>", f"<div hidden><p>{_SENTENCES}</p></div>"):
        assert article.main_text(f"<article>{_BODY}</article>{rest}") == _TEXT
    assert article.main_text(f"<article><p>{_SENTENCES} With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in it.</p></article>") == f"{_SENTENCES} With x=1 in it."


def test_given_pages_keep_the_whole_article(spark):
    import html
    import re

    from tests.conftest import DATA

    for row in article.extract(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        assert row["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and row["n_chars"] == len(row["text"])


def made_pages(seed, n):
    import random

    rng = random.Random(seed)
    names = "div p li ul a b span article main header nav figure footer h1 h2 table tr td section form dl dt dd br".split()
    texts = ["text here, of some length.", "a", "more words, and more; indeed: so it goes on and on.", "&amp;", "x &lt; y", "another sentence that is long enough to count, I think."]
    attributes = [""] * 6 + [" class='ad'", ' class="content"', " hidden", " class=comments", " title='a > b'", "'"]
    for _ in range(n):
        piece = lambda: rng.choice([f"<{rng.choice(names)}{rng.choice(attributes)}>", f"</{rng.choice(names)}>", rng.choice(texts), rng.choice(texts)])
        yield "".join(piece() for _ in range(rng.randint(1, 60)))


def test_ratios_match_plain_version(spark):
    from tests.conftest import DATA

    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()] + [*made_pages(1, 3000)]
    kept = set()
    for page in pages:
        found, paths = article.blocks(page)
        names = []
        for parent, name in paths:
            names.append([*names[parent], name] if parent >= 0 else [])
        keep = brute.content(found, names)
        kept.update(keep)
        assert article.main_text(page) == " ".join(b[2] for b, k in zip(found, keep) if k), page
    assert kept == {True, False}


@pytest.mark.parametrize("piece", ["<a '", "<a '\"", "<a", "<div>", "<nav>x", "</p>", "<tbody>", "<!-- <", "<i><div><b>", "<", "<a href='x", "<p><b>", "&#", "<body><head>"])
def test_time_grows_with_the_page(piece):
    """Hostile markup: four times the page takes nowhere near sixteen times as long."""
    import time

    def seconds(n):
        started = time.process_time()
        article.main_text("<div>" * 100 + piece * n + "</i></p>" * n + "x</div>'>")
        return time.process_time() - started

    seconds(500)
    small = min(seconds(5_000) for _ in range(3))
    assert seconds(20_000) < 9 * small + 0.3


def test_numbers_of_any_length_in_source_names(spark):
    names = ["src7", "src99999999999", "src" + "8" * 60, "1234567890123456789012345678901234567890", "x-2147483648", "٣", "src", None]
    df = spark.createDataFrame([(k, "w " * 10, "en", s, 20) for k, s in enumerate(names)], DOCUMENTS)
    expected = ["web" if s is None or not s[-1:].isascii() or not s[-1:].isdigit() else ["web", "forum", "books"][int("".join(c for c in s if c.isdigit())) % 3] for s in names]
    assert [r["domain"] for r in mixture.with_levels(df).orderBy("doc_id").collect()] == expected
    assert mixture.select(df, mixture.Plan(budget_percent=100)).count() > 0


def test_shares_of_shortages(spark):
    """A child that runs out gives its rest to its siblings before its parent's siblings get any."""
    docs = [(k, "w " * 10, "en", "src0", 20) for k in range(10)] + [(100 + k, "w " * 10, "de", "src0", 20) for k in range(90)] + [(300 + k, "w " * 10, "en", "src1", 20) for k in range(100)]
    plan = mixture.Plan(weights={"domain": {"web": 50, "forum": 50}, "lang": {"en": 50, "de": 50}}, budget_percent=50, epochs=1)
    got = {r["doc_id"]: r["copies"] for r in mixture.select(spark.createDataFrame(docs, DOCUMENTS), plan).collect()}
    assert sum(i < 100 for i in got) == 10 and sum(100 <= i < 300 for i in got) == 40 and sum(i >= 300 for i in got) == 50
    expected = brute.mixture([d[:4] for d in docs], plan, lambda s: ["web", "forum", "books"][int(s[3:]) % 3])
    assert got == {d[0]: c for d, c in zip(docs, expected) if c}
