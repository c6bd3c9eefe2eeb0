"""Operators of the training-data subpackage against SQL and plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import catalogue, common, decontaminate, mixture, neardup, passages, private, quality, toxicity, warc
from tests.conftest import DATA
from tests.llm import brute
from tests.test_registered_queries import table


def rows_of(spark, columns="doc_id, text"):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").selectExpr(*columns.split(", ")).collect()]


def test_all_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = table(columns, result.fetchall())
    assert expected
    assert table(df.columns, df.collect()) == expected


def test_private_data_matches_plain_version(spark):
    limits = private.Disclosure()
    docs = rows_of(spark)
    found = {r["doc_id"]: r for r in private.findings(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    clean = {r["doc_id"]: r["text"] for r in private.sanitise(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    for (doc_id, text), (spans, marks) in zip(docs, brute.private(docs, limits)):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        terms = ",".join(f"term:{a}:{b}" for a, b in sorted(marks))
        row = found[doc_id]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert row["spans"] == ",".join(x for x in (base, terms) if x)
        assert [row[f"n_{k}"] for k in private.KINDS] == [sum(s[0] == k for s in spans) for k in private.KINDS]
        assert clean[doc_id] == brute.sanitised(text, spans, marks)


def test_patterns_on_hard_texts(spark):
    texts = [
        "a@b.c_x@d.e", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "+1 (2) 345-67-89 +12 +1----------9",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "x" * 5000 + "@" + "y." * 3000 + "z", "9" * 5000, "ab@cd 1.2.3", "🙂 a@b.cd 🙂 1.2.3.4",
        "5500005555555559 12 4111 1111 1111 1111 77",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in private.findings(df).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in brute.base_spans(texts[row["doc_id"]]))
        assert row["spans"] == base, texts[row["doc_id"]][:60]


def test_disclosing_terms_are_marked(spark):
    docs = [(k, "Contact the ombudsman Zorro now at zorro@mail.example please, and the rest") for k in range(8)]
    docs += [(50 + k, "The ombudsman is away and the rest of it too") for k in range(2)]
    docs += [(100 + k, f"the rest of it is plain text and number {k} now please contact at") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = {r["doc_id"]: r for r in private.findings(df).collect()}
    assert {i: r["n_term"] for i, r in found.items()} == {i: len(m) for (i, _), (_, m) in zip(docs, brute.private(docs, private.Disclosure()))}
    assert all(r["n_term"] == 0 for i, r in found.items() if i >= 50)
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in private.sanitise(df).collect()}
    text = "Contact the [TERM]  now at [EMAIL] please, and the rest"
    assert clean[0] == (text, len(text)) and clean[50][0] == docs[8][1]


def test_disclosing_terms_are_marked_far_from_the_mention(spark):
    filler = "the rest of it is plain text and " * 6
    near = f"Ask the ombudsman at zorro@mail.example please, {filler} the Ombudsman again"
    docs = [(k, near) for k in range(4)]
    docs += [(10 + k, f"zorro@mail.example writes {filler} as the ombudsman, number {k}") for k in range(4)]
    docs += [(30 + k, f"far@mail.example writes {filler} as warden, please ask at number {k} again") for k in range(4)]
    docs += [(100 + k, f"ask at {filler} please again and number {k} writes as the rest") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = {r["doc_id"]: r for r in private.findings(df).collect()}
    assert {i: r["n_term"] for i, r in found.items()} == {i: len(m) for (i, _), (_, m) in zip(docs, brute.private(docs, private.Disclosure()))}
    assert found[0]["n_term"] == 2 and all(found[i]["n_term"] == 1 for i in (10, 13, 30, 33)) and found[100]["n_term"] == 0
    clean = {r["doc_id"]: r["text"].lower() for r in private.sanitise(df).collect()}
    assert not any("ombudsman" in t or "warden" in t for t in clean.values())


def test_near_duplicates_match_all_pairs(spark):
    docs = rows_of(spark)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert found == dict(zip([i for i, _ in docs], brute.near_classes(docs)))
    assert len(set(found.values())) < len(docs)


def test_chained_near_duplicates_form_one_class(spark):
    import random

    random.seed(5)
    words = [f"w{random.randrange(10**6)}" for _ in range(200)]
    docs, state = [], list(words)
    for k in range(60):  # each copy changes one word of the one before
        docs.append((k, " ".join(state)))
        state[(k * 37) % 200] = f"n{k}"
    docs += [(1000 + k, " ".join(f"u{random.randrange(10**6)}" for _ in range(100))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert found == dict(zip([i for i, _ in docs], brute.near_classes(docs)))
    assert {found[k] for k in range(60)} == {0}


def test_components(spark):
    import random

    from shutterlake.llm.cluster import components

    random.seed(3)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(400 + k, 401 + k) for k in range(50)] + [(600, 600 + k) for k in range(40)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        ra, rb = brute.find(parent, a), brute.find(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    expected = {x: brute.find(parent, x) for a, b in pairs if a != b for x in (a, b)}
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == expected


def test_long_shared_passages_are_found(spark):
    docs = rows_of(spark)
    found = {}
    for r in passages.repeated(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    shared = brute.shared_runs(docs)
    assert any(shared.values())
    for doc_id, spans in shared.items():
        for a, b in spans:
            assert any(x < b and a < y for x, y in found.get(doc_id, [])), (doc_id, a, b)
    # What is reported stands elsewhere too, up to the similarity of lines.
    short = brute.shared_runs(docs, 8)
    for doc_id, spans in found.items():
        assert short[doc_id] and all(any(x < b and a < y for x, y in short[doc_id]) for a, b in spans)


def test_similar_lines_meet(spark):
    import random

    random.seed(4)
    line = [f"w{random.randrange(10**6)}" for _ in range(120)]
    changed = [*line[:60], "other", *line[61:]]
    docs = [(1, " ".join(line) + "\nfirst"), (2, "second\n" + " ".join(changed)), (3, " ".join(f"z{k}" for k in range(90)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = passages.similar_lines(df, passages.paragraphs(df)).collect()
    assert len(found) == 2 and len({r["root"] for r in found}) == 1
    whole = [r for r in passages.repeated(df).collect() if r["doc_id"] == 2]
    assert any(r["stop"] - r["start"] == len(" ".join(changed)) and r["removed"] for r in whole)


def test_passage_in_the_middle_of_a_line_is_removed(spark):
    import random

    random.seed(9)
    text = lambda n, tag: " ".join(f"{tag}{random.randrange(10**6)}" for _ in range(n))
    passage = text(55, "p")
    docs = [(k, f"{text(70, 'a')} {passage} {text(80, 'b')}") for k in range(6)] + [(50 + k, text(150, "c")) for k in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = passages.repeated(df).collect()
    assert {r["doc_id"] for r in found} == set(range(6)) and {r["first_doc_id"] for r in found} == {0}
    assert all(r["removed"] == (r["doc_id"] != 0) for r in found)
    left = {r["doc_id"]: r["text"] for r in passages.remove(df).collect()}
    assert left[0] == docs[0][1] and all(left[50 + k] == docs[6 + k][1] for k in range(6))
    assert all(len(left[k]) < len(docs[k][1]) for k in range(1, 6))


@pytest.mark.parametrize("size", [50, 60, 100, 300])
def test_whole_passages_are_covered(spark, size):
    import random

    random.seed(size)
    text = lambda n, tag: " ".join(f"{tag}{random.randrange(10**6)}" for _ in range(n))
    docs, spans = [], {}
    for k in range(12):
        passage = text(size, "p")
        for doc_id in (2 * k, 2 * k + 1):
            before = text(random.randrange(5, 90), "a")
            docs.append((doc_id, f"{before} {passage} {text(80, 'b')}"))
            spans[doc_id] = (len(before) + 1, len(before) + 1 + len(passage))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = sorted((r["doc_id"], r["start"], r["stop"], r["removed"]) for r in passages.repeated(df).collect())
    assert found == [(i, a, b, i % 2 == 1) for i, (a, b) in sorted(spans.items())]
    left = {r["doc_id"]: r["text"] for r in passages.remove(df).collect()}
    assert all(left[i] == t[:spans[i][0]] + t[spans[i][1]:] for i, t in docs if i % 2)


def test_whole_passages_with_a_change_or_a_shorter_first_copy(spark):
    import random

    random.seed(8)
    words = lambda n, tag: [f"{tag}{random.randrange(10**6)}" for _ in range(n)]
    passage, changed = words(120, "p"), words(110, "q")
    docs = [  # the first document has 60 of the 120 words that the two others share
        (0, [*words(30, "a"), *passage[20:80], *words(30, "b")]), (1, [*words(30, "a"), *passage, *words(30, "b")]), (2, [*words(30, "a"), *passage, *words(30, "b")]),
        (3, [*words(30, "a"), *changed, *words(30, "b")]), (4, [*words(30, "a"), *changed[:100], "other", *changed[101:], *words(30, "b")]),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    removed = {}
    for r in passages.repeated(df).where("removed").collect():
        removed.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    place = lambda i, a, b: set(range(len(" ".join(docs[i][1][:a])) + 1, len(" ".join(docs[i][1][:b]))))
    assert removed[2] == place(2, 30, 150) and removed[4] == place(4, 30, 140)
    assert set(removed) == {1, 2, 4} and removed[1] == place(1, 50, 110)


def test_short_similar_lines_meet(spark):
    import random

    random.seed(12)
    docs = []
    for k in range(100):  # 8 of 9 shingles are shared
        line = " ".join(f"w{random.randrange(10**6)}" for _ in range(12))
        docs += [(2 * k, f"{line}\nfirst"), (2 * k + 1, f"second\n{line} more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r["doc_id"] for r in passages.repeated(df).where("removed").collect() if r["stop"] == len(docs[r["doc_id"]][1]) and r["start"] == 7}
    assert whole == {2 * k + 1 for k in range(100)}


def test_surroundings_are_kept_once_for_places_that_match_alike(spark, monkeypatch):
    import random

    random.seed(21)
    words = lambda n, tag: [f"{tag}{random.randrange(10**6)}" for _ in range(n)]
    passage, copied = words(150, "p"), [words(60, "a"), words(60, "b")]
    texts = [[*copied[0], *passage, *copied[1]]] * 30 + [[*words(40, "c"), *passage, *words(40, "d")] for _ in range(2)]
    texts.append([*words(40, "e"), *passage, *words(50, "f"), *passage, *words(40, "g")])  # twice in one document
    rows = {}

    def counted(frame, purpose, written=passages.written):
        table = written(frame, purpose)
        rows.setdefault(purpose, table.count())
        return table

    monkeypatch.setattr(passages, "written", counted)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["start"], r["stop"], r["removed"], r["first_doc_id"]) for r in passages.repeated(df).collect())
    place = lambda k, a, b: (len(" ".join(texts[k][:a])) + (a > 0), len(" ".join(texts[k][:b])))
    expected = [(k, *place(k, 0, 270), k > 0, 0) for k in range(30)] + [(k, *place(k, 40, 190), True, 0) for k in (30, 31)]
    expected += [(32, *place(32, 40, 190), True, 0), (32, *place(32, 240, 390), True, 0)]
    assert found == expected
    # Windows of 34 places are repeated, but at most five kinds of place differ, and only near the ends of the passage.
    assert 0 < rows["seeds"] <= 5 * 34 // 2 < 34 * 6


def test_windows_with_few_variants_are_compared_in_one_task(spark, monkeypatch):
    import random

    random.seed(23)
    words = lambda n, tag: [f"{tag}{random.randrange(10**6)}" for _ in range(n)]
    passage = words(90, "p")
    # Each document has more of the passage than the one before, so each round finds another first one.
    texts = [[*words(40, "a"), *passage[30 - k:60 + k], *words(40, "b")] for k in range(30)] + [[*passage, *words(9, "c"), *passage]]
    texts += [t if k % 3 else [*t[:50], "other", *t[51:]] for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k if k % 7 else None, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rounds, found = {}, {}
    for most in (10**6, 20, 2):
        purposes = []

        def counted(frame, purpose, purposes=purposes, written=common.written):
            purposes.append(purpose)
            return written(frame, purpose)

        monkeypatch.setattr(passages, "written", counted)
        monkeypatch.setattr(passages, "CLASS_ROWS", most)
        found[most], rounds[most] = sorted(map(repr, passages.repeated(df).collect())), purposes.count("matches")
    assert found[10**6] == found[20] == found[2] and found[2]
    assert rounds[10**6] == 0 < rounds[20] < rounds[2], rounds


def test_words_and_windows_are_those_of_the_plain_way():
    import random
    import re

    import numpy as np
    import xxhash

    random.seed(24)
    texts = ["", "x" * 16, "x" * 17 + " " + "x" * 16, "\xc0B_9 \xaa\xb2\xb5 \xff \xe9", "\u0130stanbul \u017f\xdf", "ab" * 4 + " " + "ab" * 4 + "c"]
    texts += [" ".join(random.choice("ab\xe9\u0119") * random.randrange(1, 20) for _ in range(n)) for n in range(1, 300, 7)]
    for text in texts * 2:
        spans, hashes = passages._words(text, passages.Vocabulary())
        plain = list(re.finditer(r"\w+", text))
        assert [m.span() for m in plain] == list(map(tuple, spans.tolist()))
        assert [xxhash.xxh64_intdigest(m[0].lower().encode()) for m in plain] == hashes.tolist()
        order = passages.shingle_hashes(hashes, 3)[:max(0, len(hashes) - passages.WINDOW + 1)]
        runs = [range(k, min(k + passages.SPREAD, len(order))) for k in range(max(1, len(order) - passages.SPREAD + 1))] if len(order) else []
        assert sorted({min(run, key=lambda k: (order[k], k)) for run in runs}) == passages._places(hashes).tolist()
    rows = np.arange(2 * passages.BANDS * passages.ROWS, dtype=np.uint64).reshape(2, -1) * np.uint64(487)
    assert len(np.unique(passages._bands(rows))) == 2 * passages.BANDS


def test_bands_find_lines_at_the_threshold():
    assert 1 - (1 - passages.THRESHOLD ** passages.ROWS) ** passages.BANDS >= 0.99


def test_toxicity_on_held_out_labels(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    model = toxicity.train(documents, labels.where(~held))
    scored = toxicity.score(documents, model).join(labels.where(held), "doc_id").collect()
    assert sum(r["toxic"] == (r["toxic"] == 1) for r in scored) == len(scored)
    clean = [r for r in scored if not r["toxic"]]
    assert len(clean) > 50
    assert list(model.thresholds) == sorted(model.thresholds)


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [
        (1, "u1", "plain"), (2, "u2", inner), (3, "u3", "x" * 2000), (4, "u4", "x" * 2000), (5, None, None), (6, "u6", inner + "tail" + inner * 3),
        (7, "u7", "WARC/1.0\r\n"), (None, "u8", "é🙂" * 600), (9, "u9", "é🙂" * 600), (9, "u9", "é🙂" * 600), (10, "u10", "\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n" * 20),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write(df, str(tmp_path / "w"))
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["digest_matches"]) for r in warc.read(spark, str(tmp_path / "w")).collect())
    expected = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        refers = {3: 4, None: 9}.get(page_id)
        expected.append((page_id or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers, True))
    assert got == sorted(expected)


def test_warc_across_blocks(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = warc.read(spark, str(tmp_path / "w")).select("page_id", "payload_digest").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [(r["page_id"], hashlib.sha1((r["html"] or "").encode()).hexdigest()) for r in pages.collect()]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_pipeline_matches_plain_version(spark):
    got = sorted((r["doc_id"], r["text"], r["n_chars"], r["copies"]) for r in corpus_pipeline.run(spark, DATA).collect())
    docs = rows_of(spark, "doc_id, text, lang, source")
    kept = [(d[0], text, d[2], d[3]) for d, (keep, text) in zip(docs, brute.quality([(d[0], d[1], d[3]) for d in docs], quality.Limits())) if keep]
    classes = brute.near_classes([d[:2] for d in kept])
    kept = [d for d, c in zip(kept, classes) if d[0] == c]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [d for d, hit in zip(kept, brute.contaminated([d[1] for d in kept], items)) if not hit]
    found = brute.private([d[:2] for d in kept], private.Disclosure())
    kept = [(d[0], brute.sanitised(d[1], *f), d[2], d[3]) for d, f in zip(kept, found)]
    domains = lambda s: ["web", "forum", "books"][int(s[3:]) % 3]
    copies = brute.mixture(kept, mixture.Plan(), domains)
    assert got == sorted((d[0], d[1], len(d[1]), c) for d, c in zip(kept, copies) if c)


def test_decontamination_in_blocks(spark, monkeypatch):
    documents, benchmark = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contamination(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 700)
    assert sorted(map(tuple, decontaminate.contamination(documents, benchmark).collect())) == whole


def test_large_sides_are_shuffled(spark, monkeypatch):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    limits = quality.Limits(line_documents=1, line_percent=0.5)
    whole = sorted(map(tuple, quality.assess(documents, limits).collect()))
    monkeypatch.setattr(quality, "small_side", lambda frame: common.small_side(frame, 0))
    assert sorted(map(tuple, quality.assess(documents, limits).collect())) == whole
    assert any(r[-4] for r in whole)
