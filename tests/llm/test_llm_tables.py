"""Operators over whole tables: near-duplicates, benchmark passages, archives, and the pipeline."""

import base64
import gzip
import hashlib
import pickle
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LONG, ODD_TEXTS, empty, odd
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import decontaminate, order_minhash, quality_fm, secret_index, warc
from tideline.llm.common import staging_path
from tideline.llm.components import components
from tideline.llm.queries import op1_near_duplicates, op6_decontamination

SF = "/root/testdata/sf0.01"


class Sets(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def plain_classes(rows):
    """All pairs that share a shingle, compared one by one."""
    words = order_minhash.Words()
    sequences = {d: order_minhash.shingles(t or "", words) for d, t in rows}
    posts = defaultdict(list)
    for d, s in sequences.items():
        for h in s.tolist():
            posts[h].append(d)
    shared = Counter((a, b) for v in posts.values() for i, b in enumerate(v) for a in v[:i])
    sets = Sets()
    for (a, b), n in shared.items():
        if n >= 0.8 / 1.8 * (len(sequences[a]) + len(sequences[b])) - 1e-9 and order_minhash.similarity(sequences[a], sequences[b]):
            sets.join(a, b)
    texts = {}
    for d, t in rows:
        sets.join(d, texts.setdefault(t or "", d))
    return {d: sets.root(d) for d, _ in rows}


def test_near_duplicates_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in op1_near_duplicates(spark, SF).collect()}
    assert got == plain_classes(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(200)] = f"v{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    got = {r.doc_id: r.class_id for r in order_minhash.class_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_pairs_in_buckets_of_unlike_texts(spark):
    rnd = random.Random(5)

    def fresh(n):
        return [f"x{rnd.randint(0, 10**9)}" for _ in range(n)]

    shared, rows = fresh(344), []
    for i in range(100):
        own = fresh(16)
        for k in range(2):
            rows.append((2 * i + k, " ".join([*shared, *own, *fresh(40)])))
    got = {r.doc_id: r.class_id for r in order_minhash.class_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows) and len(set(got.values())) == 100


def test_short_texts_of_unequal_length(spark):
    rnd, rows = random.Random(9), []
    for i in range(1500):
        words = [f"x{rnd.randint(0, 10**9)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    got = {r.doc_id: r.class_id for r in order_minhash.class_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_similarity_is_of_order():
    words = order_minhash.Words()
    a = order_minhash.shingles(" ".join(map(str, range(100))), words)
    moved = order_minhash.shingles(" ".join(map(str, [*range(50, 100), *range(50)])), words)
    assert order_minhash.similarity(a, a) == 1.0 and order_minhash.similarity(a, moved) == 0.0
    assert order_minhash.chain(a, moved, 0.0) == 46
    again = order_minhash.shingles("a b c d e " * 6, words)
    assert len(np.unique(again)) == len(again) == 26
    assert len(order_minhash.shingles("", words)) == 0 and len(order_minhash.shingles("one two", words)) == 1


def test_near_duplicate_odd_rows(spark):
    rows = order_minhash.class_ids(odd(spark)).collect()
    assert len(rows) == len(ODD_TEXTS)
    got = Counter((r.doc_id, r.class_id) for r in rows)
    # empty and null texts say the same
    assert got == Counter([(1, 1), (1, 1), (2, 2), (3, 2), (None, None), (None, 2), (4, 4), (5, 5), (6, 6)])
    kept = order_minhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5, 6]
    assert order_minhash.class_ids(empty(spark)).collect() == [] and order_minhash.keep_one(empty(spark)).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(500, 200 + i) for i in range(50)]
    links = spark.createDataFrame(chain + star + [(900, 900), (1, 0)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert {got[i] for i in range(101)} == {got[0]} and {got[200 + i] for i in range(50)} == {got[500]} and got[0] != got[500]
    assert components(links.where("false")).collect() == []


# --- benchmark passages ----------------------------------------------------------------------------------------------


def plain_form(text):
    return " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def test_whole_items_are_found_and_spans_hold_them(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hits = op6_decontamination(spark, SF).collect()
    got = {(r.doc_id, r.item_id) for r in hits}
    expect = {(d, i) for d, t in docs.items() for i, b in items.items() if plain_form(b) in plain_form(t)}
    assert expect and expect <= got
    for r in hits:
        if (r.doc_id, r.item_id) in expect:
            assert r.edits == 0 and plain_form(docs[r.doc_id][r.start : r.end]) == plain_form(items[r.item_id])


def edits_within(window, text):
    """Fewest edits between the window and any part of the text, by the full table."""
    row = list(range(len(window) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, w in enumerate(window):
            new.append(min(row[i] + (w != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_filter_loses_no_window_within_its_budget():
    rnd = random.Random(6)
    window = "".join(rnd.choice("abcdefgh ") for _ in range(100)).strip().replace("  ", " x")
    windows = decontaminate.Windows.of([(7, window)])
    text = decontaminate.plain(window)[: decontaminate.WINDOW]
    for edits in range(16):
        for _ in range(6):
            x = list(text)
            for _ in range(edits):
                at = rnd.randrange(1, len(x) - 1)
                x[at : at + rnd.randint(0, 1)] = rnd.choice(["q", "", "z"])
            doc = decontaminate.plain("".join(rnd.choice("abcdefgh ") for _ in range(150)) + " " + "".join(x) + " " + "".join(rnd.choice("abcdefgh ") for _ in range(90)))
            expect = any(edits_within(bytes_of(t), doc) <= e for t, e in zip(windows.texts, windows.e))
            assert bool(windows.search([doc])[0]) == expect


def test_items_of_every_length_within_their_budget():
    """Also where 10-grams alone would filter nothing or too much: 25 to 29, 38 and 39 characters."""
    rnd, lost = random.Random(8), 0
    for n in range(decontaminate.LEAST, 64):
        item = "".join(rnd.choice("abcdefgh") for _ in range(n))
        windows = decontaminate.Windows.of([(7, item)])
        of = windows.small or windows
        assert (of.least > 0).all() and bool(windows.small) == (25 <= n <= 29 or n in (38, 39))
        for edits in range(int(decontaminate.EDITS * n) + 2):
            for even in (True, False):
                x = list(item)
                for i in range(edits):
                    at = (i + 1) * n // (edits + 1) if even else rnd.randrange(1, n - 1)
                    x[at : at + rnd.randint(0, 1)] = rnd.choice(["q", "", "z"])
                doc = "".join(rnd.choice("klmno ") for _ in range(80)) + " " + "".join(x) + " " + "".join(rnd.choice("klmno ") for _ in range(50))
                doc = decontaminate.plain(doc)
                expect = any(edits_within(bytes_of(t), doc) <= e for t, e in zip(of.texts, of.e))
                assert bool(windows.search([doc])[0]) == expect, (n, edits)
                lost += expect and edits > 1
    assert lost > 20


def test_short_items_as_whole_words():
    items = [(1, "Short item-here"), (2, "item"), (2, "item"), (3, "..."), (4, "here"), (5, "tem h"), (None, "x"), (6, "a test item of some twenty-eight")]
    windows = decontaminate.Windows.of(items)
    text = "A short, ITEM here; items!"
    assert sorted(windows.search([text])[0], key=str) == [(1, 2, 18, 0), (2, 9, 13, 0), (2, 9, 13, 0), (4, 14, 18, 0)]
    assert windows.search(["", None, "items heres", "this is a TEST item, of some twenty eight things"])[:3] == [[], [], []]
    assert {h[0] for h in windows.search(["this is a TEST item, of some twenty eight things"])[0]} == {2, 6}
    assert pickle.loads(pickle.dumps(windows)).search([text]) == windows.search([text])


def test_excerpts_at_every_offset():
    rnd = random.Random(7)
    item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(80))
    around = ["".join(rnd.choice("klmnopq ") for _ in range(200)) for _ in range(2)]
    windows = decontaminate.Windows.of([(7, item)])
    begins = [0, *(i + 1 for i, c in enumerate(item) if c == " ")]
    for size in (70, 90, 115):
        for at in begins:
            end = item.find(" ", at + size)
            if end >= 0:
                doc = f"{around[0]} {item[at:end]} {around[1]}"
                hits = windows.search([doc])[0]
                assert [h[0] for h in hits] == [7] and abs(hits[0][1] - 201) <= 12 and abs(hits[0][2] - 201 - (end - at)) <= 12
    # a place at the beginning of a text, wherever the text lies in its chunk
    for before in range(40):
        for lead in ("", "a ", "some words "):
            assert windows.search(["x" * before, lead + item[:64]])[1], (before, lead)


def test_texts_that_share_only_a_phrase_are_told_apart_at_once(monkeypatch):
    rnd = random.Random(9)
    words = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    item, aligned, plain_way = words("abcdefghij", 80), [], decontaminate.Windows.occurs
    windows = decontaminate.Windows.of([(7, item)])
    monkeypatch.setattr(decontaminate.Windows, "occurs", lambda *a: aligned.append(a) or plain_way(*a))
    begins = [i + 1 for i, c in enumerate(item[:-60]) if c == " "]
    assert windows.search([f"{words('klmnop', 20)} {item[at : at + 30]} {words('klmnop', 20)}" for at in begins]) == [[] for _ in begins]
    assert len(begins) > 60 and len(aligned) < 10


def test_characters_of_many_texts_are_those_of_each():
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    texts = ["", None, "\0", "a\0", "\0_a", " A--b ", "x" * 3, "...", "ΑΣ", *(every[i : i + 999] for i in range(0, len(every), 999)), "_z_"]
    codes, starts = decontaminate.plains(texts)
    assert [bytes_of(codes[a : b - 1]) for a, b in zip(starts, starts[1:])] == [decontaminate.plain(t or "") for t in texts]
    assert starts[-1] == len(codes) and not codes[starts[1:] - 1].any()


def test_parts_within_their_budget_by_the_full_table():
    rnd, some = random.Random(10), []
    for n in (1, 2, 40, 63, 64):
        for edits in range(10):
            part = [rnd.choice("abc") for _ in range(n)]
            x = list(part)
            for _ in range(edits):
                at = rnd.randrange(len(x) + 1)
                x[at : at + rnd.randint(0, 1)] = rnd.choice(["q", "", "z"])
            some.append(("".join(part), "".join(rnd.choices("abc", k=9) + x + rnd.choices("abc", k=rnd.randint(0, 9))), rnd.randint(0, 8)))
    padded = lambda texts, n, fill: np.array([[*map(ord, t), *[fill] * (n - len(t))] for t in texts], "u4")
    parts, regions = padded([s[0] for s in some], 64, 0), padded([s[1] for s in some], 99, 0xFFFFFFFF)
    got = decontaminate.within(parts, np.array([len(s[0]) for s in some]), np.array([s[2] for s in some]), regions).tolist()
    assert got == [edits_within(p, region) <= e for p, region, e in some] and len(set(got)) == 2


def bytes_of(codes):
    return "".join(map(chr, codes.tolist()))


def test_decontamination_odd_rows(spark):
    passage = "The quick brown fox jumps over the lazy dog while seven wizards boxed quietly under the old stone bridge near a river."
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (None, passage.upper()), (3, "short"), (4, "")], "item_id long, text string")
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame([(8, LONG + passage.upper().replace(",", " - ") + LONG), (9, "fox")], "doc_id long, text string"))
    rows = docs.select("doc_id", F.size(decontaminate.hits(F.col("text"), items)).alias("n")).collect()
    assert {r.doc_id for r in rows if r.n} == {8} and len(rows) == len(ODD_TEXTS) + 2
    assert decontaminate.keep_clean(odd(spark), items).count() == len(ODD_TEXTS)
    assert decontaminate.keep_clean(odd(spark), items.where("false")).count() == len(ODD_TEXTS)
    assert decontaminate.keep_clean(empty(spark), items).collect() == []
    many = decontaminate.hits(F.col("text"), items)
    old, decontaminate.PART_CHARS = decontaminate.PART_CHARS, 130
    try:
        parts = docs.where("doc_id = 8").select(decontaminate.hits(F.col("text"), items).alias("a"), many.alias("b")).first()
        assert {h.item_id for h in parts.a} == {h.item_id for h in parts.b}
    finally:
        decontaminate.PART_CHARS = old


# --- archives --------------------------------------------------------------------------------------------------------


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (None, "http://c/", "same"), (1, "http://d/\r\nX: y", "é" * 100_000),
    (2, "http://e/", None), (4, "http://f/", ""), (6, "http://g/", "\r\n\r\nWARC/1.1\r\n"), (6, "http://g/", "\r\n\r\nWARC/1.1\r\n"), (None, None, "alone"),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = staging_path(spark, "warc")
    warc.write(warc.page_records(pages), path, max_file_bytes=500)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES)
    by_id = {warc_id: r for r in rows for warc_id in [r.record_id]}
    assert by_id["urn:page:3"].record_type == "response" and bytes(by_id["urn:page:3"].payload) == b"same"
    for i in (5, 9):
        r = by_id[f"urn:page:{i}"]
        assert (r.record_type, r.refers_to, r.payload_length, r.payload_digest, bytes(r.payload)) == ("revisit", "urn:page:3", 4, digest(b"same"), b"")
    assert bytes(by_id["urn:page:1"].payload).decode() == "é" * 100_000 and by_id["urn:page:1"].target_uri == "http://d/%0D%0AX: y"
    assert by_id["urn:page:2"].record_type == "response" and by_id["urn:page:4"].refers_to == "urn:page:2"
    assert [bytes(r.payload) for r in rows if r.record_id == "urn:page:6"] == [b"\r\n\r\nWARC/1.1\r\n"] * 2
    assert sorted(r.record_type for r in rows if r.record_id.startswith("urn:uuid:")) == ["response", "revisit"]
    small = warc.page_records(pages, min_bytes=5)
    assert {r.record_type for r in small.collect() if r.payload_length < 5} == {"response"}


def test_archive_push_down(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = staging_path(spark, "warc")
    warc.write(warc.page_records(pages), path)
    heads = warc.read(spark, path, payload=False)
    assert "payload" not in heads.columns and heads.count() == len(PAGES)
    revisits = heads.where("record_type = 'revisit'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan
    assert revisits.count() == 4 and heads.where("record_id in ('urn:page:1', 'urn:page:5')").count() == 2
    assert heads.where("payload_length > 1000").count() == 1
    reader = warc.Reader(path, False)
    reader.allowed = [("record_type", frozenset({"revisit"}))]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_foreign_archives_and_lost_files(spark, tmp_path):
    head, http = warc.record_head("response", "urn:page:1", "http://x/", None, hashlib.sha1(b"abc").hexdigest(), 3, "2020-01-01T00:00:00Z")
    one = head + http + b"abc\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one * 2)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(one) * 3)
    (tmp_path / "ours.warc.gz").write_bytes(warc.member(one, 6) * 4)
    for payload in (True, False):
        rows = warc.read(spark, str(tmp_path), payload).collect()
        assert len(rows) == 9 and {(r.payload_length, r.payload_digest) for r in rows} == {(3, digest(b"abc"))}
    assert {bytes(r.payload) for r in warc.read(spark, str(tmp_path)).collect()} == {b"abc"}
    # a file that no commit lists is not read
    (tmp_path / "_manifest").write_text('["plain.warc"]')
    assert warc.read(spark, str(tmp_path)).count() == 2


def test_measures_are_of_the_bytes(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = staging_path(spark, "warc")
    warc.write(warc.page_records(pages), path)
    found = {r.record_id: (r.record_type, r.payload_length, r.payload_digest) for r in warc.measured(spark, path).collect()}
    assert found["urn:page:3"] == ("response", 4, digest(b"same")) and found["urn:page:9"] == ("revisit", 4, digest(b"same"))
    assert found["urn:page:1"] == ("response", 200_000, digest("é".encode() * 100_000)) and len(found) == len(PAGES) - 1

    def record(kind, n, body, sha1, refers=None):
        head, http = warc.record_head(kind, f"urn:page:{n}", "http://x/", refers, sha1, len(body), "2020-01-01T00:00:00Z")
        return warc.member(head + http + (body if kind == "response" else b"") + b"\r\n\r\n", 6)

    told = hashlib.sha1(b"abc").hexdigest()
    other = record("response", 1, b"abX", told) + record("revisit", 2, b"abc", told, "urn:page:1")
    (tmp_path / "other.warc.gz").write_bytes(other)
    assert {r.record_id: (r.payload_length, r.payload_digest) for r in warc.measured(spark, str(tmp_path)).collect()} == {"urn:page:1": (3, digest(b"abX")), "urn:page:2": (None, None)}
    damaged = bytearray(record("response", 1, bytes(range(256)) * 40, told))
    damaged[len(damaged) // 2] ^= 255
    (tmp_path / "other.warc.gz").write_bytes(bytes(damaged))
    with pytest.raises(Exception):
        warc.measured(spark, str(tmp_path)).collect()


def test_long_http_headers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"y" * 1000) for i in range(150)) + b"\r\n"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u:1>\r\nContent-Length: %d\r\n\r\n" % (len(http) + 3)
    one = head + http + b"abc\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(one))
    (tmp_path / "ours.warc.gz").write_bytes(warc.member(one, 6))
    for payload in (True, False):
        assert [r.payload_length for r in warc.read(spark, str(tmp_path), payload).collect()] == [3, 3, 3]


def test_empty_archive(spark):
    path = staging_path(spark, "warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.page_records(pages), path)
    assert warc.read(spark, path).count() == 0 and warc.measured(spark, path).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality_fm.fit(docs, labels)
    featurize = quality_fm.Featurizer()
    rows = {d: t for d, t in rows.items() if model.score(*model.row(*featurize(t))) >= 0.5}
    roots = plain_classes(list(rows.items()))
    rows = {d: t for d, t in rows.items() if roots[d] == d}
    windows = decontaminate.Windows.of([(r.item_id, r.text) for r in benchmark.collect()])
    rows = {d: t for d, t in rows.items() if not windows.search([t])[0]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows) and all(r.decodes for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    docs = odd(spark).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is in any text of these rows")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            out = stage(spark, given, str(tmp_path))
            assert name == "tokens" or out.columns == docs.columns
            out.collect()
    texts = spark.createDataFrame([(1, "token = abcdefgh", 16)], "doc_id long, text string, n_chars int")
    clean = corpus_pipeline.secrets(spark, texts, str(tmp_path)).first()
    assert clean.text == "<removed>" and clean.n_chars == 9
    assert secret_index.RULES
