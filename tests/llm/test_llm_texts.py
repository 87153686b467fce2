"""Operators on single texts: against plain versions and over odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from helpers import LONG, ODD_TEXTS, empty, odd
from pyspark.sql import functions as F

from tideline.llm import bpe, decision_list, langid, pii, quality_fm, secret_index
from tideline.llm.queries import URL_RULES, op2_pii, op8_quality_rules, op9_bpe, op10_quality
from tideline.llm.queries import op4_language
from tideline.llm.url_trie import Trie, judge, split_url

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


# --- personal data ---------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_pii_plain_spans_of_random_texts():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice("0123456789....@@++-- ()ab_%é1214") for _ in range(rnd.randint(0, 50)))
        assert [s[:3] for s in pii.find(text) if s[3]] == plain_spans(text), text


def test_pii_disguises_map_back_to_the_source():
    cases = {
        "write to john (at) example (dot) com now": ("email", "john (at) example (dot) com"),
        "john at example dot com": ("email", "john at example dot com"),
        "mail jоhn@exаmple.com x": ("email", "jоhn@exаmple.com"),
        "plus four nine one five five one two three four five six": ("phone", "plus four nine one five five one two three four five six"),
        "see １２７.0.0.1 there": ("ip", "１２７.0.0.1"),
        "one nine two dot one six eight dot one dot one two three": ("ip", "one nine two dot one six eight dot one dot one two three"),
        "4111 1111 1111 111１": ("card", "4111 1111 1111 111１"),
    }
    for text, (kind, span) in cases.items():
        assert (kind, span) in [(k, text[a:b]) for k, a, b, plain in pii.find(text) if not plain], text
    for text in ("look at example.com for it", "the one dot", "one two three", "meet me at noon dot"):
        assert pii.find(text) == []


def test_pii_no_rule_applies_without_a_hint():
    text = "call plus 49 151 23456789 now"
    assert [(kind, text[a:b]) for kind, a, b, _ in pii.find(text)] == [("phone", "plus 49 151 23456789")]
    rnd = random.Random(8)
    pieces = ["plus", "Plus", "one", "zwei", "sept", "oh", "4", "49", "at", "@", "dot", "punkt", ".", "[", "]", "(", ")", " ", " ", " ", " ", "  ", "-", "x", "a.b"]
    for _ in range(40_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        assert pii._HINT.search(text) or not pii._RULES.search(text), text


def test_pii_every_letter_that_matches_without_case():
    letters = set("".join(pii._SPELLED) + "arrobapunktpointpuntoplus")
    one = re.compile(f"[{''.join(letters)}]", re.IGNORECASE)
    for c in map(chr, range(0x110000)):
        if one.match(c):
            assert c in pii._LOOKALIKES or c.lower() in letters
    for text in ("call ſix ſeven ſix now", "call sıx seven sıx now", "one two ſix dot one dot two", "PLUS FİVE ſix seven eight nine ten"):
        pii.find(text)
    assert [s[0] for s in pii.find("plus ſıx one two three four five ſeven eıght nıne now")] == ["phone"]
    assert pii.find("one two ſix dot one dot two dot ſıx") == [("ip", 0, 35, False)]
    assert pii.find("x ſue@mail.org") == [("email", 2, 14, False), ("email", 3, 14, True)]


def test_pii_every_character_that_is_rewritten():
    found = [c for c in map(chr, range(0x110000)) if pii._OTHER.match(c)]
    assert set("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉") <= set(found) and all(len(pii._plain_char(c)) <= 1 for c in found)
    assert pii.find("5 m s\u207b\u00b9, 2\u207f, \u207a\u207d\u2071\u2071\u207e, \u2072") == []


def test_pii_query(spark):
    texts = dict(documents(spark))
    for r in op2_pii(spark, SF).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in PLAIN]


def test_pii_odd_rows(spark):
    rows = odd(spark).select("doc_id", pii.spans(F.col("text")).alias("s")).collect()
    assert len(rows) == len(ODD_TEXTS) and all(r.s == [] for r in rows)
    assert empty(spark).select(pii.spans(F.col("text"))).collect() == []


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_secret_queries_are_necessary():
    """A text that a rule matches has the trigrams that the rule asks for."""

    def met(query, found):
        if query is True or isinstance(query, str):
            return query is True or query in found
        return (all if query[0] == "and" else any)(met(q, found) for q in query[1])

    samples = ['Password = "abc123"', "api_key:xyz123", "APIKEY=aaaaaa", "token='qwerty", "AKIA" + "A1" * 10, "ghp_" + "Z" * 40, "xoxb-" + "1" * 12, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + ".".join(["abcdefghij"] * 3)]
    hit = set()
    for rule in secret_index.RULES:
        for text in samples:
            if re.search(rule.pattern, text):
                hit.add(rule.kind)
                low = text.lower()
                assert met(secret_index.trigram_query(rule.pattern), {low[i : i + 3] for i in range(len(low))})
    assert hit == {r.kind for r in secret_index.RULES} - {"hex"}
    assert secret_index.trigram_query("[0-9a-f]{24,}") is True
    assert secret_index.trigram_query("a.c") is True
    assert secret_index.trigram_query("abc+d?") == "abc"
    assert secret_index.trigram_query("(foo|bars)x") == ("or", (("and", ("ars", "bar", "rsx")), ("and", ("foo", "oox"))))


def test_secret_spans_and_redaction(spark):
    many = " ".join(f"é😀 token={'ab' * 4}{i}" for i in range(300))
    texts = [(1, many), (2, "token=token: abcdefgh"), (3, "x password : 'hunter22' AKIA" + "Z" * 16 + " " + "0f" * 12), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_index.scan(docs).collect()}
    expect = [("assign", m.start(), m.end()) for m in re.finditer(r"token=\w+", many)]
    assert found[1] == expect and len(expect) == 300
    assert found[2] == [] and found[4] == [] and found[5] == []
    assert [k for k, _, _ in found[3]] == ["assign", "access", "hex"]
    clean = {r.doc_id: r.text for r in secret_index.redact(docs).collect()}
    assert "token=" not in clean[1] and clean[1].count("<removed>") == 300 and clean[1].startswith("é😀 <removed> é😀")
    assert clean[2] == texts[1][1] and clean[3] == "x <removed>' <removed> <removed>" and clean[4] is None


def test_secret_odd_rows(spark):
    rows = secret_index.scan(odd(spark), "found")
    assert rows.columns == [*odd(spark).columns, "found"]
    assert sorted((r.doc_id or 0, len(r.found)) for r in rows.collect()) == sorted((d or 0, 0) for d, _ in ODD_TEXTS)
    again = secret_index.redact(odd(spark))
    assert sorted(map(str, again.collect())) == sorted(map(str, odd(spark).collect()))
    assert secret_index.scan(empty(spark), "found").collect() == []


# --- language --------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    langs = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect())
    rows = op4_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_language_odd_rows(spark):
    learnt = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("123", "xx"), ("words", None)], "text string, lang string")
    samples = langid.fit(learnt)
    assert sorted(samples) == ["de", "en"]
    rows = odd(spark).select("text", langid.predict(spark, F.col("text"), samples).alias("p")).collect()
    assert all((r.p.lang == "und") == (not r.text) for r in rows)
    model = langid.Classifier(samples)
    assert model.predict("die Katze und der Hund")[0] == "de" and model.predict("!!! 12")[:2] == ("und", 0.0)
    assert langid.Classifier({}).predict("text") == ("und", 0.0, False)
    assert langid.fit(learnt.where("false")) == {}


# --- urls ------------------------------------------------------------------------------------------------------------


def test_url_trie_against_a_scan_of_all_rules():
    rnd = random.Random(1)
    rules = [(rnd.choice(("allow", "block")), ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))), rnd.choice(("/", "/x/", "/x/y", "/xy", "/x/y/z/", ""))) for _ in range(60)]
    trie = Trie(rules)
    for _ in range(3000):
        host = ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
        path = rnd.choice(("", "/", "/x", "/x/", "/x/y", "/x/yy/z", "/xyz", "/x/y/z/w"))
        fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        expect = max(fits)[3:] if fits else None
        assert trie.longest(host, path) == expect, (host, path)


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.NET", "http://a.Example.net/en/x?y#z", "x://b.example.com/de/", "http://ÄB.org/fr/", "://", "http://net/", "http://c.net?q=/"]
    df = spark.createDataFrame([(u, 1) for u in urls] * 2, "url string, verdict int")
    rows = df.select("url", judge(spark, F.col("url"), URL_RULES).alias("v")).collect()
    assert len(rows) == 20
    got = {r.url: tuple(r.v) for r in rows}
    assert got[None] == got[""] == got["no scheme"] == got["://"] == ("", "", None, "allow")
    assert got["HTTP://EXAMPLE.NET"] == ("example.net", "", None, "allow")
    assert got["http://a.Example.net/en/x?y#z"] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got["x://b.example.com/de/"][2:] == ("example.com/de/", "block")
    assert got["http://ÄB.org/fr/"] == ("Äb.org", "/fr/", "org/fr/", "allow") or got["http://ÄB.org/fr/"][0] == "Äb.org"
    assert got["http://net/"][2:] == ("net/", "block") and got["http://c.net?q=/"][2:] == (None, "allow")
    assert split_url("a://b://c") == ("b:", "//c")


# --- quality rules ---------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    texts = dict(documents(spark))
    for r in op8_quality_rules(spark, SF).collect():
        n = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    rows = decision_list.statistics(odd(spark)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, rows)) == sorted(plain_counts(t) for _, t in ODD_TEXTS)
    edge = spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in enumerate([range(7), range(8), [1] * 8, [1] * 9, [*range(8), *range(8)], [*range(9), 5, *range(1, 9)]])], "doc_id long, text string")
    assert [tuple(r)[1:] for r in decision_list.statistics(edge).orderBy("doc_id").select("doc_id", "n_repeat_words").collect()] == [(plain_counts(t)[4],) for _, t in edge.orderBy("doc_id").collect()]


def test_decision_list_learns_and_stands_odd_labels(spark):
    rows = [(i, "spam $$$ ### " * 10 if i % 2 else f"good words number {i} " + "and so on it goes " * 5) for i in range(400)]
    stats = decision_list.statistics(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)] + [(1, None), (None, 0)], "doc_id long, quality int")
    rules = decision_list.fit(stats, labels)
    assert rules and all(1 <= len(r) <= 3 for r in rules)
    got = {r.doc_id: r.x for r in stats.select("doc_id", decision_list.rejects(rules).alias("x")).collect()}
    assert all(got[i] == bool(i % 2) for i in range(400))
    assert decision_list.fit(stats, labels.where("quality = 1")) == []
    assert decision_list.fit(stats, labels.where("false")) == []
    assert decision_list.fit(stats.where("false"), labels) == []
    assert stats.where(decision_list.rejects([])).isEmpty()


# --- tokens ----------------------------------------------------------------------------------------------------------


def encoding(b):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark):
    b = bpe.loaded(PATH, public_tokenizers.PATTERN)
    enc = encoding(b)
    texts = dict(documents(spark))
    for r in op9_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    rnd = random.Random(1)
    for _ in range(3000):
        x = "".join(rnd.choice(["a", "e", "th", "ing", " ", "\n", "é", "漢", "1", "😀", "!", "the", "'s", "aaa", "----"]) for _ in range(rnd.randint(0, 60)))
        assert np.frombuffer(b.encode([x])[0], "<u4").tolist() == enc.encode_ordinary(x), x


def test_bpe_neighbours_by_definition():
    b, rnd = bpe.loaded(PATH, public_tokenizers.PATTERN), random.Random(2)
    ids = list(b.ranks.values())
    for _ in range(3000):
        x, y = rnd.choice(ids), rnd.choice(ids)
        assert b.valid(x, y) == (b.merged(b.tokens[x] + b.tokens[y]) == [x, y])


def test_bpe_appends_and_edits():
    b, rnd = bpe.loaded(PATH, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(200):
        x = bytes(rnd.choice(b"abcdetonishr") for _ in range(rnd.randint(1, 600)))
        p = bpe.Prefixes(b, x[: len(x) // 2])
        p.append(x[len(x) // 2 :])
        assert p.ids() == bpe.Prefixes(b, x).ids() == b.merged(x)
        i = rnd.randint(0, len(x))
        j, new = rnd.randint(i, min(len(x), i + 10)), bytes(rnd.choice(b"abceinst") for _ in range(rnd.randint(0, 8)))
        done = p.replace(i, j, new)
        assert p.ids() == bpe.Prefixes(b, x[:i] + new + x[j:]).ids() and done <= len(x) + 8
    p = bpe.Prefixes(b, b"the quick brown fox " * 500)
    assert p.replace(100, 101, b"z") < 500


def test_bpe_odd_rows(spark):
    ids = odd(spark).select("text", bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN).alias("ids"))
    rows = ids.select("text", "ids", bpe.decode(F.col("ids"), PATH, public_tokenizers.PATTERN).alias("b"), bpe.id_list(F.col("ids")).alias("list")).collect()
    assert all(bytes(r.b) == (r.text or "").encode() and len(r.list) * 4 == len(r.ids) for r in rows) and len(rows) == len(ODD_TEXTS)


# --- quality classifier ----------------------------------------------------------------------------------------------


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    size = 40 + quality_fm.BINS * len(quality_fm.STATISTICS)
    model = quality_fm.Model(np.sort(rng.normal(size=(len(quality_fm.STATISTICS), quality_fm.BINS - 1))), 0.3, rng.normal(size=size), rng.normal(size=(size, 4)), 40)
    index, value = model.row(*quality_fm.Featurizer(40)("some words and some more words"))
    pairs = sum(model.factors[i] @ model.factors[j] * x * y for a, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[:a])
    z = 0.3 + value @ model.linear[index] + pairs
    assert abs(model.score(index, value) - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    rows = op10_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (None, 0), (6, None), (7, 1)], "doc_id long, quality int")
    docs = odd(spark)
    model = quality_fm.fit(docs, labels)
    rows = docs.select("text", quality_fm.score(spark, F.col("text"), model).alias("s")).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.s <= 1 for r in rows)
    assert quality_fm.keep_good(docs, model).columns == docs.columns
    none = quality_fm.fit(docs, labels.where("false"))
    assert {r.s for r in docs.select(quality_fm.score(spark, F.col("text"), none).alias("s")).collect()} == {0.5}
    assert quality_fm.fit(empty(spark), labels).bias == 0.0
    assert len(LONG) > 500_000


def test_checked_encoding_equals_encoding_then_decoding(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = odd(spark).select(bpe.encode(F.col("text"), path, pattern).alias("ids"), bpe.encode_checked(F.col("text"), path, pattern).alias("c"))
    rows = both.collect()
    assert rows and all(r.c.ids == r.ids and r.c.decodes for r in rows)
    assert empty(spark).select(bpe.encode_checked(F.col("text"), path, pattern)).collect() == []
