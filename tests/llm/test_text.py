"""Decontamination, license scan, URL filter and language ID."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from coursebeacon.llm import decontamination, language_id, license_scan, queries, url_reputation
from coursebeacon.llm.license_rules import rules
from tests.llm import helpers


def hits(text, items, window):
    words = helpers.plain_words(text)
    hit, names = set(), set()
    for item, own in items:
        own = helpers.plain_words(own)
        size = min(window, len(own))
        runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if own else ():
            if tuple(words[i : i + size]) in runs:
                hit.update(range(i, i + size))
                names.add(item)
    return hit, sorted(names)


@pytest.mark.parametrize("limit", [50_000, 12])
def test_decontamination(spark, limit):
    items = [
        (1, "Passage0 passage1, PASSAGE2 passage3 passage4 passage5 passage6 passage7 passage8 passage9 passage10 and more"),
        (2, "lazy DOG"), (3, None), (4, "!!"), (5, "über öl"), (5, "brown"), (6, "long long long long long long long long long long"),
        (7, " ".join(f"passage{i}" for i in range(30))), (None, "missing"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = helpers.awkward(spark)
    found = decontamination.decontaminate(docs, benchmark, words_per_automaton=limit)
    named = [("" if i is None else str(i), t) for i, t in items]
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if len(r.text or "") > 50000:
            continue
        hit, names = hits(r.text, named, 10)
        assert r.n_words == len(helpers.plain_words(r.text))
        assert r["items"] == names
        assert {w for s in r.word_spans for w in range(s.first, s.last + 1)} == hit
        for s, c in zip(r.word_spans, r.char_spans):
            cut = r.text[c.start : c.end]
            assert helpers.plain_words(cut) == helpers.plain_words(r.text)[s.first : s.last + 1]
            assert helpers.plain_words(cut[:1]) and helpers.plain_words(cut[-1:])
    assert next(r for r in rows if r.doc_id == 13)["items"] == ["1", "6", "7"]


def test_decontamination_questions_and_answers_and_empty(spark):
    docs = spark.createDataFrame([(1, "the answer is blue"), (2, "who asked that")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, "who asked that", "is blue")], "item_id long, q string, a string")
    found = decontamination.decontaminate(docs, benchmark, item_text_cols=("q", "a")).collect()
    assert [r["items"] for r in found] == [["9"], ["9"]]
    assert decontamination.decontaminate(docs, benchmark.limit(0), item_text_cols=("q",)).filter("size(items) > 0").count() == 0
    assert decontamination.decontaminate(docs.limit(0), benchmark, item_text_cols=("q",)).count() == 0


LICENSED = [
    (100, "Released under the MIT License.", "en"),
    (101, "Under the MIT license; under  the MIT-license UNDER THE MIT LICENSE", "en"),
    (102, "Licensed under the Apache License, Version 2.0 (the License)", "en"),
    (103, "CC BY-NC 4.0 and cc-by-nc-sa, also CC BY SA 4.0", "en"),
    (104, "This work is licensed under the GNU General Public License, version 3. GPLv3!", "en"),
    (105, "SPDX-License-Identifier: MIT", "en"),
    (106, "Redistribution and use in source and binary forms, with or without modification", "en"),
    (107, "komm mit mir, under the mit licenses", "de"),
    (108, ("under the mit license " * 400).strip(), "en"),
]


def brute_force(text, phrases, table):
    words = helpers.plain_words(text)
    norm = " " + " ".join(words) + " "
    base = []
    for phrase, label in phrases.items():
        own = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    found = []
    for i, (label, _, _, priority, confidence, pattern) in enumerate(table):
        for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" "), priority, i, label, confidence))
    kept = [
        d for d in found
        if not any(
            e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
            and (e[:2] != d[:2] or e[2] > d[2] or e[3] < d[3])
            for e in found
        )
    ]
    return len(words), sorted(base), sorted((a, b, label) for a, b, _, _, label, _ in kept)


def test_license_scan(spark):
    docs = helpers.awkward(spark, LICENSED)
    table = rules()
    assert len(table) > 300 and len({r[0] for r in table}) > 60
    found = license_scan.license_scan(docs, phrases=queries.LICENSE_PHRASES)
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if len(r.text or "") > 50000 or r.doc_id == 108:
            continue
        n, base, kept = brute_force(r.text, queries.LICENSE_PHRASES, table)
        assert r.n_words == n
        assert sorted((b.start, b.label) for b in r.base) == base
        assert sorted((d.first_word, d.last_word, d.label) for d in r.detections) == kept, r.text
    by = {r.doc_id: r for r in rows}
    assert len(by[108].base) == 400 and {d.label for d in by[108].detections} == {"mit"}
    assert {d.label for d in by[104].detections} == {"gpl-3"}
    assert {d.label for d in by[103].detections} == {"cc-by-nc", "cc-by-nc-sa", "cc-by-sa"}
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_license_keywords_are_needed():
    for label, keyword, also, _, _, pattern in rules():
        literal = re.sub(r"\(\?:[^()]*\)\??", " ", pattern)
        assert also == "" or "licen" in pattern, label
        assert keyword.split()[0][:3] in pattern or literal, label


def spelled(pattern):
    """Every text of a pattern, with one word for a gap."""
    parser = re._parser

    def texts(part):
        out = [""]
        for op, value in part:
            name = str(op)
            if name == "LITERAL":
                options = [chr(value)]
            elif name == "IN":
                options = [chr(v) for o, v in value if str(o) == "LITERAL"] if all(str(o) == "LITERAL" for o, _ in value) else ["x"]
            elif name == "NOT_LITERAL":
                options = ["x"]
            elif name == "SUBPATTERN":
                options = texts(value[3])
            elif name == "BRANCH":
                options = [t for b in value[1] for t in texts(b)]
            else:
                low, high, inner = value
                assert name in ("MAX_REPEAT", "MIN_REPEAT")
                options = [*([""] if low == 0 else []), *(texts(inner) if high else [])]
            out = [a + b for a in out for b in options]
        return out

    return texts(parser.parse(pattern))


def test_license_keywords_stand_in_every_alternative():
    for label, keyword, also, _, _, pattern in rules():
        for text in spelled(pattern):
            assert f" {keyword}" in f" {text}" and (not also or f" {also}" in f" {text}"), (label, keyword, text)


LBNL = "the University of California, Lawrence Berkeley National Laboratory, U.S. Dept. of Energy"


def test_license_wordings(spark):
    texts = [
        ("released under the FreeBSD license", "bsd-2-clause"),
        (f"Neither the name of {LBNL}, nor the names of its contributors may be used", "bsd-3-clause"),
        ("SPDX-License-Identifier: BSL-1.0", "boost-1"), ("SPDX-License-Identifier: OFL-1.1", "sil-ofl"),
        ("SPDX-License-Identifier: PSF-2.0", "python-2"), ("SPDX-License-Identifier: 0BSD", "0bsd"),
        ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("distributed under the CreativeML OpenRAIL-M license", "bigscience-rail"), ("the Q Public License", "qpl"),
        ("The Software shall be used for Good, not Evil.", "json"),
        ("The origin of this software must not be misrepresented;", "zlib"),
        ("Neither the name of this house was known.", None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in license_scan.license_scan(docs).collect():
        assert {d.label for d in r.detections} == {texts[r.doc_id][1]} - {None}, r.text
    table = rules()
    for r in license_scan.license_scan(docs).collect():
        found = sorted((d.first_word, d.last_word, d.label) for d in r.detections)
        assert found == brute_force(r.text, {}, table)[2]


def test_license_scan_on_tables(spark, small):
    """Every document of the smallest table against brute force."""
    table = rules()
    found = license_scan.license_scan(spark.read.parquet(f"{small}/documents.parquet"), phrases=queries.LICENSE_PHRASES)
    for r in found.collect():
        n, base, kept = brute_force(r.text, queries.LICENSE_PHRASES, table)
        assert r.n_words == n and sorted((b.start, b.label) for b in r.base) == base
        assert sorted((d.first_word, d.last_word, d.label) for d in r.detections) == kept


def test_url_parts_and_rules(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?y#z"), (2, "https://user@h.co.uk:80?q"), (3, None), (4, "no scheme"),
        (5, "x://www.example.com/de/"), (6, "ftp://org/fr/a"), (7, "http://notexample.net"), (8, "http://b.net/"),
        (8, "http://b.net/"), (9, "http://a.net/x://b/c"), (None, "http://ex.org#f/g"), (10, "http://x.org/fr"),
    ]
    pages = spark.createDataFrame([(i, u, "own") for i, u in urls], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(1, 0), (10, None), (None, 1)], "page_id long, bad int")
    rows = url_reputation.url_filter(pages, outcomes, queries.URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][:3] == ("user@h.co.uk:80", "", None)
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("www.example.com", "/de/", "example.com/de/", "block")
    assert got[6][2:] == ("org/fr/", "allow")
    assert got[7][:3] == ("notexample.net", "", None)
    assert got[8] == ("b.net", "/", "net/", "block")
    assert got[9] == ("a.net", "/x://b/c", "net/", "block")
    assert got[None] == ("ex.org", "", None, "allow") and got[10][2] is None
    assert url_reputation.url_filter(pages.limit(0), outcomes, queries.URL_RULES).count() == 0
    assert url_reputation.url_filter(pages, outcomes.limit(0), queries.URL_RULES).filter("verdict = 'block'").count() == 4


def test_bad_hosts_are_blocked_and_shrunk(spark):
    rows = [("bad.spam.com", 1)] * 40 + [("new.spam.com", None)] + [("one.good.org", 1)]
    rows += [(f"h{i}.good.org", 0) for i in range(30) for _ in range(5)] + [("mixed.com", i % 5 == 0) for i in range(50)]
    outcomes = spark.createDataFrame([(h, None if b is None else int(b)) for h, b in rows], "host string, bad int")
    got = {r.host: r for r in url_reputation.host_reputation(outcomes).collect()}
    assert got["bad.spam.com"].blocked and got["new.spam.com"].mean > 0.5
    assert not got["one.good.org"].blocked and got["one.good.org"].mean < 0.9
    assert not got["mixed.com"].blocked and not got["h1.good.org"].blocked
    assert all(0 < r.mean < 1 and r.lower <= r.mean <= r.upper for r in got.values())


def test_registered_domain(spark):
    hosts = ["a.b.example.com", "x.co.uk", "b.x.co.uk", "co.uk", "com", "", "u@a.example.org:8080"]
    domain, suffix = url_reputation.registered_domain(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain.alias("d"), suffix.alias("s")).collect()
    assert [tuple(r) for r in got] == [
        ("example.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("co.uk", "co.uk"), ("com", "com"), ("", ""),
        ("example.org", "org"),
    ]


def test_language_id_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.QUERIES["op6_language_id"](spark, small).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.95 * len(tested) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_awkward_rows(spark):
    docs = helpers.awkward(spark)
    model = language_id.train(docs)
    assert set(model.families) == {"germanic", "romance"} and ("de", "en") in model.pair
    found = language_id.predict(docs, model)
    assert set(found.columns) == {*docs.columns, "lang_pred"}
    for r in found.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    one = language_id.train(docs.filter("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"und", "fr"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_sample_counts_distinct_texts(spark, monkeypatch):
    """Thousands of copies of one text do not crowd out the others of the language."""
    rows = [("en", f"english words {'ab' * (i % 7)} {chr(97 + i % 26) * 3} number{i}") for i in range(400)]
    rows += [("de", f"deutsche Worte {'uv' * (i % 7)} {chr(97 + i % 26) * 3} Zahl{i}") for i in range(400)]
    docs = spark.createDataFrame(rows + [("en", "one copy of many")] * 20_000, "lang string, text string")
    write, sampled = language_id.staged, {}

    def spy(df, purpose):
        out = write(df, purpose)
        sampled.update({r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()})
        return out

    monkeypatch.setattr(language_id, "staged", spy)
    language_id.train(docs, sample=50)
    assert sampled == {"en": 50, "de": 50}


def test_numerals_are_no_letters(spark):
    model = language_id.Model(families={"only xx": ["xx"]})
    texts = [(1, "\u00bd \u2460 12"), (2, "\u2167"), (3, "\u00b2"), (4, "\u00bda")]
    found = language_id.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in found} == {1: True, 2: True, 3: True, 4: False}
    assert all(bool(language_id.letters(c)) == c.isalpha() for c in map(chr, range(0x30000)))
    assert language_id.letters("½Ⅷ Ab1c, 一é_²") == "ab c 一é"


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = "Fünf größere Wörter, and more " * 40
    whole = language_id.features(text)
    for chunk in (1, 7, 64):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert abs(language_id.features(text) - whole).max() < 1e-12


def test_license_scan_of_dense_texts_is_linear(spark):
    """30,000 detections in one text: many blocks, equal to what the pieces give on their own."""
    line = "SPDX-License-Identifier: MIT. Under the Apache License, Version 2.0; licensed under the EUPL. "
    short = license_scan.license_scan(spark.createDataFrame([(0, line * 3)], "doc_id long, text string")).first()
    size = short.n_words // 3
    of_line = [(d.first_word, d.last_word, d.label) for d in short.detections if d.last_word < size]
    n = 10_000
    docs = spark.createDataFrame([(0, line * n), (1, None), (2, "")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in license_scan.license_scan(docs, phrases=queries.LICENSE_PHRASES).collect()}
    found = [(d.first_word, d.last_word, d.label) for d in rows[0].detections]
    assert found == [(a + i * size, b + i * size, label) for i in range(n) for a, b, label in of_line]
    assert len(found) >= 3 * n and rows[0].n_words == n * size and rows[1].detections == rows[2].detections == []
