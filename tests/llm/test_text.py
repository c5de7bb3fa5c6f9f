import math
import random
import re
import time
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from methylspark.llm import decontam, langid, licenses, tokencount

from .conftest import LANGS, frame, words

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_language_id(spark, docs, rows, none):
    rnd = random.Random(2)
    many = frame(spark, [(1000 + i, words(rnd, lang, rnd.randint(20, 80)), lang, "a") for i in range(150) for lang in LANGS])
    model = langid.train(many.filter("doc_id % 4 != 0"), per_language=100)
    held = langid.identify(many.filter("doc_id % 4 = 0"), model).select("lang", "lang_pred", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert sum(r.rejected for r in held) <= 0.01 * len(held)
    found = langid.identify(docs, model)
    assert found.count() == len(rows) and set(docs.columns) <= set(found.columns)
    for r in found.collect():
        has = any(unicodedata.category(c)[0] == "L" for c in r.text or "")
        assert (r.lang_pred != "und") == has and 0 <= r.score <= 1 and (has or r.rejected)
    assert {r.rejected for r in found.filter("doc_id = 108").collect()} == {True}  # another script
    odd = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    strange = [(1, odd("abcdefghijklmnopqrstuvwxyz", 60)), (2, odd("kkyyääöjpvua", 60)), (3, "½ ² Ⅷ ① 12"), (4, "½ a"), (5, "Dunque quella città è più bella perché gli uomini vogliono cose giuste. " * 4)]
    short = [(100 + i, words(rnd, lang, n)) for i, (lang, n) in enumerate((lang, n) for lang in LANGS for n in (2, 3, 5, 8, 13) for _ in range(20))]
    table = spark.createDataFrame([*strange, *short], "doc_id long, text string")
    judged = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert all(judged[i].rejected for i in (1, 2, 3, 5)) and judged[3].lang_pred == "und" and judged[4].lang_pred != "und"
    assert sum(judged[i].rejected for i, _ in short) <= 0.02 * len(short)
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_predictions_are_those_of_the_nearest_centroid(spark, docs):
    """Against dictionaries of n-grams in full precision; the centroids are the model's."""
    rnd = random.Random(5)
    many = frame(spark, [(1000 + i, words(rnd, lang, rnd.randint(5, 60)), lang, "a") for i in range(60) for lang in LANGS])
    model = langid.train(many, per_language=60)

    def slot(gram):
        h = len(gram) * 0x27D4EB2F & 0xFFFFFFFF
        for c, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            h = (h ^ ord(c)) * m & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x165667B1 & 0xFFFFFFFF) >> 18

    for r in langid.identify(many, model).collect():
        text = " " + re.sub(r"[\W\d_]+", " ", r.text.lower()).strip() + " "
        count = Counter(slot(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1))
        x = {k: math.log(1 + v) * float(model.idf[k]) for k, v in count.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        cos = [sum(v / length * float(c[k]) for k, v in x.items()) for c in model.centroids]
        assert abs(max(cos) - r.score) < 1e-5 and max(cos) - max(v for v, lang in zip(cos, model.langs) if lang == r.lang_pred) < 1e-5
        assert r.rejected == (r.score < model.floors[model.langs.index(r.lang_pred), min(len(text) - 2, 1 << 9).bit_length() - 1])


def test_every_text_is_learnt_from(spark):
    """Of 2,000 texts of a language each counts; the model does not depend on how rows are dealt out."""
    rnd = random.Random(21)
    rows = [(i, words(rnd, lang, rnd.randint(3, 12)) + ("" if i % 1999 else " qqzzqq"), lang, "a") for i, lang in enumerate(["en"] * 2000 + ["de"] * 30)]
    model, again = langid.train(frame(spark, rows)), langid.train(frame(spark, rows).repartition(7, "doc_id"))
    df = (sum(langid.counts([langid.plain(t)]) > 0 for _, t, *_ in rows))[0]
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1, atol=1e-5)
    assert model.langs == again.langs and (model.centroids == again.centroids).all() and (model.floors == again.floors).all()


def jobs_of(spark, name, call):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["languages", "passages"])
def test_sums_take_few_jobs_however_many_partitions(spark, kind):
    """The driver asked for one partition after the other, in a job each."""
    found = []
    for partitions in (3, 60):
        session = spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", partitions)
        session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        if kind == "languages":
            rows = [(lang, False, True, words(random.Random(i), lang, 12)) for i, lang in enumerate(list(LANGS) * 40)]
            tallies = langid._tallies(session.createDataFrame(rows, "lang string, kept boolean, fitted boolean, text string").repartition(4))
            call = lambda: langid._sums(tallies, np.ones(langid.DIM, np.float32), {})
        else:
            codes = [(np.random.default_rng(i).integers(0, 700, 150).astype(np.int32).tobytes(),) for i in range(50)]
            coded = session.createDataFrame(codes, "codes binary").repartition(4)
            call = lambda: {0: (50, decontam._gram(coded, np.ones(701), np.random.default_rng(1).random((700, 5))))}
        out, jobs = jobs_of(session, f"{kind} {partitions}", call)
        assert 1 <= jobs <= 8
        found.append(out)
    few, many = found
    assert few.keys() == many.keys() and all(few[k][0] == many[k][0] and np.allclose(few[k][1], many[k][1], rtol=1e-5) for k in few)


def test_of_too_many_languages_those_of_most_rows_are_learnt(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, words(rnd, lang, 20), lang, "a") for i, lang in enumerate(["en"] * 30 + ["de"] * 25 + ["fr"] * 5)]
    rows += [(100 + i, words(rnd, "fr", 5), f"dirt {i}", "a") for i in range(2000)]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    model = langid.train(frame(spark, rows))
    assert set(model.langs) == {"en", "de"} and model.left_out == 2001
    assert {r.lang_pred for r in langid.identify(frame(spark, rows[:55]), model).collect()} == {"en", "de"}


def test_counts_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = langid.plain(words(random.Random(3), "de", 400))
    whole = langid.counts([text])
    monkeypatch.setattr(langid, "STEP_CHARS", 97)
    assert (langid.counts([text]) == whole).all()
    assert (langid.counts([text, "ab", text])[[0, 2]] == whole).all()


def brute_places(text, phrase):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    p = phrase.split()
    return w, [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def test_licenses(spark, rows, none):
    more = [
        (200, "Licensed under the Apache License, Version 2.0.", None, None), (201, "GNU GENERAL PUBLIC LICENSE; gnu general public license v3 or later", None, None),
        (202, "This is CC BY-NC 4.0, cc-by cc by cc", None, None), (203, "emit license, mit licenses, the MIT_License éMIT license", None, None), (204, "mit " * 500 + "license " + "MIT License. " * 2000, None, None),
    ]
    got = {}
    for r in licenses.scan_licenses(frame(spark, [*rows, *more])).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) + len(more)
    for d, t, *_ in [*rows, *more]:
        if d is None:
            continue
        w, found = [], {}
        for phrase, label in BASE.items():
            w, at = brute_places(t, phrase)
            found[label] = at
        at = sorted(i for x in found.values() for i in x)
        for r in got[d]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
            assert r.base_labels == ",".join(sorted(k for k, v in found.items() if v)) and 0 <= r.score <= 1
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "apache-2.0" in got[200][0].labels and "gpl-3.0" in got[201][0].labels and got[202][0].labels == "cc-by,cc-by-nc-4.0"
    assert licenses.scan_licenses(none).count() == 0


def phrases(pattern):
    """All that a pattern without unbounded repeats matches."""
    from re import _parser

    def of(tree):
        out = [""]
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                new = [chr(arg)]
            elif op == "IN":
                new = [chr(c if str(kind) == "LITERAL" else c[0]) for kind, c in arg]
            elif op == "BRANCH":
                new = [x for t in arg[1] for x in of(t)]
            elif op == "MAX_REPEAT" and arg[:2] == (0, 1):
                new = ["", *of(arg[2])]
            elif op == "MAX_REPEAT":
                assert arg[0] == arg[1] or arg[:2] == (1, 2)
                new = [x * arg[0] for x in of(arg[2])]
            elif op == "SUBPATTERN":
                new = of(arg[3])
            else:
                raise ValueError(op)
            out = [a + b for a in out for b in new]
        return out

    return sorted(set(of(_parser.parse(pattern))))


def test_no_gate_stops_what_its_pattern_matches():
    from dataclasses import replace

    gated = licenses.rules()
    for label, name, _ in (*licenses.names(), *licenses.short_forms()):
        own = [r for r in gated if r.label == label]
        free = [replace(r, keywords=frozenset()) for r in own]
        for x in phrases(name):
            for text in (f"a {x} z".encode(), f"a licensed under the terms of the {x} z".encode()):
                got = licenses.scan(text, own)
                assert got == licenses.scan(text, free) and label in got["labels"].split(","), x
    for label, pattern, keywords in (*licenses.TEXTS, *licenses.addresses()):
        own = [r for r in gated if r.label == label]
        free = [replace(r, keywords=frozenset()) for r in own]
        for x in phrases(pattern):
            assert set(keywords.split()) <= set(x.split()), x
            text = f"a {x} z".encode()
            got = licenses.scan(text, own)
            assert got == licenses.scan(text, free) and label in got["labels"].split(","), x
    for text, label in (("Creative Commons Attribution-ShareAlike", "cc-by-sa"), ("CC Zero", "cc0-1.0"), ("FreeBSD license", "bsd-2-clause"), ("0BSD license", "0bsd")):
        assert licenses.scan(text.encode(), gated)["labels"] == label


def test_license_texts_and_addresses():
    """Parts of well-known notices, as they stand in files."""
    rules = licenses.rules()
    for text, labels in (
        ("// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\")", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
        ("This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or", "gpl,gpl-3.0"),
        ("the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "apache,apache-2.0"),
        ("see http://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-nc-sa/4.0/", "apache-2.0,cc-by-nc-sa-4.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.", "mpl-2.0"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ):
        assert licenses.scan(text.encode(), rules)["labels"] == labels, text


NOTICES = """
This project is GPLv3.|gpl-3.0
License: GPLv2|gpl-2.0
GPL-2.0-or-later|gpl-2.0
GPL v2 only|gpl-2.0
GNU GPLv2|gpl-2.0
GNU GPL version 3 or later|gpl-3.0
distributed under the GNU GPL|gpl
LGPL-2.1|lgpl-2.1
LGPLv2.1|lgpl-2.1
LGPLv3 or later|lgpl-3.0
GNU LGPL|lgpl
GNU Lesser General Public License|lgpl
GNU Library General Public License|lgpl
AGPLv3|agpl-3.0
AGPL-3.0-only|agpl-3.0
GNU AGPL|agpl-3.0
MPL 2.0|mpl-2.0
MPLv2|mpl-2.0
MPL-1.1|mpl-1.1
EPL-2.0|epl-2.0
Apache-2.0|apache-2.0
Apache 2.0 licensed|apache-2.0
ASL 2.0|apache-2.0
runs behind an Apache 2 server|
the EPL matches of the season|
License: MIT|mit
licensed under MIT|mit
MIT licensed|mit
MIT/X11|mit
a professor at MIT|
BSD licensed|bsd
License: ISC|isc
SPDX-License-Identifier: MIT OR Apache-2.0|apache-2.0,mit
SPDX-License-Identifier: Apache-2.0 OR MIT|apache-2.0,mit
SPDX-License-Identifier: (MIT AND BSD-3-Clause)|bsd-3-clause,mit
SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0|classpath-exception-2.0,gpl-2.0
SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception|apache-2.0,llvm-exception
SPDX-License-Identifier: LGPL-2.1-or-later|lgpl-2.1
CC BY-NC-SA 2.0|cc-by,cc-by-nc-sa-2.0
CC BY-NC-ND 2.5|cc-by,cc-by-nc-nd-2.5
CC-BY-SA-2.5|cc-by,cc-by-sa-2.5
CC BY 4.0|cc-by,cc-by-4.0
Creative Commons Attribution-NonCommercial 1.0|cc-by-nc-1.0
https://creativecommons.org/licenses/by-nd/2.0/|cc-by-nd-2.0
CDDL 1.1|cddl-1.1
EUPL-1.2|eupl-1.2
OFL-1.1|ofl-1.1
Artistic-2.0|artistic-2.0
MS-PL|ms-pl
BSL-1.0|bsl-1.0
GNU General Public License, either version 2 of the License|gpl,gpl-2.0
GNU Lesser General Public License, either version 3|lgpl-3.0
"""


def test_notices_with_labels_written_by_hand():
    rules = licenses.rules()
    for line in NOTICES.strip().splitlines():
        text, labels = line.split("|")
        assert licenses.scan(text.encode(), rules)["labels"] == labels, text


def test_labels_and_score_against_a_plain_scan():
    """Every rule on every text, and each detection against all others."""
    rnd = random.Random(11)
    rules = licenses.rules()
    parts = [x for _, p, _ in (*licenses.names(), *licenses.short_forms(), *licenses.TEXTS, *licenses.addresses()) for x in rnd.sample(phrases(p), 1)]
    for _ in range(150):
        text = " ".join(rnd.choice([rnd.choice(parts), rnd.choice(["released under the", "spdx license identifier", "under", "version 2", "or later", "x y"])]) for _ in range(rnd.randint(0, 12)))
        found = [(m.start(), m.end(), r) for r in rules for m in re.finditer(r.pattern.pattern.decode(), f" {text} ")]
        kept = []
        for x in sorted(found, key=lambda x: (-x[2].priority, -(x[1] - x[0]), x[0], x[2].label)):
            if not any(k[0] <= x[0] and x[1] <= k[1] for k in kept):
                kept.append(x)
        base = [label for phrase, label in BASE.items() if brute_places(text, phrase)[1]]
        got = licenses.scan(text.encode(), rules)
        assert got["labels"] == ",".join(sorted({*base, *(r.label for _, _, r in kept)}))
        assert got["score"] == max([0.8 * bool(base), *(r.relevance for _, _, r in kept)])
        assert [x["label"] for x in got["spans"]] == [r.label for _, _, r in sorted(kept, key=lambda x: (x[0], x[1]))]


def test_license_rules_suppress_what_they_contain():
    rules = licenses.rules()
    assert len(rules) > 200
    found = licenses.scan(b"released under the GNU Lesser General Public License v2.1 or later", rules)
    assert [x["label"] for x in found["spans"]] == ["lgpl-2.1"]
    text = b"x y SPDX-License-Identifier: MIT z"
    assert licenses.scan(text, rules)["spans"] == [{"label": "mit", "first": 2, "words": 4}]


def test_leaks(spark, docs, none):
    rnd = random.Random(9)
    items = [(i, words(rnd, "en", n)) for i, n in enumerate([12, 20, 40, 64, 150])] + [(90, None), (91, ""), (0, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noise = lambda n: words(rnd, "fr", n)
    planted = []
    for i, t in items[:5]:
        planted.append((300 + i, f"{noise(37)} {t.upper()}. {noise(80)}", None, None))
        w = t.split()
        w[len(w) // 3] = "changed"
        planted.append((310 + i, f"{noise(5)}\n{', '.join(w)}; {noise(11)}", None, None))
    clean = [(400 + i, words(rnd, "en", 150), None, None) for i in range(20)]
    table = docs.union(frame(spark, [*planted, *clean]))
    found = decontam.find_leaks(table, bench, rank=32)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    want = {(300 + i, i) for i in range(5)} | {(310 + i, i) for i in range(5)}
    assert set(got) == want
    assert all(r.kind == "copy" and r.item_share > 0.8 for r in got.values())
    kept = decontam.drop_leaks(table, bench, rank=32)
    assert kept.columns == docs.columns and kept.count() == table.count() - len(want)
    assert decontam.find_leaks(none, bench).count() == 0
    assert decontam.find_leaks(docs, bench.filter("item_id > 89")).count() == 0


def test_the_latent_space_is_that_of_all_passages_of_all_documents(spark, monkeypatch):
    """Of 9,000 documents whose first and later passages hold different words; the matrix is multiplied out here."""
    rnd = np.random.default_rng(8)
    vocab = np.array([f"w{i:02d}" for i in range(28)])  # as many as the sketch has columns, so that it is exact
    items = [(i, " ".join(vocab[i * 4 : i * 4 + 4])) for i in range(7)]
    text = lambda lo, hi, n: " ".join(rnd.choice(vocab[lo:hi], n))
    texts = [f"{text(0, 9, 64)} {text(18 - 9 * (i % 2), 28 - 9 * (i % 2), 64 + i % 9)}" for i in range(9000)]
    fitted, place = [], decontam.Index.place
    monkeypatch.setattr(decontam.Index, "place", lambda index: (fitted.append(index), place(index)))
    decontam.find_leaks(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string"), rank=12)
    (index,) = fitted
    codes = [index.codes(decontam.words_of(t)) for t in texts]
    passages = [c[k : k + 64] for c in codes for k in range(0, len(c), 64)]
    a, b = (index.dense(x).astype(float) for x in (passages, [index.codes(w) for w in index.items]))
    gram = a.T @ a + len(passages) / len(b) * b.T @ b
    basis = index.basis[:-1].astype(float)
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-5)
    values = np.linalg.eigvalsh(gram)[:-13:-1]
    assert np.abs(gram @ basis - basis * values).max() < 1e-4 * values[0]


@pytest.mark.parametrize("n", [1000, 4000])
def test_copies_are_found_when_items_outnumber_the_rank(spark, n):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    items = [(i, text(rnd.randint(15, 59))) for i in range(n)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = rnd.sample(items, 200)
    table = frame(spark, [(i, f"{text(rnd.randint(20, 60))} {t} {text(50)}", None, None) for i, t in held])
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(table, bench).collect()}
    assert got == {(i, i) for i, _ in held}


def test_short_items_in_long_documents(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("klmnopqrst") for _ in range(6))
    rare, common = [word() for _ in range(2000)], [word() for _ in range(40)]
    text = lambda k: " ".join(rnd.choice(common if rnd.random() < 0.1 else rare) for _ in range(k))
    items = [(m, " ".join(rnd.sample(common, m))) for m in range(1, 12)]
    bench = spark.createDataFrame([*items, *((50 + i, " ".join(rare[i : i + 50])) for i in range(0, 2000, 50))], "item_id long, text string")  # the last make all words known
    planted = [(m, f"{text(201)} {t} {text(300)}", None, None) for m, t in items]
    changed = [(100 + m, f"{text(203)} {' '.join(w if k != m // 2 else 'y' for k, w in enumerate(t.split()))} {text(300)}", None, None) for m, t in items if m >= 5]
    clean = [(200 + i, text(500), None, None) for i in range(20)]
    halves = [(300 + m, f"{text(99)} {' '.join(t.split()[: m // 2])} {text(99)}", None, None) for m, t in items if m > 1]
    table = [*planted, *changed, *clean, *halves]
    want = {(d, i) for d, x, *_ in table for i, t in items if f" {t} " in f" {x} "}
    assert {(m, m) for m in range(1, 12)} <= want
    found = decontam.find_leaks(frame(spark, table), bench, rank=32).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want |= {(100 + m, m) for m in range(5, 12)}
    assert want <= got and {x for x in got - want if x[1] >= 5} == set()  # three or four words may stand in order by chance
    assert all(r.item_share >= 0.6 for r in found) and all(r.kind == "copy" for r in found if (r.doc_id, r.item_id) in want)


def altered(rnd, words, share, word):
    """A paraphrase that keeps the last quarter: of the rest ``share`` is replaced or left out, and some words are put between."""
    head, answer = words[: -max(1, len(words) // 4)], words[-max(1, len(words) // 4) :]
    hit = set(rnd.sample(range(len(head)), int(share * len(words))))
    out = []
    for i, w in enumerate(head):
        if i in hit:
            out += [word()] if rnd.random() < 0.7 else []
        else:
            out += [w, word()] if rnd.random() < 0.08 else [w]
    return out + answer


def brute_leaks(docs, items, rule=decontam.Rule()):
    """All (document, item) with a copy or paraphrase at any place, by common subsequences of every span with every item."""
    found = {}
    for d, text in docs:
        w = decontam.words_of(text)
        for i, item in items:
            x = decontam.words_of(item)
            answer, span = x[-max(1, len(x) // 4) :], max(len(x), 16) + len(x) // 4
            known = np.r_[0, np.cumsum([v in set(x) for v in w])]
            for s in range(max(1, len(w) - len(x) // 2)):
                part = w[s : s + span]
                if known[min(len(w), s + span)] - known[s] < rule.paraphrase * len(x):
                    continue
                share = decontam.subsequence(x, part) / len(x)
                if share >= rule.copy or share >= rule.paraphrase and decontam.subsequence(answer, part) >= rule.answer * len(answer):
                    kind = "copy" if share >= rule.copy else "paraphrase"
                    found[d, i] = min(found.get((d, i), kind), kind)
    return found


def leaky(seed):
    """Items of 1 to 150 words over common and rare words, and documents that hold copies, altered copies, paraphrases, halves and nothing."""
    rnd = random.Random(seed)
    rare, common = [f"r{seed}{k}" for k in range(3000)], [f"c{seed}{k}" for k in range(60)]
    word = lambda: rnd.choice(common if rnd.random() < 0.35 else rare)
    lengths = [*range(1, 16), *(rnd.randint(16, 64) for _ in range(50)), 65, 80, 96, 97, 128, 129, 150]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(lengths)]
    text = lambda n: [word() if rnd.random() < 0.5 else f"u{rnd.randint(0, 20000)}" for _ in range(n)]
    docs, copies, paraphrases = [], set(), set()
    for i, t in items:
        w = t.split()
        new = lambda: word() if rnd.random() < 0.5 else f"n{rnd.randint(0, 9999)}"
        made = [w]
        if len(w) >= 12:
            made += [altered(rnd, w, 0.1, new), altered(rnd, w, 0.27, new), altered(rnd, w, 0.27, new)]
        for k, x in enumerate(made):
            d = len(docs)
            docs.append((d, " ".join([*text(rnd.randint(0, 150)), *x, *text(rnd.randint(0, 150))])))
            (copies if k == 0 else paraphrases).add((d, i))
        docs.append((len(docs), " ".join([*text(60), *w[: len(w) // 3], *text(60)])))
    docs += [(len(docs) + k, " ".join(text(200))) for k in range(30)]
    return docs, items, copies, paraphrases


def test_leaks_against_every_span_of_every_text(spark):
    docs, items, copies, paraphrases = leaky(31)
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rank=96).collect()
    got = {(r.doc_id, r.item_id): r.kind for r in found}
    want = brute_leaks(docs, items)
    long_enough = {i for i, t in items if len(t.split()) >= 12}
    assert copies <= set(got) and all(got[x] == "copy" for x in copies)
    assert all(x in want or x[1] not in long_enough for x in got)  # nothing else, but of items of a few words
    asked = [x for x in want if x[1] in long_enough]
    assert len([x for x in asked if want[x] == "paraphrase"]) > 60
    assert sum(x in got for x in asked) >= 0.97 * len(asked), (len(asked), sorted(set(asked) - set(got)))
    assert sum(x in got for x in asked if want[x] == "paraphrase") >= 0.95 * sum(want[x] == "paraphrase" for x in asked)


@pytest.mark.parametrize("a, b, n", [("a b c d", "b x d", 2), ("a a b", "a b a", 2), ("a", "", 0), ("a b", "a b", 2)])
def test_subsequence(a, b, n):
    assert decontam.subsequence(a.encode().split(), b.encode().split()) == n


def test_a_paraphrase_needs_the_answer():
    item = [b"w%d" % i for i in range(40)]
    index = decontam.Index([1], [item], [item[-10:]], decontam.Rule())
    index.candidates = lambda codes: [(0, 0, 0, 64, 0.9)]
    codes = lambda words: None
    index.codes = codes
    half = [w for i, w in enumerate(item[:30]) if i % 2] + item[-10:]
    assert [x[-1] for x in index.leaks([half])[0]] == ["paraphrase"]
    assert index.leaks([item[:26] + [b"x"] * 14]) == [[]]


def test_token_counts(docs, rows, none):
    trees = tokencount.build_trees(docs).cache()
    edits = tokencount.find_redactions(docs).cache()
    out = tokencount.count_with_edits(docs, trees, tokencount.apply_edits(docs, trees, edits)).collect()
    c = tokencount.counter(tokencount.TOKENIZER)
    want = []
    for d, t, *_ in rows:
        text = t or ""
        ed = tokencount.redactions_of(text)
        new = text
        for s, e, r in reversed(ed):
            new = new[:s] + r + new[e:]
        want.append((d, len(c.encode(text)), len(ed), len(c.encode(new))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in out], key=key) == sorted(want, key=key)
    empty = tokencount.build_trees(none)
    assert empty.count() == 0 and tokencount.count_with_edits(none, empty, tokencount.apply_edits(none, empty, tokencount.find_redactions(none))).count() == 0


def test_updates_equal_encoding_anew():
    rnd = random.Random(1)
    c = tokencount.counter(tokencount.TOKENIZER)
    base = "Some  words, it's 12345 tested\n\n  here über 漢字 and more\t. " * 30
    for _ in range(300):
        text = base[: rnd.choice([0, 3, 40, 500, len(base)])]
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 2 * rnd.randint(1, 4)) // 2 * 2))
        edits = [(a, b, rnd.choice(["", " ", "'s", "new word", "\n\n ", "1"])) for a, b in zip(cuts[::2], cuts[1::2])] or [(0, 0, "abc")]
        chars, tokens, _ = c.leaves(text)
        chars, tokens = tokencount.tree_of(chars), tokencount.tree_of(tokens)
        new, _ = tokencount.update(text, edits, chars, tokens, c)
        assert tokens[1] == len(c.encode(new)) and chars[1] == len(new)


def test_a_small_edit_touches_a_small_part():
    c = tokencount.counter(tokencount.TOKENIZER)
    text = "word after word " * 5000
    chars, tokens, n = c.leaves(text)
    _, anew = tokencount.update(text, [(40_000, 40_004, "other")], tokencount.tree_of(chars), tokencount.tree_of(tokens), c)
    assert anew <= 3 * tokencount.LEAF < n


def test_redactions_of_long_texts_take_seconds():
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["a@b.c", "12345678", "x9@y.z12345", "word"]) for _ in range(700_000))  # 5 MB
    began = time.time()
    found = tokencount.redactions_of(text)
    assert time.time() - began < 20 and len(found) > 300_000
    short = text[:3000]
    mails = [(m.start(), m.end(), "<email>") for m in re.finditer(r"\S*@\S*", short)]
    numbers = [(m.start(), m.end(), "<number>") for m in re.finditer(r"\d{5,}", short) if not any(s < m.end() and m.start() < e for s, e, _ in mails)]
    assert tokencount.redactions_of(short) == sorted(mails + numbers)


def long_index(n):
    rnd = random.Random(4)
    vocabulary = [f"w{i}".encode() for i in range(3000)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.choice([8, 20, 40, 90]))] for _ in range(n)]
    index = decontam.Index(list(range(n)), items, [w[-4:] for w in items], decontam.Rule())
    index.vocab = {w: k for k, w in enumerate(sorted({w for x in items for w in x}))}
    index.idf = np.r_[np.full(len(index.vocab), 5.0), 6.0].astype(np.float32)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(index.vocab), 64)))[0]
    index.basis = np.r_[q, np.zeros((1, 64))].astype(np.float32)
    index.place()
    index.sow()
    return rnd, vocabulary, items, index


def test_pieces_of_long_texts_find_what_whole_texts_do(monkeypatch):
    rnd, vocabulary, items, index = long_index(40)
    texts = [[rnd.choice(vocabulary) for _ in range(n)] for n in (0, 5, 700, 64, 2000)]
    for k in (3, 9, 33):
        texts[4][k * 50 : k * 50 + len(items[k])] = items[k]
    found = {}
    for size in (64, 1 << 15):
        monkeypatch.setattr(decontam, "PIECE_WORDS", size)
        found[size] = sorted((t, i, s, e, round(cos, 3)) for t, i, s, e, cos in index.candidates([index.codes(w) for w in texts]))
        assert {3, 9, 33} <= {i for i, *_ in index.leaks(texts)[4]}
    assert len(found[64]) > 5 and {x[:4] for x in found[64]} == {x[:4] for x in found[1 << 15]}


def test_windows_are_close_that_are_so_one_by_one():
    """Texts shorter than any window, ends of texts and stretches of words that no item has, against each window's own sum."""
    rnd, vocabulary, items, index = long_index(60)
    rule, unknown = index.rule, [f"u{i}".encode() for i in range(50)]
    texts = [[rnd.choice(vocabulary) for _ in range(n)] for n in (0, 1, 5, 8, 9, 23, 64, 65, 700)]
    for k in range(40):
        texts.append([*items[k], *rnd.sample(unknown, rnd.randint(0, 40)) * rnd.randint(0, 6), *items[k + 20][: rnd.randint(3, 20)]])
    codes = [index.codes(w) for w in texts]
    weighted, idf = index.weighted.astype(float), index.idf.astype(float)
    want, doubtful = {}, set()
    for t, c in enumerate(codes):
        c = np.r_[c, np.full(-len(c) % decontam.STEP, len(index.vocab))]  # a block that isn't full ends with unknown words
        for n, ids, q in index.queries:
            for s in range(0, len(c), decontam.STEP):
                part = c[s : s + n]
                norm, known = (idf[part] ** 2).sum(), (idf[part[part < len(index.vocab)]] ** 2).sum()
                own = weighted[part].sum(axis=0)
                cos = own @ q.astype(float) / max(np.linalg.norm(own), 1e-3 * norm**0.5)
                for i, x in zip(ids.tolist(), cos.tolist()):
                    key = (t, i, s, min(s + n, len(c)))
                    if abs(x - rule.cosine) < 1e-4 or abs(known - rule.cosine**2 * norm) < 1e-3:
                        doubtful.add(key)
                    elif x >= rule.cosine and known >= rule.cosine**2 * norm:
                        want[key] = max(x, want.get(key, 0))
    got = {}
    for *key, cos in index.candidates(codes):
        got[tuple(key)] = max(cos, got.get(tuple(key), 0))
    assert len(want) > 200 and got.keys() - doubtful == want.keys() - doubtful
    assert all(abs(got[x] - want[x]) < 1e-5 for x in want.keys() - doubtful)


@pytest.mark.parametrize("size", [1, 1 << 22])
def test_codes_are_those_of_the_words_one_by_one(spark, monkeypatch, size):
    texts = ["", None, "a b a", " A  b\tx\x0bÑandú-ñandú\u00a0y\x00b ", "...", "İ K ΑΣ. ς", "b" * 5000, "x " * 3000 + "extra a", "\x1c\x85 \u2028b"]
    index = decontam.Index([1], [[b"a", b"b"]], [[b"extra", b"a"]], decontam.Rule(), {b"a": 0, b"b": 1, "ñandú".encode(): 2}, {b"extra": 4})
    numbers = index.vocab | index.extra
    monkeypatch.setattr(decontam, "BATCH_BYTES", size)
    names = pa.array([w.decode() for w in index.names()])
    for some in (texts, texts[:2], []):
        got = decontam.coded_words([decontam.spaced(t) or None for t in some], names, 3)
        assert [np.frombuffer(x.as_buffer(), np.int32).tolist() for x in got] == [[numbers.get(w, 3) for w in decontam.words_of(t)] for t in some]
    rows = decontam._coded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), index).collect()
    assert {r.doc_id: np.frombuffer(r.codes, np.int32).tolist() for r in rows} == {i: [numbers.get(w, 3) for w in decontam.words_of(t)] for i, t in enumerate(texts)}


def test_words_are_asked_for_only_where_enough_of_an_item_stands():
    rnd, vocabulary, items, index = long_index(40)
    half = [[w for k, w in enumerate(x) if k % 2] for x in items if len(x) >= 20]  # close to the item, but short of it
    texts = [*half, *([rnd.choice(vocabulary) for _ in range(30)] + x + [rnd.choice(vocabulary) for _ in range(30)] for x in items)]
    codes, asked = [index.codes(w) for w in texts], set()
    found = index.held(codes, lambda t: (asked.add(t), texts[t])[1])
    near = {t for t, *_ in index.candidates(codes)}
    assert len(near & set(range(len(half)))) > 10
    assert {t for t, x in enumerate(found) if x} == set(range(len(half), len(texts))) == asked
    plain = decontam.Index(index.ids, items, index.answers, index.rule, index.vocab, {}, index.idf, index.basis)
    plain.place()  # without the words' numbers of items, all near windows are compared word by word
    assert all({i for i, *_ in x} <= {i for i, *_ in y} for x, y in zip(plain.leaks(texts), found))


def test_a_text_of_megabytes_is_searched_in_bounded_memory():
    rnd, vocabulary, items, index = long_index(4000)
    text = [rnd.choice(vocabulary) for _ in range(800_000)]  # about 5 MB
    text[500_000 : 500_000 + len(items[7])] = items[7]
    tracemalloc.start()
    found = index.candidates([index.codes(text)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(i == 7 and abs(s - 500_000) < 100 for _, i, s, _, _ in found) and peak < 1 << 30
