import base64
import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from methylspark.llm import langid, mixing, preference, queries, sharding, warc
from methylspark.llm.common import scratch_path, staged
from pyspark.sql import functions as F

from .conftest import frame

PAGES = [(1, "http://a/ x\r\n", "<p>é</p>"), (2, "u", "same"), (3, None, "same"), (5, "u", "same"), (5, "u", "same"), (6, "u", None), (7, "u", ""), (None, "u", "alone"), (None, "v", "same"), (9, "u", "z" * 300_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(2)
    keep = []
    folder = scratch_path(spark, "warc-test")
    index = staged(warc.write_warc(warc.assign_records(pages), folder, archive_bytes=100_000, dict_bytes=1024), "index")
    keep = warc.read_warc(warc.archives(index)).collect()
    assert len(keep) == len(PAGES)
    best = {}
    for i, _, h in PAGES:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    texts = {hashlib.sha1((h or "").encode()).digest(): (h or "") for _, _, h in PAGES}
    for r in keep:
        text = texts[base64.b32decode(r.payload_digest)]
        assert r.payload_bytes == len(text.encode())
        response = r.page_id == best.get(text)
        assert r.record_type == ("response" if response else "revisit") and r.refers_to == (None if response else best[text])
        assert bytes(r.payload).decode() == text if response else r.payload is None
    assert Counter(r.page_id for r in keep) == Counter(p[0] for p in PAGES)
    one = index.filter("page_id = 9").first()
    head, block = warc.read_record(one.file, one.offset, one.length)
    assert head["WARC-Type"] == "response" and len(block) == 300_000 + len(warc.HTTP)
    assert warc.round_trip(pages.limit(0), scratch_path(spark, "warc-test"), lambda x: staged(x, "index")).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.assign_records(pages, min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_dictionary_helps_and_is_embedded():
    records = [warc.record(i, f"http://h/{i}", "response", None, f"<html><body>shared words {i * 7919}</body></html>".encode()) for i in range(2000)]
    data, at = warc.pack(records, 4096, 3)
    assert int.from_bytes(data[:4], "little") == warc.DICT_FRAME
    reader, start = warc.opened(data)
    assert at[0][0] == start and all(reader.decompress(data[o : o + n]) == r for (o, n), r in zip(at, records))
    import zstandard

    assert sum(n for _, n in at) < 0.6 * sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)


def test_poisson_counts(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 2.5), ("c", 900.0), ("z", 0.0), (None, 1.0)], "source string, rate double")
    cdf = {r.source: r.cdf for r in mixing.poisson_cdf(rates).collect()}
    assert "z" not in cdf
    for s, rate in (("a", 0.3), ("b", 2.5), (None, 1.0)):
        total = 0.0
        for k, c in enumerate(cdf[s][:12]):
            total += math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(total - c) < 1e-12
    assert abs(cdf["c"][-1] - 1) < 1e-9 and abs(cdf["c"][900] - 0.5) < 0.02


def test_large_rates_have_short_tables(spark):
    import numpy as np

    rates = spark.createDataFrame([("l", 1e6), ("m", 5000.0)], "source string, rate double")
    for r in mixing.poisson_cdf(rates).collect():
        rate = {"l": 1e6, "m": 5000.0}[r.source]
        k = np.arange(0, int(rate + 12 * rate**0.5 + 40))
        logs = np.r_[0, np.cumsum(np.log(k[1:]))]
        want = np.cumsum(np.exp(k * np.log(rate) - rate - logs))
        assert 0 < r.first < rate and len(r.cdf) < 25 * rate**0.5 + 100
        assert np.abs(want[r.first : r.first + len(r.cdf)] - np.array(r.cdf)).max() < 1e-6
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("m").alias("source"))
    counts = [r["count"] for r in mixing.replicate(docs, rates).groupBy("doc_id").count().collect()]
    assert len(counts) == 50 and abs(sum(counts) / 50 - 5000) < 50


@pytest.mark.parametrize("bound", [0, 10_000_000])
def test_mixing_meets_the_rates(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_BYTES", bound)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"), F.lit(9).alias("copy"))
    out = mixing.mix(docs, weights={"big": 1, "small": 1}, epochs=2.0).groupBy("source").count().collect()
    assert {r.source: round(r["count"] / 6000, 1) for r in out} == {"big": 1.0, "small": 1.0}
    a, b = (sorted(map(tuple, mixing.mix(x).select("doc_id", "copy", "shuffle_key").collect())) for x in (docs, docs.repartition(7)))
    assert a == b


def test_mixing_edges(docs, none):
    out = mixing.mix(docs, epochs=3.0)
    assert out.count() > docs.count() and set(docs.columns) <= set(out.columns)
    assert out.filter("source IS NULL").count() > 0
    assert mixing.mix(none).count() == 0


def brute_table(shards, size):
    orders = []
    for s in shards:
        a, b = sharding._number(f"{s}|offset") % size, sharding._number(f"{s}|step") % (size - 1) + 1
        orders.append([(a + i * b) % size for i in range(size)])
    table, turn = {}, 0
    while len(table) < size:
        i = turn % len(shards)
        table[next(x for x in orders[i] if x not in table)] = i
        turn += 1
    return [table[i] for i in range(size)]


def test_weights_by_name(spark):
    docs = frame(spark, [(1, "aaaa", "en", "a"), (2, "bb", "en", "b"), (3, "", "en", "c"), (4, None, "en", None)])
    rates = lambda **w: {r.source: r.rate for r in mixing.repetition_rates(docs, **w).collect()}
    assert rates(weights={"a": 1}) == {"a": 1.5, "b": 0.0, "c": 0.0, None: 0.0}
    assert rates(weights={"a": 1, "c": 2, "typo": 1}, epochs=2.0) == {"a": 1.0, "b": 0.0, "c": 2.0, None: 0.0}
    assert rates()["c"] == rates()[None] == 1.0
    with pytest.raises(Exception, match="no source has a weight"):
        rates(weights={"typo": 1})
    assert mixing.repetition_rates(docs.limit(0), weights={"typo": 1}).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    index = spark.createDataFrame([(f"file:///x/{i}.warc",) for i in range(100) for _ in range(3)], "file string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    parts = warc.archives(index).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) >= 8 and sum(r["count"] for r in parts) == 100


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 211)
    assert table == brute_table(names, 211)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, less) if a != 6)
    assert moved < 0.3 * 211
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_sharding(docs, rows, none):
    out = sharding.assign_shards(docs, ["a", "b", "c"], size=31)
    got = out.collect()
    table = sharding.fill_table(["a", "b", "c"], 31)
    assert len(got) == len(rows)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 31
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])
    assert sharding.assign_shards(none, ["a"], size=31).count() == 0


TURNS = [
    (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "other"), (1, 3, "assistant", None),
    (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (4, 0, "user", None), (6, 0, "system", "s"), (6, 0, "system", "s"), (6, 1, "assistant", "x"), (7, 0, "system", "s"), (7, 1, "assistant", "x"),
    (8, None, "user", "late"), (8, 0, None, "first"), (9, None, "user", "late"), (9, 0, None, "first"), (None, 0, "user", "lost"),
    (10, 0, "user", "q"), (10, 1, "assistant", "a"), (10, 5, "assistant", "b"), (11, 0, "user", "q"), (11, 2, "assistant", "a"), (11, 7, "assistant", "c"), (11, 9, "assistant", "d"),
]


def brute_preference(turns):
    out = []
    for pair in {None if c is None else c // 2 for c, *_ in turns}:
        sides = [], []
        for c, t, role, text in turns:
            if (None if c is None else c // 2) == pair:
                sides[0 if c is not None and c % 2 == 0 else 1].append((preference.LAST if t is None else t, role or "", text or ""))
        sides = [[(sorted({u for u, *_ in side}).index(t) + 1, t, role, text) for t, role, text in side] for side in sides]
        at = lambda side, p: Counter((role, text) for q, _, role, text in side if q == p)
        cut = min((p for p, *_ in sides[0] + sides[1] if at(sides[0], p) != at(sides[1], p)), default=None)
        for part, side in zip(("chosen", "rejected"), sides):
            for p, t, role, text in side:
                same = cut is None or p < cut
                if same and part == "rejected":
                    continue
                segment = f"<|im_start|>{role}\n{text}<|im_end|>\n"
                masked = not same and role == "assistant"
                s = segment.index("\n") + 1
                out.append((pair, "prompt" if same else part, p, None if t == preference.LAST else t, role, segment, s if masked else 0, len(segment) - 1 if masked else 0))
    return out


def test_preference(spark):
    c = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, part string").repartition(3)
    rows = preference.preference_segments(preference.neighbours(c))
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, brute_preference(TURNS)))
    pairs = preference.neighbours(c)
    folded = {r.pair_id: r for r in preference.preference_pairs(pairs).collect()}
    by_turns = {r.pair_id: r for r in preference.preference_pairs(pairs, row_turns=0).collect()}
    assert by_turns == folded  # the other way, for pairs of any size
    assert set(folded) == {None, 0, 1, 2, 3, 4, 5} and {r.piece for r in folded.values()} == {0}
    want = brute_preference(TURNS)
    for pair, r in folded.items():
        for part in ("prompt", "chosen", "rejected"):
            own = sorted((x for x in want if x[:2] == (pair, part)), key=lambda x: (x[2], x[4], hashlib.md5(x[5].encode()).hexdigest()))
            assert r[part] == "".join(x[5] for x in own)
            if part != "prompt":
                assert [r[part][s.start : s.end] for s in r[f"{part}_mask"]] == [x[5][x[6] : x[7]] for x in own if x[7]]
    r = folded[5]
    assert r.prompt.endswith("assistant\na<|im_end|>\n") and [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["c<|im_end|>", "d<|im_end|>"]
    pieces = preference.preference_pairs(pairs, row_chars=40).orderBy("pair_id", "piece").collect()
    assert max(r.piece for r in pieces) > 0
    for pair, r in folded.items():
        own = [x for x in pieces if x.pair_id == pair]
        assert [x.piece for x in own] == list(range(len(own)))
        assert all("".join(x[part] for x in own) == r[part] for part in ("prompt", "chosen", "rejected"))
        assert [x.rejected[s.start : s.end] for x in own for s in x.rejected_mask] == [r.rejected[s.start : s.end] for s in r.rejected_mask]
    r = folded[0]
    assert r.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["yes<|im_end|>"] and [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["<|im_end|>"]
    assert folded[1].chosen == folded[1].rejected == ""
    assert preference.preference_segments(preference.neighbours(c.limit(0))).count() == 0 and preference.preference_pairs(preference.neighbours(c.limit(0))).count() == 0


def brute_similar(texts):
    """For each text the least index that it reaches over five-word similarities of 0.8 or more."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    least = {}
    for i in range(len(texts)):
        queue = [] if i in least else [i]
        while queue:
            x = queue.pop()
            if x not in least:
                least[x] = i
                queue += [j for j in range(len(texts)) if j not in least and len(sets[x] & sets[j]) >= 0.8 * len(sets[x] | sets[j])]
    return least


def poisson_copies(rows, seed, temperature):
    """How often each row is kept, by the sums of the distribution's terms."""
    chars = Counter()
    for r in rows:
        chars[r.source] += len(r.text or "")
    weight = {s: n**temperature for s, n in chars.items()}
    out = []
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(chars.values()) / chars[r.source] if chars[r.source] else 1.0
        u = int(hashlib.md5(f"{seed}|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        out.append(n)
    return out


def test_pipeline_stages_on_a_small_table(spark, docs, rows):
    """Each stage against a plain version of what it should keep; leaks and near copies are planted."""
    from .conftest import frame, words
    from .test_text import brute_leaks

    sf_dir = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rnd = random.Random(8)
    long = [words(rnd, "en", 150) for _ in range(6)]
    more = [(500 + i, f"{long[i]} {items[i][1]} {words(rnd, 'en', 40)}", "en", "b") for i in range(3)]
    more += [(510 + i, long[3 + i] + " and one more word", "en", "a") for i in range(3)] + [(520 + i, long[3 + i], "en", "b") for i in range(3)]
    now = docs.select("doc_id", "text", "lang", "source", "n_chars").union(frame(spark, more).select("doc_id", "text", "lang", "source", "n_chars"))
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        out = staged(stage(spark, now, sf_dir), "stage")
        after = out.collect()
        ids = Counter(r.doc_id for r in after)
        if k == 0:
            _, _, rejected = langid.train(now).predict([r.text for r in before])
            assert ids == Counter(r.doc_id for r, x in zip(before, rejected) if not x)
            assert ids.keys() >= {r[0] for r in more} | {r.doc_id for r in before if r.lang == "en" and r.text and len(r.text) > 100}
            assert not any(r.text is None or r.text.strip() == "" for r in after)
        if k == 1:
            order = sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id))
            assert ids == Counter(order[i].doc_id for i in set(brute_similar([r.text for r in order]).values()))
            assert ids.keys() >= {500, 501, 502, 510, 511, 512} and not ids.keys() & {520, 521, 522}
        if k == 2:
            held = {d for d, _ in brute_leaks([(i, r.text) for i, r in enumerate(before)], items)}
            assert ids == Counter(r.doc_id for i, r in enumerate(before) if i not in held) and not ids.keys() & {500, 501, 502} and 510 in ids
        if k == 3:
            assert ids == Counter(r.doc_id for r, n in zip(before, poisson_copies(before, 7, 0.5)) for _ in range(n))
        if k == 4:
            owners = sharding.fill_table(queries.SHARDS, queries.SLOTS)
            for r in after:
                slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % queries.SLOTS
                assert (r.slot, r.shard) == (slot, queries.SHARDS[owners[slot]])
            assert Counter(r.doc_id for r in before) == ids
        assert out.columns == columns + ["slot", "shard"] * (k == 4)
        now = out


def test_pipeline_of_nothing(spark, none, tmp_path):
    """An empty table goes through every stage, and one of rows that nothing can be learnt from."""
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "a", 0), (2, "12 !", "en", None, 4), (3, "words", None, None, 5), (3, "words", None, None, 5)], empty.schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        odd = staged(stage(spark, odd, str(tmp_path)), "stage")
        if k in (0, 1, 2):
            assert [r.doc_id for r in odd.collect()] == [3] * (2 if k == 0 else 1)


def test_every_operator_is_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 5
