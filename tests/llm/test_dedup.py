import hashlib
import itertools
import random
import re

import xxhash
from pyspark.sql import functions as F
from .conftest import frame
from methylspark.llm import common, exactdedup, simhash, similar
from methylspark.llm.components import components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected_groups(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    return groups


def check_exact(got, rows):
    groups = expected_groups(rows)
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for h, ids in by_hash.items():
        own = [r for r in got if r.text_sha256 == h]
        assert sorted((r.doc_id is None, r.doc_id) for r in own) == sorted((i is None, i) for i in ids)
        least = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in own} == {least} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [least]


def test_exact_groups(docs, rows):
    check_exact(exactdedup.exact_groups(docs, block_bytes=64).collect(), rows)


def test_exact_groups_when_block_hashes_collide(docs, rows):
    check_exact(exactdedup.exact_groups(docs, block_bytes=256, hash_bits=3).collect(), rows)


def test_blocks_that_differ_late_or_in_length(spark):
    base = "ab" * 1000
    rows = [(1, base, None, None), (2, base + "a", None, None), (3, base[:-1] + "x", None, None), (4, base, None, None), (5, base * 2, None, None)]
    check_exact(exactdedup.exact_groups(frame(spark, rows), block_bytes=16).collect(), rows)


def signed_hash(data):
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def test_names_are_places_in_the_order_of_blocks_on_any_layout(spark, docs, rows):
    def names(partitions):
        return {(r.doc_id, r.text_sha256): (r.n_blocks, r.name) for r in exactdedup.block_identities(docs.repartition(partitions), block_bytes=4096).collect()}

    spark.conf.set("spark.sql.shuffle.partitions", "3")
    few = names(3)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    many = names(50)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == many and len(few) > 50
    blocks = sorted({norm(t).encode()[i : i + 4096] for _, t, *_ in rows for i in range(0, max(1, len(norm(t).encode())), 4096)}, key=lambda b: (b[:32], signed_hash(b)))
    for d, t, *_ in rows:
        data = norm(t).encode()
        if len(data) <= 4096:
            n, name = few[d, hashlib.sha256(data).hexdigest()]
            assert n == 1 and blocks[name - 1] == data


def test_large_groups_are_joined_apart(docs, rows, monkeypatch):
    monkeypatch.setattr(exactdedup, "HOT_SHARE", 1 / 40)
    check_exact(exactdedup.exact_groups(docs, block_bytes=64).collect(), rows)


def test_exact_groups_of_nothing(none):
    assert exactdedup.exact_groups(none).count() == 0


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """From (id, fingerprint): the smallest id that each reaches."""
    left, out = set(range(len(fps))), {}
    while left:
        queue, comp = [left.pop()], []
        while queue:
            i = queue.pop()
            comp.append(i)
            near = [j for j in left if (fps[i][1] ^ fps[j][1]).bit_count() <= 3]
            left.difference_update(near)
            queue += near
        least = min((fps[i][0] for i in comp if fps[i][0] is not None), default=None)
        out |= {i: least for i in comp}
    return out


def test_simhash_groups(docs, rows):
    got = simhash.simhash_groups(docs).collect()
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    comp = brute_components(fps)
    want = [(d, f"{f:016x}", comp[i]) for i, (d, f) in enumerate(fps)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_link_of_three_bits_is_missed(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            for _ in range(12):
                x = b
                for bit in rnd.sample(range(64), n):
                    x ^= 1 << bit
                fps.add(x)
        low = rnd.randint(0, 18)  # three bits in one field
        fps.add(b ^ 7 << low)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.close_links(table).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(list(zip(signed, fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        assert (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])) == (want[i] == want[j])


def test_drop_near_copies_keeps_one_of_each(docs, rows):
    kept = simhash.drop_near_copies(docs, n=3, similarity=None)
    assert kept.columns == docs.columns
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = brute_components(list(enumerate(fps)))
    assert kept.count() == len(set(comp.values()))


def test_radius_and_fields_are_parameters(spark):
    assert len(simhash.variant_masks()) == 131 and len(simhash.variant_masks(2, 1)) == 1
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(3)]
    fps = {b ^ sum(1 << x for x in rnd.sample(range(63), k)) for b in base for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(4)}
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    for radius, fields in ((1, 3), (4, 4), (5, 5)):
        links = simhash.close_links(table, radius, fields).collect()
        assert all((r.a ^ r.b).bit_count() <= radius for r in links)
        roots = {r.node: r.root for r in components(spark.createDataFrame(links or [(None, None)], "a long, b long")).collect()}
        want = {}
        for i in fps:  # the least that each reaches
            if i not in want:
                queue = [i]
                while queue:
                    x = queue.pop()
                    want[x] = i
                    queue += [y for y in fps if y not in want and (x ^ y).bit_count() <= radius]
        for i, j in itertools.combinations(fps, 2):
            assert (roots.get(i, i) == roots.get(j, j)) == (want[i] == want[j])


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    """A family of copies around one text, chains that leave it step by step, and strangers, all under the same keys."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(similar, "band_keys", lambda x: [1] * similar.BANDS if len(x) else [])
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        w[rnd.randrange(60)] = f"x{rnd.random()}"
        texts.append(" ".join(w))
    chain = list(base)
    for k in range(12):  # the k-th is like the one before, and soon unlike the first
        chain = [*chain[3:], *(f"c{k}{j}" for j in range(3))]
        texts.append(" ".join(chain))
    texts += [" ".join(f"s{k}w{i}" for i in range(30)) for k in range(20)]
    rnd.shuffle(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    left, want = set(range(len(texts))), set()
    while left:
        queue, comp = [left.pop()], []
        while queue:
            comp.append(x := queue.pop())
            near = [j for j in left if len(sets[x] & sets[j]) >= 0.8 * len(sets[x] | sets[j])]
            left.difference_update(near)
            queue += near
        want.add(min(comp))
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == want and len(want) == 21


def test_simhash_of_nothing(none):
    assert simhash.simhash_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_the_near_dedup_stage_against_all_pairs(spark, docs, rows, none):
    import corpus_pipeline

    rnd = random.Random(8)
    more = []
    for i in range(40):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([30, 120, 400]))]
        for k in range(5):  # copies of copies, so that some are alike in steps only
            more.append((1000 + 10 * i + k, " ".join(base), "en", "a"))
            for _ in range(max(1, len(base) // rnd.choice([40, 60, 100]))):
                base[rnd.randrange(len(base))] = f"x{rnd.randint(0, 5000)}"
    every = [*rows, *more]
    sets = []
    for _, t, *_ in every:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    left, want = set(range(len(every))), 0
    while left:
        queue, want = [left.pop()], want + 1
        while queue:
            x = sets[queue.pop()]
            near = [j for j in left if len(x & sets[j]) >= 0.8 * len(x | sets[j])]
            left.difference_update(near)
            queue += near
    kept = corpus_pipeline.near_dedup(spark, docs.union(frame(spark, more)), "")
    assert kept.columns == docs.columns and kept.count() == want
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0
    assert similar.drop_similar(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(50)]
    star = [(100, i) for i in range(101, 160)]
    roots = {r.node: r.root for r in components(spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")).collect()}
    assert len({roots[i] for i in range(51)}) == 1 and len({roots[i] for i in range(100, 160)}) == 1 and roots[0] != roots[100]


def test_near_copies_beside_clashing_columns(spark, docs, rows):
    kept = sorted(map(str, (r.doc_id for r in simhash.drop_near_copies(docs).collect())))
    clash = docs
    for name in ("mark", "mark__", "own", "row", "key", "__key", "set_id", "root"):
        clash = clash.withColumn(name, F.lit("x"))
    got = simhash.drop_near_copies(clash)
    assert got.columns == clash.columns and sorted(str(r.doc_id) for r in got.collect()) == kept


def test_hot_fingerprints_are_joined_apart(docs, monkeypatch):
    expected = sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str)
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 30)
    assert sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str) == expected
