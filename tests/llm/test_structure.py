"""MinHash, conversation repair and the Merkle manifest, each against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import frame
from methylspark.llm import common, conversations, merkle, minhash, similar, stars


# MinHash


def plain_set(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {" ".join(words)}


def plain_components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_minhash(rows):
    sets = [plain_set(t) for _, t, *_ in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    groups = plain_components(range(len(rows)), links)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in groups if groups[j] == groups[i] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def near(rnd, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(rows):
    rnd = random.Random(11)
    out = list(rows)
    for k in range(8):
        base = " ".join(f"v{rnd.randrange(10**5)}" for _ in range(150))
        out += [(1000 + 20 * k + i, near(rnd, base, i // 3), "en", "a") for i in range(12)]
    base = " ".join(f"v{rnd.randrange(10**5)}" for _ in range(120))
    for i in range(40):  # a chain: neighbours are alike, its ends are not
        base = near(rnd, base, 1)
        out.append((2000 + i, base, "en", "a"))
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_minhash_groups(spark, copies):
    assert as_rows(minhash.minhash_groups(frame(spark, copies))) == plain_minhash(copies)


def test_minhash_groups_of_large_keys(spark, copies, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 50)
    assert as_rows(minhash.minhash_groups(frame(spark, copies))) == plain_minhash(copies)


def test_minhash_groups_of_nothing_and_of_clashing_columns(spark, none, copies):
    assert minhash.minhash_groups(none).count() == 0
    few = copies[:40]
    docs = frame(spark, few)
    for name in ("mark", "__mark", "set_id", "root", "key", "size", "node", "least"):
        docs = docs.withColumn(name, F.lit(1))
    assert as_rows(minhash.minhash_groups(docs)) == plain_minhash(few)


def test_shingle_set_by_pieces(monkeypatch):
    rnd = random.Random(2)
    for n_words in (0, 1, 4, 5, 6, 63, 64, 65, 300):
        data = (" \t\n".join(rnd.choice("abcdefgh") for _ in range(n_words)) + "\x0b ").encode()
        whole = minhash.shingle_set(data, 5)
        for piece in (1, 3, 64):
            monkeypatch.setattr(minhash, "PIECE", piece)
            assert np.array_equal(minhash.shingle_set(data, 5), whole)
        monkeypatch.setattr(minhash, "PIECE", 1 << 16)
        assert len(whole) == len(plain_set(data.decode()))
    assert np.array_equal(minhash.shingle_set("Ü A\u0085b C".encode(), 5), minhash.shingle_set("Ü a\u0085b c".encode(), 5))


def test_signature_agreement_estimates_similarity():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 2000, np.uint64)
    a, b = minhash.minima(x[:1500]), minhash.minima(x[500:])
    assert abs((a == b).mean() - 0.5) < 0.15 and (minhash.minima(x) == minhash.minima(x[::-1].copy())).all()
    assert minhash.least_agreement(0.85) == 75  # of 120; a pair at 0.85 has fewer in 4 of 10^10 cases


def test_star_components(spark, monkeypatch):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)]
    links += [(1000, 1001 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(60)]  # hubs of small and of large ids
    links += [(3000 + i, 3001 + i) for i in range(50)] + [(5, 5), (7, 7), links[0], links[0][::-1]]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    expected = plain_components(nodes, [p for p in links if p[0] != p[1]])
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    for share in (common.HOT_SHARE, 1 / 10):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert {r.node: r.root for r in stars.star_components(df).collect()} == expected
    assert stars.star_components(df.limit(0)).count() == 0


# conversations


def plain_edits(turns):
    """The least (cost, letters) by a table of whole strings, of any number of insertions."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(4):
            for s, (c, x) in list(best.items()):
                t = "a" if s == "u" else "u"
                best[t] = min(best.get(t, (10**9, "")), (c + 5, x + "I"))
        return best

    for initial, fault in turns:
        found = {}
        for s, (c, x) in inserted(dict(best)).items():
            options = [(s, "D", 2)]
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                options += [("a", "R", 1 + more)] if s == "u" else [("u", "R", 1 + more)]
                if initial in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[s]:
                    options.append((initial, "K", more))
            for t, letter, price in options:
                found[t] = min(found.get(t, (10**9, "")), (c + price, x + letter))
        best = found
    return min(v for s, v in inserted(best).items() if s in ("", "a"))


def search(turns):
    s = conversations.Search()
    for t in turns:
        s.add(*t)
    return s.finish().decode()


def price(turns, letters):
    turns = iter(turns)
    return sum(5 if x == "I" else {"K": 0, "R": 1, "D": 2}[x] + 5 * (next(turns)[1] == 3 and x != "D") for x in letters)


def test_search_against_whole_strings():
    rnd = random.Random(4)
    for n in [*range(9)] * 150 + [60, 200] * 10:
        odds = rnd.choice([(8, 1, 1, 1), (3, 1, 1, 3), (1, 3, 3, 3)])
        turns = [(rnd.choice(["s", "u", "a", "", "u", "a"]), rnd.choices(range(4), odds)[0]) for _ in range(n)]
        letters = search(turns)
        assert (price(turns, letters), letters) == plain_edits(turns), turns
    for turns in ([("u", 0)] * 301, [("u", 0)] * 300, [("s", 0)] * 50, [("u", 1)] * 40, [("a", 0), ("u", 0)] * 60, [("u", 3), ("a", 3)] * 20):
        assert search(turns) == plain_edits(turns)[1]


def test_search_against_every_sequence_of_edits():
    def every(turns, state, left):
        if not turns and state in ("", "a"):
            yield 0, ""
        if left:
            t = "a" if state == "u" else "u"
            yield from ((c + 5, "I" + x) for c, x in every(turns, t, left - 1))
        if turns:
            (initial, fault), rest = turns[0], turns[1:]
            yield from ((c + 2, "D" + x) for c, x in every(rest, state, left))
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                yield from ((c + 1 + more, "R" + x) for c, x in every(rest, "a" if state == "u" else "u", left))
                if conversations.follow(state, initial):
                    yield from ((c + more, "K" + x) for c, x in every(rest, initial, left))

    rnd = random.Random(6)
    for _ in range(120):
        turns = [(rnd.choice(["s", "u", "a", ""]), rnd.choice([0, 0, 0, 1, 3])) for _ in range(rnd.randint(0, 5))]
        assert search(turns) == min(every(turns, "", 3))[1], turns


def test_search_emits_as_it_goes_and_holds_letters_only():
    s = conversations.Search()
    for i in range(4000):
        s.add("ua"[i % 2], 0 if i % 7 else 3)
        assert i - len(s.edits) < 60
    s = conversations.Search()  # nothing can be resolved before the end: two strings of letters, not a node for each turn
    for _ in range(4000):
        s.add("u", 0)

    def count(node):
        return 1 + sum(map(count, node.children))

    assert count(s.root) <= 8
    assert len(s.finish()) == 4000


def plain_audit(rows, damage=True):
    """From ``(conv, turn, role, text)`` rows to the audit of each conversation."""
    out, groups = {}, {}
    for c, t, r, x in rows:
        groups.setdefault(c, [])
        show = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20 if damage else 9
        r, x = show(r), show(x)
        if k:
            row = (t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            groups[c] += [row, row] if k == 3 else [row]
    for c, turns in groups.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        faults, seen = [], set()
        for _, r, x in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", x)[-1:]
            faults.append(1 if not last else 2 if (r, x) in seen else 3 if last[0] not in ".!?" else 0)
            seen.add((r, x))
        cost, letters = plain_edits([(r[:1] if r[:1] in ("s", "u", "a") else "", f) for (_, r, _), f in zip(turns, faults)])
        lines, state, rest = [], "", iter(turns)
        for e in letters:
            _, r, x = (None, None, "") if e == "I" else next(rest)
            if e != "D":
                state = r[:1] if e == "K" else "a" if state == "u" else "u"
                lines.append(f"{r if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{x}")
        known = [t for t, *_ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def turns_of(rnd, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "Hm", "", " \n", None, "Why? \t\n", "long " * 3000 + ".", "É\u0085", "a "]
    out = []
    for c in [*range(n), None]:
        for t in range(rnd.randint(1, 9)):
            out.append((c, rnd.choice([t, t, t, None, t + 2]), rnd.choice(roles[: rnd.choice([2, 3, 6])]), rnd.choice(texts) if rnd.random() < 0.6 else f"text {rnd.random()}."))
    return out + out[:5] + [(n, 3, "user", "one" * 200_000)] + [(n + 1, i, "user", "Same.") for i in range(300)]


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("damage", [True, False])
def test_audits_against_a_plain_version(spark, damage, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 50)
    rows = turns_of(random.Random(8), 60)
    df = spark.createDataFrame(rows, CONV).repartition(5)
    for name in ("conv", "phase", "digest", "later", "fault", "__k", "copy", "n", "first"):
        df = df.withColumn(name, F.lit(1))
    got = conversations.audit_conversations(conversations.damage(df) if damage else df, df).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_audit(rows, damage)


def test_repaired_rows_are_legal_and_whole(spark):
    rows = turns_of(random.Random(9), 20)
    found = {}
    for r in conversations.repair(spark.createDataFrame(rows, CONV)).collect():
        found.setdefault(r.conv_id, []).append(r)
    for c, edits in found.items():
        edits.sort(key=lambda r: r.place)
        assert [r.place for r in edits] == list(range(len(edits)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in edits if r.edit != "D"))
        own = sorted(((r.turn, r.was, r.text) for r in edits if r.edit != "I"), key=str)
        assert own == sorted(((t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c), key=str)
    nothing = spark.createDataFrame([], CONV)
    assert conversations.audit_conversations(nothing, nothing).count() == 0


# Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root, and for each leaf the (lower, higher) siblings level by level."""
    paths, at, row = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(row) > 1:
        for path, i in zip(paths, at):
            start = i - i % 3
            path.append((row[start:i], row[i + 1 : start + 3]))
        at, row = [i // 3 for i in at], [h(*row[i : i + 3]) for i in range(0, len(row), 3)]
    return row[0], paths


def plain_leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain_manifest(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text)))
        trees.append((own, *plain_tree([plain_leaf(r, r.text) for r in own])))
    root, above = plain_tree([sub for _, sub, _ in trees])
    for (own, sub, paths), upper in zip(trees, above):
        for r, path in zip(own, paths):
            path, x = path + upper, plain_leaf(r, tampered(r))
            for low, high in path:
                x = h(*low, x, *high)
            proof = h(*itertools.chain(*(low + high for low, high in path)))
            out.append((r.doc_id, plain_leaf(r, r.text), sub, root, proof, x, x == root))
    return sorted(out, key=str)


def tampered_text(r):
    return r.text if r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2 else r.text.replace("\n", "")


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, rows, height):
    rnd = random.Random(height)
    more = [(500 + i, rnd.choice(["a\nb", "c\n", "d", None, ""]), "en", rnd.choice(["a", "a", "a", "z", "é", "Z", "", None])) for i in range(90)]
    more += [(900 + i, "x", "en", f"only{i}") for i in range(13)]
    docs = frame(spark, rows + more).withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    for name in ("tree", "block", "idx", "size", "leaf", "path", "shape", "root", "subroot", "head", "row"):
        docs = docs.withColumn(name, F.lit("x"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), height).collect()
    expected = plain_manifest(docs.collect(), tampered_text)
    assert sorted(map(tuple, got), key=str) == expected
    assert {True, False} == {r.verified for r in got}


def test_manifest_of_one_row_and_of_none(spark, none):
    one = frame(spark, [(1, "a\n", "en", "s")])
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == hashlib.sha256().hexdigest()
    assert merkle.manifest(none).count() == 0


def test_addresses_are_a_van_emde_boas_order():
    for levels in range(1, 9):
        at = merkle.places(levels)
        assert sorted(np.concatenate(at)) == list(range(merkle.tree_size(levels)))
        top = levels // 2
        if top:
            size, below = merkle.tree_size(top), merkle.tree_size(levels - top)
            assert all((at[d] < size).all() and (at[d] == merkle.places(top)[d]).all() for d in range(top))
            for k in range(3**top):  # every subtree is one stretch, laid out in the same way
                for d in range(top, levels):
                    own = at[d].reshape(3**top, -1)[k]
                    assert (own - size - k * below == merkle.places(levels - top)[d - top]).all()
