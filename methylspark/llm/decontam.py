"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus and the benchmark are TF-IDF vectors over the words of the
benchmark; words that it lacks count in a passage's length only. A sketched
SVD of all passages, computed from sums over Spark tasks, gives a latent space. Every window of every document
is compared there with the benchmark's items by cosine, and what comes close is checked
word by word: the longest common subsequence with the item, and that with its answer
(the answer column, or the last quarter of the item). A copy holds most of the item; a
paraphrase holds less, but the answer.

A short item fills too little of a window for that. Word-for-word copies of any item are
therefore also found by their words in a row, exactly, and so are near copies of short
items; paraphrases of short items are found by their windows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, staged

#: Bytes of words: ASCII letters and digits and all of non-ASCII; others separate.
TO_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Window lengths in words, and the step from window to window.
LENGTHS, STEP = (16, 24, 32, 48, 64), 8
ITEMS_PER_BLOCK = 4000
#: Items of up to so many words are also found by any two adjacent words, others by their first words.
SHORT, FIRST_WORDS = 11, 4
#: Words of the texts that are searched at once.
STEP_WORDS = 30_000
#: Words of a text that are compared with all items at once; a multiple of ``STEP``.
PIECE_WORDS = 1 << 15
#: Blocks of ``STEP`` words whose latent vectors are gathered, and that windows are added up from, at once; both stay in a core's cache.
GATHER_BLOCKS, WINDOW_BLOCKS = 128, 256
#: Marks of words, a row of them for each candidate, that are set at once.
MARKS = 1 << 20
#: Passages that are multiplied at once when the latent space is fitted, and words of the benchmark whose sums make a row.
STEP_PASSAGES, SUM_WORDS = 32, 64
#: Bytes of the texts that are split and written at once.
BATCH_BYTES = 1 << 22


@dataclass(frozen=True)
class Rule:
    """When a window is looked at, and when it counts."""

    cosine: float = 0.5  # of the latent vectors; known words must also make up its square of a window's squared length, word by word
    copy: float = 0.8  # share of the item's words in the common subsequence
    paraphrase: float = 0.6  # the same, if the answer holds too
    answer: float = 0.75  # share of the answer's words in its common subsequence


def spaced(text: str | None) -> bytes:
    """The words of a text with spaces between them."""
    return (text or "").lower().encode().translate(TO_WORDS).strip()


def words_of(text: str | None) -> list[bytes]:
    return spaced(text).split()


def coded_words(texts: list[bytes | None], names: pa.Array, unknown: int) -> pa.Array:
    """The places among ``names`` of the words of each text, four bytes each; null is a text without words."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    codes = pc.index_in(words.flatten(), value_set=names).fill_null(unknown)
    ends = np.cumsum(4 * pc.list_value_length(words).fill_null(0).to_numpy(), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.r_[np.int32(0), ends]), pa.py_buffer(codes.to_numpy(zero_copy_only=False))])


def subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := at.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def around(size, s, e):
    """First and last word of the part of a text in which an item of ``size`` words is looked for if a window is close to it."""
    pad = np.maximum(size - (e - s), 0) + STEP
    return np.maximum(s - pad, 0), e + pad


def ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each member of the ranges that begin at ``first``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) + (first - np.cumsum(sizes) + sizes)[row]


def _windows(added: dict[int, np.ndarray], n: int, left: np.ndarray) -> np.ndarray:
    """Sums of ``n`` rows in a row from each row on, or as many as are ``left`` from it; from the sums of fewer, all kept in ``added``."""
    if n not in added:
        a = 1 << (n - 1).bit_length() - 1
        head, tail = _windows(added, a, left), _windows(added, n - a, left)
        out = head.copy()
        out[:-a] += tail[a:]
        short = np.flatnonzero(left[: len(out)] <= a)
        out[short] = head[short]
        added[n] = out
    return added[n]


@dataclass
class Index:
    """What tasks need to search for a block of items."""

    ids: list
    items: list[list[bytes]]
    answers: list[list[bytes]]
    rule: Rule
    vocab: dict[bytes, int] = field(default_factory=dict)
    extra: dict[bytes, int] = field(default_factory=dict)  # words of answers that no item has; numbers beyond that of unknown words
    idf: np.ndarray | None = None  # of each word; the last is that of unknown words
    basis: np.ndarray | None = None  # words x rank; the last row is zero
    weighted: np.ndarray | None = None  # the basis times idf
    queries: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)  # window length, items, latent vectors

    item_codes: list[np.ndarray] = field(default_factory=list)
    seeds: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]], np.ndarray]] = field(default_factory=dict)  # words in a row: sorted keys, items and places of each, and the words that one begins with

    def names(self) -> list[bytes]:
        """The words by their numbers; unknown ones have that of the empty word, which no text has."""
        return [*self.vocab, b"", *self.extra]

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(len(self.vocab))), np.int32, len(words))

    def dense(self, passages: list[np.ndarray]) -> np.ndarray:
        """TF-IDF rows over the vocabulary, divided by the length that all words have one by one, unknown ones included."""
        out = np.zeros((len(passages), len(self.vocab)), np.float32)
        for row, c in zip(out, passages):
            x = np.bincount(c, minlength=len(self.vocab) + 1) * self.idf
            row[:] = x[:-1] / max(float(np.sqrt((self.idf[c] ** 2).sum())), 1e-9)
        return out

    def place(self) -> None:
        """Latent vectors of the items, by the window length that holds them; long items in pieces, the last of which ends with the item."""
        self.weighted = np.ascontiguousarray(self.basis * self.idf[:, None])  # rows are gathered
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, words in enumerate(self.items):
            c = self.codes(words)
            for k in [*range(0, max(1, len(c) - LENGTHS[-1] + 1), LENGTHS[-1]), *([len(c) - LENGTHS[-1]] if len(c) > LENGTHS[-1] and len(c) % LENGTHS[-1] else [])]:
                piece = c[k : k + LENGTHS[-1]]
                if len(piece):
                    by.setdefault(next(n for n in LENGTHS if n >= len(piece)), []).append((i, piece))
        for n, pieces in sorted(by.items()):
            q = np.concatenate([self.dense([p for _, p in pieces[k : k + 256]]) @ self.basis[:-1] for k in range(0, len(pieces), 256)])
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
            self.queries.append((n, np.array([i for i, _ in pieces]), q.T.astype(np.float32)))

    def keys(self, codes: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """A number for every ``n`` words in a row, or for those that begin ``at`` places; different words may share one."""
        at = np.arange(max(len(codes) - n + 1, 0)) if at is None else at
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = out * np.uint64(len(self.vocab) + 1) + codes[at + k].astype(np.uint64)
        return out

    def sow(self) -> None:
        """The word sequences that lead to items without the latent space."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        begins: dict[int, np.ndarray] = {}
        self.item_codes = [self.codes(words) for words in self.items]
        for i, words in enumerate(self.items):
            n = min(len(words), 2 if len(words) <= SHORT else FIRST_WORDS)
            places = self.keys(self.item_codes[i], n).tolist()
            for j, key in enumerate(places if len(words) <= SHORT else places[:1]):
                found.setdefault(n, {}).setdefault(key, []).append((i, j))
                begins.setdefault(n, np.zeros(len(self.vocab) + 1, bool))[self.item_codes[i][j]] = True
        self.seeds = {n: (np.array(sorted(x), np.uint64), [x[k] for k in sorted(x)], begins[n]) for n, x in found.items()}

    def seeded(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first and last word of the spans in which a copy may stand, by words in a row."""
        unknown = np.array([len(self.vocab)], np.int32)  # between texts; no item has it
        codes = np.concatenate([x for c in texts for x in (c, unknown)])
        first = np.r_[0, np.cumsum([len(c) + 1 for c in texts])]
        for n, (keys, places, begins) in self.seeds.items():
            starts = np.flatnonzero(begins[codes[: max(len(codes) - n + 1, 0)]])
            own = self.keys(codes, n, starts)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            same = keys[at] == own
            hits = starts[same]
            for p, t, k in zip(hits.tolist(), (np.searchsorted(first, hits, "right") - 1).tolist(), at[same].tolist()):
                for i, j in places[k]:
                    m = len(self.items[i])
                    s, slack = p - int(first[t]) - j, m // 4
                    if m <= SHORT:
                        yield t, i, max(0, s - slack), s + m + slack
                    elif np.array_equal(codes[p : p + m], self.item_codes[i]):
                        yield t, i, s, s + m

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """Text, item, start, end and cosine of each window that is close to an item.

        Long texts are looked at in pieces; each goes on beyond its end by a window, and a window counts where it begins.
        """
        pieces = [(t, at) for t, c in enumerate(texts) for at in range(0, max(len(c), 1), PIECE_WORDS)]
        out, some, size = [], [], 0
        for k, (t, at) in enumerate(pieces):
            some.append((t, at, texts[t][at : at + PIECE_WORDS + LENGTHS[-1]]))
            size += len(some[-1][2])
            if size >= PIECE_WORDS or k == len(pieces) - 1:
                for p, i, s, e, cos in self._near([c for _, _, c in some]):
                    t, at, _ = some[p]
                    if s < PIECE_WORDS or at + PIECE_WORDS >= len(texts[t]):
                        out.append((t, i, s + at, e + at, cos))
                some, size = [], 0
        return out

    def _near(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """Text, item, first and last word, cosine of the windows of the texts that come close."""
        sizes = np.array([-(-len(c) // STEP) for c in texts], np.int64)
        first = np.r_[0, np.cumsum(sizes)]  # block of each text
        n_blocks = int(first[-1])
        codes = np.full(n_blocks * STEP, len(self.vocab), np.int32)
        for c, at in zip(texts, first):
            codes[at * STEP : at * STEP + len(c)] = c
        codes = codes.reshape(n_blocks, STEP)
        owner = np.repeat(np.arange(len(texts)), sizes)
        limit = first[1:][owner]
        weight = self.idf[codes] ** 2
        known = (weight * (codes < len(self.vocab))).sum(axis=1)

        def sums(x: np.ndarray) -> np.ndarray:
            return np.r_[0, np.cumsum(x, dtype=np.float64)]

        norms, known = sums(weight.sum(axis=1)), sums(known)
        windows = []
        start, used = np.arange(n_blocks), np.zeros(n_blocks + 1, np.int64)
        for n, items, q in self.queries:
            end = np.minimum(start + n // STEP, limit)
            norm = norms[end] - norms[:-1]
            # a window of which the benchmark knows too little is close to nothing, whatever its few known words point to
            near = np.flatnonzero(known[end] - known[:-1] >= self.rule.cosine**2 * norm)
            if len(near):
                windows.append((n // STEP, items, q, near, np.sqrt(norm[near])))
                used[near] += 1
                used -= np.bincount(end[near], minlength=n_blocks + 1)
        if not windows:
            return []
        used = np.cumsum(used[:-1]) > 0
        at = np.r_[0, np.cumsum(used)]  # of each block among those in use, where the blocks of a window stay together
        used = np.flatnonzero(used)
        left = at[limit[used]] - np.arange(len(used))  # blocks to the end of the text
        blocks = self._latent(codes[used])
        windows = [(m, items, q, near, norm, np.searchsorted(at[near], np.arange(0, len(used) + WINDOW_BLOCKS, WINDOW_BLOCKS))) for m, items, q, near, norm in windows]
        longest = max(m for m, *_ in windows)
        out = []
        for j, k in enumerate(range(0, len(used), WINDOW_BLOCKS)):
            added = {1: blocks[k : k + WINDOW_BLOCKS + longest - 1]}
            for m, items, q, near, norm, cuts in windows:
                here = slice(cuts[j], cuts[j + 1])
                if here.start == here.stop:
                    continue
                s = near[here]
                own = _windows(added, m, left[k:])[at[s] - k]
                dots = own @ q
                # what the space has no room for is missing in the item's vector, so it must not count in the window's length
                length = np.maximum(np.sqrt(np.einsum("ij,ij->i", own, own)), 1e-3 * norm[here])
                w, i = np.divmod(np.flatnonzero(dots >= self.rule.cosine * length[:, None]), len(items))
                s, t = s[w], owner[s[w]]
                e = np.minimum(s + m, limit[s])
                out += zip(t.tolist(), items[i].tolist(), ((s - first[t]) * STEP).tolist(), ((e - first[t]) * STEP).tolist(), (dots[w, i] / length[w]).tolist())
        return out

    def _latent(self, codes: np.ndarray) -> np.ndarray:
        """Latent vectors of blocks of words; blocks of as many known words go together, so that rows of unknown ones needn't be added."""
        codes = np.sort(codes, axis=1)  # unknown ones last
        sizes = (codes < len(self.vocab)).sum(axis=1)
        order = np.argsort(sizes.astype(np.int8), kind="stable")
        out, row = np.empty((len(codes), self.basis.shape[1]), np.float32), np.empty((GATHER_BLOCKS, self.basis.shape[1]), np.float32)
        for k in range(0, len(codes), GATHER_BLOCKS):
            some = order[k : k + GATHER_BLOCKS]
            c = codes[some].T.copy()
            part = self.weighted.take(c[0], axis=0, mode="clip")  # no code is too large
            for w in c[1 : sizes[some[-1]]]:
                part += self.weighted.take(w, axis=0, out=row[: len(w)], mode="clip")
            out[some] = part
        return out

    def leaks(self, texts: list[list[bytes]]) -> list[list[tuple[int, float, float, float, str]]]:
        """For each text: item, cosine, shares of item and answer, and kind, for each item that it holds."""
        return self.held([self.codes(w) for w in texts], texts.__getitem__)

    def held(self, codes: list[np.ndarray], words: Callable[[int], list[bytes]]) -> list[list[tuple[int, float, float, float, str]]]:
        """``leaks`` of texts whose codes are known; their words are asked for where something may be."""
        near: list[dict[int, list[tuple[int, int, float]]]] = [{} for _ in codes]
        found = self.candidates(codes)
        if found and self.item_codes:  # what holds too few of the item's words is left out before words are asked for
            found = compress(found, self._shared(codes, found) >= self.rule.paraphrase)
        for t, i, s, e, cos in found:
            near[t].setdefault(i, []).append((s, e, cos))
        out = [{i: x for i, *x in self._checked(words(t), n)} if n else {} for t, n in enumerate(near)]
        for t, i, s, e in self.seeded(codes) if self.seeds else ():
            if i in out[t] and out[t][i][3] == "copy":
                continue
            item, text = self.items[i], words(t)[s:e]
            there = set(text)
            if sum(map(there.__contains__, item)) < self.rule.copy * len(item):
                continue
            share = subsequence(item, text) / len(item)
            if share >= self.rule.copy:
                held = subsequence(self.answers[i], text) / max(len(self.answers[i]), 1)
                a, b = self.weighted[self.item_codes[i]].sum(axis=0), self.weighted[codes[t][s:e]].sum(axis=0)
                cos = float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-9)
                out[t][i] = [cos, share, held, "copy"]
        return [[(i, *x) for i, x in sorted(found.items())] for found in out]

    def _shared(self, texts: list[np.ndarray], found: list[tuple[int, int, int, int, float]]) -> np.ndarray:
        """For each candidate, the share of the item's words that stand around the window."""
        sizes, lengths = np.array([len(c) for c in self.item_codes]), np.array([len(c) for c in texts])
        items, codes = np.concatenate(self.item_codes), np.concatenate(texts)
        t, i, s, e = np.array([x[:4] for x in found]).T
        a, b = around(sizes[i], s, e)
        b, text, item = np.minimum(b, lengths[t]), (np.cumsum(lengths) - lengths)[t], (np.cumsum(sizes) - sizes)[i]
        out, width = [], len(self.vocab) + 1
        some = max(1, MARKS // width)
        for k in range(0, len(t), some):
            own = slice(k, k + some)
            there = np.zeros(some * width, bool)
            row, at = ranges(text[own] + a[own], b[own] - a[own])
            there[row * width + codes[at]] = True
            row, at = ranges(item[own], sizes[i[own]])
            out.append(np.bincount(row, there[row * width + items[at]]))  # no item is empty
        return np.concatenate(out) / sizes[i]

    def _checked(self, words: list[bytes], near: dict[int, list[tuple[int, int, float]]]) -> list[tuple[int, float, float, float, str]]:
        best: dict[int, tuple[float, float, float, str]] = {}
        for i, windows in near.items():
            item, answer = self.items[i], self.answers[i]
            for s, e, cos in sorted(windows, key=lambda x: -x[2]):
                if i in best and best[i][3] == "copy":
                    break
                text = words[slice(*around(len(item), s, e))]
                there = set(text)
                if sum(map(there.__contains__, item)) / len(item) < self.rule.paraphrase:  # the subsequence can't be longer
                    continue
                share = subsequence(item, text) / len(item)
                if share < self.rule.paraphrase:
                    continue
                held = subsequence(answer, text) / max(len(answer), 1)
                kind = "copy" if share >= self.rule.copy else "paraphrase" if held >= self.rule.answer else None
                if kind and (i not in best or share > best[i][1]):
                    best[i] = (cos, share, held, kind)
        return [(i, *x) for i, x in sorted(best.items())]


def _coded(docs: DataFrame, index: Index) -> DataFrame:
    """The id of each document and the codes of all its words, four bytes each; written once for all passes."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([w.decode() for w in shared.value.names()])
        for batch in batches:
            some, size, first = [], 0, 0
            for k, text in enumerate(batch.column("text")):
                some.append(spaced(text.as_py()) or None)
                size += len(some[-1] or b"")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(some)), coded_words(some, names, len(shared.value.vocab))], ["doc_id", "codes"])
                    some, size, first = [], 0, k + 1

    return staged(docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("codes", T.BinaryType())])), "coded")


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(c.as_buffer(), np.int32) for c in batch.column("codes"))


def _sums(coded: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of the ``n`` words of the vocabulary stands, the number of documents and that of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n + 2, np.int64)
        for batch in batches:
            for codes in _texts(batch):
                there = np.zeros(n + 1, bool)
                there[np.minimum(codes, n)] = True
                there[n] = True  # the document itself
                df[:-1] += there
                df[-1] += -(-len(codes) // LENGTHS[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 2)), pa.array(df)], ["word", "df"])

    rows = coded.select("codes").mapInArrow(run, "word long, df long").filter("df > 0").groupBy("word").agg(F.sum("df").alias("df")).collect()  # as many as words of the benchmark
    df = np.zeros(n + 2)
    for r in rows:
        df[r.word] = r.df
    return df


def _gram(coded: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'A x over all passages of all documents, added up by tasks."""
    v, k = x.shape
    shared = coded.sparkSession.sparkContext.broadcast((idf, (x * idf[:-1, None]).astype(np.float32)))
    names = ["at", "data"]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = shared.value
        total = np.zeros((v, k))

        def add(passages: list[np.ndarray]) -> None:
            codes = np.minimum(np.concatenate(passages), v)
            owner = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
            norm = np.bincount(owner, idf[codes] ** 2)  # squared, of all words one by one
            known = codes < v
            there, code = np.unique(codes[known], return_inverse=True)
            a = np.bincount(owner[known] * len(there) + code, minlength=len(passages) * len(there)).reshape(len(passages), -1).astype(np.float32)
            if len(there):
                total[there] += a.T @ (a @ x[there] / np.maximum(norm, 1e-18)[:, None].astype(np.float32))

        some = []
        for batch in batches:
            for codes in _texts(batch):
                for s in range(0, len(codes), LENGTHS[-1]):
                    some.append(codes[s : s + LENGTHS[-1]])
                    if len(some) == STEP_PASSAGES:
                        add(some)
                        some = []
        if some:
            add(some)
        total *= idf[:-1, None]
        yield pa.RecordBatch.from_arrays([pa.array(range(0, v, SUM_WORDS), pa.int64()), pa.array([total[i : i + SUM_WORDS].tobytes() for i in range(0, v, SUM_WORDS)], pa.binary())], names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data")):
                part = np.frombuffer(data.as_buffer())
                sums[at] = sums[at] + part if at in sums else part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names)

    schema = "at long, data binary"
    out = np.zeros((v, k))
    found = coded.select("codes").mapInArrow(product, schema).repartition("at").mapInArrow(added, schema)
    for r in gathered(found, "passage-sums"):  # words x rank numbers, whatever the number of tasks
        part = np.frombuffer(r.data).reshape(-1, k)
        out[r.at : r.at + len(part)] = part
    return out


def _fit(coded: DataFrame, index: Index, n_passages: float, rank: int, seed: int) -> None:
    """The latent space: the largest eigenvectors of the sum A'A of all passages, by Nystroem's method in one pass.

    It is fitted on all passages of all documents, cut without overlap, and on the items,
    which weigh as much as those together. The pass is begun in the items' own space (random
    columns after two power iterations on the items), as that is where windows are compared.
    """
    items = [index.codes(w) for w in index.items]
    weight = max(n_passages, 1) / len(items)

    def of_items(x: np.ndarray) -> np.ndarray:
        parts = (index.dense(items[k : k + 256]).astype(np.float64) for k in range(0, len(items), 256))
        return sum(a.T @ (a @ x) for a in parts)

    k = min(rank + 16, len(index.vocab))
    noise = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(index.vocab), k)))[0]
    q = noise
    for _ in range(2):
        q = np.linalg.qr(of_items(q) + 1e-6 * noise)[0]  # items of fewer dimensions leave the rest to chance
    y = _gram(coded, index.idf, q) + weight * of_items(q)
    # A'A is taken as y (q'y)^-1 y', which is exact if q spans the space
    values, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    kept = values > 1e-7 * values[-1]
    half = y @ (vectors[:, kept] / np.sqrt(values[kept]))
    top = np.linalg.svd(half, full_matrices=False)[0][:, :rank]
    index.basis = np.r_[top, np.zeros((1, top.shape[1]))].astype(np.float32)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    rule: Rule = Rule(),
    rank: int = 192,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, item_id, cosine, item_share, answer_share, kind``, a row for each document and item that it holds.

    Documents that hold none have no row; rows that repeat a document have rows each.
    Null and empty texts and items hold nothing. Of an item's places in a document the one of the largest
    share is told, items that repeat id and text count once, those that share an id are told by it each.
    Texts are searched whole, however long, in windows. The benchmark is a stated set of
    queries; it is searched for in blocks of about ``ITEMS_PER_BLOCK`` items, every
    block in all windows of all documents. Other columns are ignored, whatever their
    names. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    asked = asked.filter(F.col("item").isNotNull()).dropDuplicates()
    blocks = -(-asked.count() // ITEMS_PER_BLOCK)
    out = None
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", asked.schema["item_id"].dataType), *T._parse_datatype_string("cosine double, item_share double, answer_share double, kind string").fields])
    for b in range(blocks):
        items = [(r.item_id, words_of(r.item), words_of(r.answer)) for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]  # one block
        items = sorted([x for x in items if x[1]], key=lambda x: (str(x[0]), x[1]))
        if not items:
            continue
        index = Index([i for i, _, _ in items], [w for _, w, _ in items], [a or w[-max(1, len(w) // 4) :] for _, w, a in items], rule)
        index.vocab = {w: i for i, w in enumerate(sorted({w for ws in index.items for w in ws}))}
        index.extra = {w: len(index.vocab) + 1 + i for i, w in enumerate(sorted({w for a in index.answers for w in a} - index.vocab.keys()))}
        coded = _coded(rows, index)
        *df, n, n_passages = _sums(coded, len(index.vocab))
        idf = np.log((1 + n) / (1 + np.array(df))) + 0.1
        # an unknown word weighs as much as a word of the items does on average
        mean = np.concatenate([idf[index.codes(w)] for w in index.items]).mean()
        index.idf = np.r_[idf, mean].astype(np.float32)
        _fit(coded, index, n_passages, rank, seed)
        index.place()
        index.sow()
        found = _search(coded, index, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _search(coded: DataFrame, index: Index, schema: T.StructType) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        unknown = len(index.vocab)
        names = index.names()
        for batch in batches:
            at, out, step, size = [], [], [], 0
            for k, codes in enumerate(_texts(batch)):
                step.append(codes)
                size += len(codes)
                if size >= STEP_WORDS or k == batch.num_rows - 1:
                    first = k - len(step) + 1
                    words = cache(lambda t, step=step: [names[c] for c in step[t].tolist()])
                    for t, found in enumerate(index.held([np.minimum(c, unknown) for c in step], words)):
                        at += [first + t] * len(found)
                        out += [(index.ids[i], *x) for i, *x in found]
                    step, size = [], 0
            if at:
                types = [batch.schema.field("doc_id").type, None, pa.float64(), pa.float64(), pa.float64(), pa.string()]
                columns = [pa.array(x, t) for x, t in zip(zip(*out), types[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *columns], schema.names)

    return coded.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark.

    Rows that repeat id and text have one fate; other columns are kept as they are.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"))
    rows = docs.withColumn("__key", key)
    leaks = staged(find_leaks(rows, benchmark, text_col, "__key", **options).select(F.col("doc_id").alias("__key")).distinct(), "leaks")
    return rows.join(leaks, "__key", "left_anti").drop("__key")
