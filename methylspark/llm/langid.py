"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed character n-grams (n = 1, 2, 3 of the lower-cased text, with
punctuation, digits and white space as one space), weighted by ln(1 + count) and inverse
document frequency and scaled to length 1. For each language the vectors of its texts are
clustered by cosine (spherical k-means, each round a pass of sums over Spark tasks); a text has the language of the centroid of
highest cosine. It is rejected if it is farther from that centroid than texts of its
length and language are, by a factor; that distance is measured on texts that the
centroids were not fitted to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import gathered, staged, unstage

DIM = 1 << 14
LETTER = regex.compile(r"\p{L}")
OTHERS = re.compile(r"[\W\d_]+")
#: Characters that one step works on, and documents.
STEP_CHARS, STEP_DOCS = 1 << 19, 64
#: Length classes of rejection: class k holds texts of 2^k to below 2^(k + 1) characters, the last also longer ones.
CLASSES = 10
#: Languages that a model learns: those of most rows. Each adds to the model, and a column of more values holds other things too.
MAX_LANGUAGES = 1000
#: Steps in which cosines are counted, and parts of 1 that components are rounded to where they are summed, so that sums don't depend on their order.
BINS, ONE = 1 << 14, float(1 << 24)
#: Parts that the hashes of a language's texts are dealt into to find every fifth.
PARTS = 4096
#: Texts that are summed at once, and centroids that a task sums before it hands them on.
STEP_ROWS, STEP_SUMS = 512, 256
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ points[i : len(points) - n + 1 + i]) * MIX[i]
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x165667B1)) >> np.uint32(18)


def _tally(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text; the texts of a step are short together."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    out = np.zeros(len(texts) * DIM, np.float32)
    for n in (1, 2, 3):
        if len(points) >= n:
            at = owner[: len(points) - n + 1]
            whole = at == owner[n - 1 :]  # n-grams end where their text ends
            out += np.bincount(at[whole] * DIM + _hashes(points, n)[whole], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIM)


def plain(text: str) -> str:
    return OTHERS.sub(" ", text.lower()).strip()


def length_class(texts: list[str]) -> np.ndarray:
    return np.array([min(max(len(t), 1).bit_length() - 1, CLASSES - 1) for t in texts], int)


def counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams of whole ``plain`` texts; very long ones are counted in overlapping pieces."""
    out = np.zeros((len(texts), DIM), np.float32)
    part, rows, size = [], [], 0

    def flush():
        nonlocal part, rows, size
        if part:
            out[rows] = _tally(part)
        part, rows, size = [], [], 0

    for i, text in enumerate(texts):
        text = f" {text} "
        if len(text) <= STEP_CHARS:
            if size + len(text) > STEP_CHARS:
                flush()
            part.append(text)
            rows.append(i)
            size += len(text)
        else:
            flush()
            for k in range(0, len(text), STEP_CHARS):
                out[i] += _tally([text[k : k + STEP_CHARS]])[0]
                for n in (2, 3):  # n-grams over the seam
                    seam = text[max(0, k - n + 1) : k + n - 1]
                    points = np.frombuffer(seam.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
                    if k and len(points) >= n:
                        out[i] += np.bincount(_hashes(points, n), minlength=DIM)
    flush()
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = counts(texts)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def _tallies(rows: DataFrame) -> DataFrame:
    """Language, use, and the n-grams of each whole text with their counts; of texts that are ``kept`` also the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(s, STEP_ROWS)
                texts, cells, n = [plain(t) for t in part.column("text").to_pylist()], [], []
                for k in range(0, len(texts), STEP_DOCS):
                    for x in counts(texts[k : k + STEP_DOCS]):
                        there = np.flatnonzero(x)
                        cells.append(there.astype("<u2").tobytes())
                        n.append(x[there].astype("u1" if x.max() < 256 else "<f4").tobytes())
                longest = 1 << CLASSES - 1
                middles = [t[max(0, (len(t) - longest) // 2) :][:longest] if kept else None for t, kept in zip(texts, part.column("kept").to_pylist())]
                columns = [part.column(c) for c in ("lang", "kept", "fitted")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.binary()), pa.array(n, pa.binary()), pa.array(middles, pa.string())], [*schema.names])

    schema = T._parse_datatype_string("lang string, kept boolean, fitted boolean, cells binary, n binary, middle string")
    return staged(rows.select("lang", "kept", "fitted", "text").mapInArrow(run, schema), "language-tallies")


def _cells(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), "<u2") for c in column]


def _by_language(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of one language: the places and components of their vectors one after another, and where each begins."""
    for batch in batches:
        for s in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(s, STEP_ROWS)
            cells, n = _cells(part.column("cells")), part.column("n")
            of: dict[str, list[int]] = {}
            for r, lang in enumerate(part.column("lang").to_pylist()):
                of.setdefault(lang, []).append(r)
            for lang, own in of.items():
                lengths = np.array([len(cells[r]) for r in own])
                at = np.concatenate([cells[r] for r in own]).astype(np.int64)
                count = np.concatenate([np.frombuffer(n[r].as_buffer(), "u1" if len(n[r].as_buffer()) == len(cells[r]) else "<f4") for r in own])
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
                x = np.log1p(count, dtype=np.float32).astype(float) * idf[at]
                x /= np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), lengths)
                yield lang, at, x, starts


def _cosines(c: np.ndarray, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(own[at] * x, starts) for own in c], axis=1)


def _sums(tallies: DataFrame, idf: np.ndarray, state: dict[str, tuple[np.ndarray, np.ndarray | None]]) -> dict[tuple[str, int], tuple[int, np.ndarray]]:
    """Numbers and sums of the vectors of each language and cluster.

    ``state`` holds centroids, of which each text goes to the nearest, or one centroid and
    the cosines (in ``BINS``) where the next cluster begins; without any all go to cluster 0.
    """
    shared = tallies.sparkSession.sparkContext.broadcast((idf, state))
    schema = "lang string, cluster int, rows long, cells binary, sums binary"
    names = ["lang", "cluster", "rows", "cells", "sums"]

    def batch_of(sums: dict[tuple[str, int], list]) -> pa.RecordBatch:
        there = [np.flatnonzero(x) for _, x in sums.values()]
        columns = [[k for k, _ in sums], [j for _, j in sums], [n for n, _ in sums.values()], [t.astype("<u2").tobytes() for t in there], [x[t].tobytes() for t, (_, x) in zip(there, sums.values())]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, state = shared.value
        sums: dict[tuple[str, int], list] = {}
        for lang, at, x, starts in _by_language(batches, idf):
            own = np.zeros(len(starts), int)
            if lang in state:
                c, edges = state[lang]
                cos = _cosines(c, at, x, starts)
                own = cos.argmax(axis=1) if edges is None else np.searchsorted(edges, np.floor(cos[:, 0] * BINS))
            lengths = np.diff(np.r_[starts, len(at)])
            total = np.bincount(np.repeat(own, lengths) * DIM + at, np.rint(x * ONE), (own.max() + 1) * DIM).reshape(-1, DIM)
            for j, n in enumerate(np.bincount(own)):
                if n:
                    entry = sums.setdefault((lang, j), [0, np.zeros(DIM)])
                    entry[0] += int(n)
                    entry[1] += total[j]
            if len(sums) > STEP_SUMS:
                yield batch_of(sums)
                sums = {}
        if sums:
            yield batch_of(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for lang, j, n, cells, part in zip(*(batch.column(c).to_pylist() for c in names)):
                entry = sums.setdefault((lang, j), [0, np.zeros(DIM)])
                entry[0] += n
                entry[1][np.frombuffer(cells, "<u2")] += np.frombuffer(part)
        if sums:
            yield batch_of(sums)

    out = {}
    found = tallies.filter("fitted").select("lang", "cells", "n").mapInArrow(summed, schema).repartition("lang", "cluster").mapInArrow(added, schema)
    for r in gathered(found, "language-sums"):  # a few rows a language
        x = np.zeros(DIM)
        x[np.frombuffer(r.cells, "<u2")] = np.frombuffer(r.sums)
        out[r.lang, r.cluster] = (r.rows, x / max(float(np.linalg.norm(x)), 1e-12))
    return out


def _quantiles(counted: DataFrame, by: list[str]) -> DataFrame:
    """``counted`` (a row for each bin, its number of rows in ``n``) with the rows up to each bin and in all."""
    bins = counted.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def _clusters(tallies: DataFrame, idf: np.ndarray, k: int, rounds: int = 10, least: float = 0.02) -> dict[str, np.ndarray]:
    """For each language at most ``k`` centroids of unit length by spherical k-means of all its texts.

    Starts at the means of ``k`` parts of as many texts, by their cosine with the mean of all. A centroid of less than
    the share ``least`` of the texts stands for an outlier and is left out.
    """
    means = {lang: (x[None], None) for (lang, _), (_, x) in _sums(tallies, idf, {}).items()}
    if not means:
        return {}
    shared = tallies.sparkSession.sparkContext.broadcast((idf, means))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, means = shared.value
        for lang, *x in _by_language(batches, idf):
            bins, n = np.unique(np.floor(_cosines(means[lang][0], *x)[:, 0] * BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins), pa.array(n)], ["lang", "bin", "n"])

    counted = _quantiles(tallies.filter("fitted").select("lang", "cells", "n").mapInArrow(spread, "lang string, bin long, n long"), ["lang"])
    edges = counted.groupBy("lang").agg(F.array(*[F.min(F.when(F.col("upto") * k >= F.col("total") * j, F.col("bin"))) for j in range(1, k)]).alias("edges")).collect()  # a row a language
    found = _sums(tallies, idf, {r.lang: (means[r.lang][0], np.array(r.edges, float)) for r in edges})
    state = {lang: np.stack([found[x][1] for x in sorted(found) if x[0] == lang]) for lang in means}
    for r in range(rounds + 1):
        found = _sums(tallies, idf, {lang: (c, None) for lang, c in state.items()})
        sizes = {lang: np.array([found.get((lang, j), (0,))[0] for j in range(len(c))]) for lang, c in state.items()}
        new = {lang: np.stack([found[lang, j][1] if (lang, j) in found else c[j] for j in range(len(c))]) for lang, c in state.items()}
        if r == rounds or all((new[lang] == c).all() for lang, c in state.items()):
            break
        state = new
    return {lang: c[sizes[lang] >= min(least * sizes[lang].sum(), sizes[lang].max())] for lang, c in state.items()}


def _floors(tallies: DataFrame, centroids: dict[str, np.ndarray], idf: np.ndarray, slack: float) -> dict[str, np.ndarray]:
    """For each language and length class, ``slack`` times the cosine that 99 of 100 pieces of such a length reach.

    A piece of each length is cut from the middle of every kept text that has one. Classes that fewer than 20
    texts reach have the floor of the one before; without any the floor is 0.
    """
    shared = tallies.sparkSession.sparkContext.broadcast((idf, {lang: c.astype(np.float32) for lang, c in centroids.items()}))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = shared.value
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("middle").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for k in range(CLASSES):
                    pieces = [t[(len(t) - (1 << k)) // 2 :][: 1 << k] for t in own if len(t) >= 1 << k]
                    for s in range(0, len(pieces), STEP_DOCS):
                        cos = (vectors(pieces[s : s + STEP_DOCS], idf) @ centroids[lang].T).max(axis=1)
                        bins, n = np.unique(np.floor(cos * BINS).astype(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array([k] * len(bins), pa.int32()), pa.array(bins), pa.array(n)], ["lang", "length", "bin", "n"])

    kept = tallies.filter("kept").select("lang", "middle").mapInArrow(reached, "lang string, length int, bin long, n long")
    found = _quantiles(kept, ["lang", "length"]).filter("total >= 20 AND upto > floor(total / 100)").groupBy("lang", "length").agg(F.min("bin").alias("bin"))
    out = {lang: np.full(CLASSES, np.nan) for lang in centroids}
    for r in found.collect():  # at most a row for each language and class
        out[r.lang][r.length] = slack * r.bin / BINS
    for floors in out.values():
        last = 0.0
        for k in range(CLASSES):
            last = floors[k] = last if np.isnan(floors[k]) else floors[k]
    return out


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # of each centroid and length class; a text of lower cosine is rejected
    idf: np.ndarray
    left_out: int = 0  # languages that were not learnt

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections; ``und`` and 0 without a letter or a model.

        Without a model nothing that has a letter is rejected.
        """
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        rejected = np.ones(len(texts), bool)
        if not self.langs:
            rejected[rows] = False
            return langs, scores, rejected
        for s in range(0, len(rows), STEP_DOCS):
            step = rows[s : s + STEP_DOCS]
            words = [plain(texts[i]) for i in step]
            cos = vectors(words, self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            for i, b, v, k in zip(step, best, cos.max(axis=1), length_class(words)):
                langs[i], scores[i], rejected[i] = self.langs[b], min(max(float(v), 0.0), 1.0), v < self.floors[b, k]
        return langs, scores, rejected


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int | None = None, centroids: int = 4, slack: float = 0.6
) -> Model:
    """Fit on all texts of each language.

    Rows without a language or a letter are not used; repeated rows count as often. Document frequencies are those of all
    texts. Every fifth text (by a hash; copies share their fate) is kept from
    the centroids, which are fitted to all others: ``slack`` times the cosine that 99 of 100 pieces of the kept texts reach, at each length, is where
    rejection starts. Languages of fewer than 20 texts kept reject nothing. Without usable rows the
    model has no language. Of more than ``MAX_LANGUAGES`` languages those of most rows are learnt (of as many rows, the first in name
    order); the model says in ``left_out`` how many others there were. Their texts are judged like any others.
    A caller who wants less work may set ``per_language``: then about so many texts of each language are drawn by a hash of id and text; no query does.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = staged(rows.groupBy("lang").agg(F.count("*").alias("size")), "language-sizes")
    left_out = max(0, sizes.count() - MAX_LANGUAGES)
    if left_out:
        sizes = sizes.orderBy(F.desc("size"), "lang").limit(MAX_LANGUAGES)
    rows = rows.join(F.broadcast(sizes), "lang").withColumn("bin", F.pmod(F.xxhash64(F.lit("kept"), "text"), F.lit(PARTS)))
    if per_language is not None:
        rows = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < per_language / F.col("size"))
    parts = _quantiles(rows.select("lang", "bin", F.lit(1).alias("n")), ["lang"])
    split = staged(parts.filter("upto * 5 >= total").groupBy("lang").agg(F.min("bin").alias("last"), F.min("upto").alias("n_kept"), F.first("total").alias("total")), "language-split")
    rows = rows.join(F.broadcast(split), "lang").withColumn("kept", F.col("bin") <= F.col("last")).withColumn("fitted", ~F.col("kept") | (F.col("n_kept") == F.col("total")))
    tallies = _tallies(rows)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM), 0
        for batch in batches:
            for s in range(0, batch.num_rows, STEP_ROWS):
                df += np.bincount(np.concatenate(_cells(batch.column("cells").slice(s, STEP_ROWS))), minlength=DIM)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.r_[n, df])], ["feature", "df"])

    df = np.zeros(DIM + 1)
    for r in tallies.select("cells").mapInArrow(frequencies, "feature long, df double").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r.feature + 1] = r.df  # DIM + 1 rows
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    learnt = _clusters(tallies, idf, centroids)
    floors = _floors(tallies, learnt, idf, slack) if learnt else {}
    unstage(tallies)
    found = sorted(((lang, x.astype("<f4").tobytes()) for lang, c in learnt.items() for x in c))
    vectors_ = np.array([np.frombuffer(c, "<f4") for _, c in found], np.float32).reshape(-1, DIM)
    return Model([lang for lang, _ in found], vectors_, np.array([floors[lang] for lang, _ in found]).reshape(-1, CLASSES), idf, left_out)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of that name are replaced.

    Only the text is looked at, and all of it. Texts that are null or have no letter are
    ``und`` with score 0 and rejected. Ties go to the first language in name order; repeated
    rows are judged alike. Very long texts are counted in pieces. No rows in, no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = shared.value.predict(batch.column(text_col).to_pylist())
            new = [pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
