"""Edit-aware token counts.

A text is split into pre-tokens by the tokenizer's pattern; tokens never cross them. For
every document a segment tree is kept: its leaves are runs of pre-tokens with their
numbers of characters and tokens, its inner nodes the sums. An edit replaces a range of
characters. Its place is found by descending the tree; from the start of a leaf shortly
before it the new text is split again until a split falls on the start of an old leaf
behind the edit. Only those leaves are encoded anew, and only the sums above them change.
"""

from __future__ import annotations

import base64
import re as _re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a leaf.
LEAF = 64
#: Characters before an edit that the pattern's look-ahead can reach from.
CONTEXT = 2
MAX_CACHE = 1 << 19
TREE = "n_chars int, n_tokens int, n_pretokens int, chars array<int>, tokens array<int>"
EDITS = "array<struct<start: int, end: int, replacement: string>>"

_counters: dict[str, Counter] = {}


class Counter:
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MAX_CACHE:
                self.known.clear()
            n = len(self.encode(piece))
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int], int]:
        """Characters and tokens of each leaf of a whole text, and its number of pre-tokens."""
        pieces = self.pattern.findall(text)
        count, known = self.count, self.known
        per = []
        for p in pieces:
            n = known.get(p)
            per.append(count(p) if n is None else n)
        chars = [sum(map(len, pieces[i : i + LEAF])) for i in range(0, len(pieces), LEAF)]
        return chars or [0], [sum(per[i : i + LEAF]) for i in range(0, len(per), LEAF)] or [0], len(pieces)


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def tree_of(leaves: list[int]) -> list[int]:
    """A heap of sums: the root at 1, the leaves from half its length on."""
    half = 1
    while half < len(leaves):
        half *= 2
    tree = [0] * half + leaves + [0] * (half - len(leaves))
    for i in range(half - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def find_leaf(tree: list[int], at: int) -> tuple[int, int]:
    """The leaf that holds character ``at`` (or the last one that has characters), and where it starts."""
    at = max(0, min(at, tree[1] - 1))
    i, start, half = 1, 0, len(tree) // 2
    while i < half:
        i *= 2
        if at - start >= tree[i]:
            start += tree[i]
            i += 1
    return i - half, start


def set_leaf(tree: list[int], leaf: int, value: int) -> None:
    i = leaf + len(tree) // 2
    change = value - tree[i]
    while i and change:
        tree[i] += change
        i //= 2


def update(text: str, edits: list[tuple[int, int, str]], chars: list[int], tokens: list[int], c: Counter) -> tuple[str, int]:
    """Apply edits (sorted, apart) to text and trees; returns the new text and how many pre-tokens were split anew.

    The trees change in place; a region keeps its number of leaves.
    """
    parts, at = [], 0
    for s, e, new in edits:
        parts += [text[at:s], new]
        at = e
    new_text = "".join([*parts, text[at:]])
    half, anew = len(chars) // 2, 0
    starts = [0]
    for n in chars[half:]:
        starts.append(starts[-1] + n)
    regions, k = [], 0
    shift_before = 0  # of all edits before the region
    while k < len(edits):
        first, begin = find_leaf(chars, edits[k][0] - CONTEXT)
        pos, leaf = begin + shift_before, first
        shift, pieces, stop = shift_before, [], None
        next_edit = k
        it = c.pattern.finditer(new_text, pos)
        while stop is None:
            while next_edit < len(edits) and edits[next_edit][0] + shift - CONTEXT <= pos:
                shift += len(edits[next_edit][2]) - (edits[next_edit][1] - edits[next_edit][0])
                next_edit += 1
            behind = edits[next_edit - 1][1] if next_edit > k else edits[k][1]
            if next_edit > k and pieces and pos - shift >= behind:
                while leaf < half and starts[leaf] < pos - shift:
                    leaf += 1
                ahead = edits[next_edit][0] - CONTEXT if next_edit < len(edits) else None
                if leaf < half and starts[leaf] == pos - shift and chars[half + leaf] and leaf > first and (ahead is None or pos - shift <= ahead):
                    stop = leaf
                    break
            m = next(it, None)
            if m is None:
                stop = half
                while next_edit < len(edits):
                    shift += len(edits[next_edit][2]) - (edits[next_edit][1] - edits[next_edit][0])
                    next_edit += 1
                break
            pieces.append(m[0])
            pos = m.end()
        regions.append((first, stop, pieces))
        k, shift_before = next_edit, shift
    for first, stop, pieces in regions:
        anew += len(pieces)
        n = stop - first
        it, per = iter(pieces), -(-len(pieces) // n)
        for leaf in range(first, stop):
            own = list(islice(it, per))
            set_leaf(chars, leaf, sum(map(len, own)))
            set_leaf(tokens, leaf, sum(map(c.count, own)))
    return new_text, anew


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("version", F.xxhash64("text"))


def build_trees(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, version`` (a hash of the text) and the trees, for every row.

    Null texts count as empty, which is one leaf without tokens; repeated rows have a tree each.
    Texts are split whole, however long. Other columns are ignored, whatever their names. No
    rows in, no rows out.
    """
    rows = _keyed(docs, text_col, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                chars, tokens, n = c.leaves(text.as_py())
                chars, tokens = tree_of(chars), tree_of(tokens)
                out.append((chars[1], tokens[1], n, chars, tokens))
            types = [pa.int32()] * 3 + [pa.list_(pa.int32())] * 2
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], ["doc_id", "version", "n_chars", "n_tokens", "n_pretokens", "chars", "tokens"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("version", T.LongType()), *T._parse_datatype_string(TREE).fields])
    return rows.mapInArrow(run, schema)


NUMBER = _re.compile(r"\d{5,}")


def redactions_of(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask e-mail addresses and runs of five or more digits, in order and apart."""
    found, at = [], text.find("@")
    while at >= 0:
        s = e = at
        while s and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        found.append((s, e, "<email>"))
        at = text.find("@", e)
    mails, k = found[:], 0
    for m in NUMBER.finditer(text):  # both are in order and apart
        while k < len(mails) and mails[k][1] <= m.start():
            k += 1
        if k == len(mails) or mails[k][0] >= m.end():
            found.append((m.start(), m.end(), "<number>"))
    return sorted(found)


def find_redactions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, version, edits`` for each different text that has any; null and empty ones have none, repeated rows stand once."""
    rows = _keyed(docs, text_col, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
        for batch in batches:
            edits = [redactions_of(x.as_py()) for x in batch.column("text")]
            has = pa.array([bool(x) for x in edits])
            edits = pa.array([[{"start": s, "end": e, "replacement": r} for s, e, r in x] for x in edits], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), edits], ["doc_id", "version", "edits"]).filter(has)

    schema = T.StructType([rows.schema["doc_id"], T.StructField("version", T.LongType()), *T._parse_datatype_string(f"edits {EDITS}").fields])
    return rows.mapInArrow(run, schema).dropDuplicates(["doc_id", "version"])


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, version, n_edits, n_anew, new_text`` and the trees after the edits, for each different text that has edits.

    ``edits`` has ``doc_id, version, edits`` (by character, sorted, apart); only texts
    that it names are moved. Null ids are ids, null texts are empty, and rows that repeat id and text are one; without
    rows or edits there are none here. Texts may have any length.
    """
    keys = ["doc_id", "version"]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    rows = _keyed(docs, text_col, id_col)
    few = rows.join(edits, same(rows, edits)).select(rows.doc_id, rows.version, "text", "edits").dropDuplicates(keys)
    own = trees.dropDuplicates(keys)
    met = few.join(own, same(few, own)).select(few.doc_id, few.version, "text", "edits", "chars", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        names = ["n_edits", "n_anew", "new_text", "n_tokens_after", "chars", "tokens"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for row in batch.select(["text", "edits", "chars", "tokens"]).to_pylist():
                todo = [(x["start"], x["end"], x["replacement"] or "") for x in row["edits"]]
                text, anew = update(row["text"], todo, row["chars"], row["tokens"], c)
                out.append((len(todo), anew, text, row["tokens"][1], row["chars"], row["tokens"]))
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], [*keys, *names])

    more = "n_edits int, n_anew int, new_text string, n_tokens_after int, chars array<int>, tokens array<int>"
    return met.mapInArrow(run, T.StructType([*(met.schema[k] for k in keys), *T._parse_datatype_string(more).fields]))


def count_with_edits(docs: DataFrame, trees: DataFrame, edited: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_anew`` for every row of ``trees``.

    Rows that repeat id and text have the same counts; texts without edits keep theirs, and null ids
    are matched like others. No rows in, no rows out.
    """
    e = edited.select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), "n_edits", "n_tokens_after", "n_anew")
    met = trees.join(e, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__v")), "left")
    return met.select(
        "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_pretokens").cast("long").alias("n_pretokens"),
        F.coalesce("n_edits", F.lit(0)).cast("long").alias("n_edits"), F.coalesce("n_tokens_after", "n_tokens").cast("long").alias("n_tokens_after"),
        F.coalesce("n_anew", F.lit(0)).cast("long").alias("n_anew"),
    )
