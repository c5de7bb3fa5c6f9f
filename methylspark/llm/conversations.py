"""Conversation structure repair: a Viterbi search whose edits are emitted where all survivors coalesce.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system turn, then
user and assistant in turn. Edits make it so at least cost: Keep (0), Rerole to user or
assistant (1), Delete (2, required for blank and duplicate turns), Insert an empty turn (5); a
truncated turn that stays costs 5 more. Of edits of one cost those whose initials are ASCII-least win.

After each turn one survivor is left for each of the four states that the output can be in. Survivors are leaves of a tree of
backpointers with reference counts: a branch that nobody refers to goes, a chain is held as one
string of letters, and what all survivors share is emitted. Between turns no survivor's letters are the beginning of
another's, so the order of the survivors' whole unresolved suffixes follows from that of their predecessors and
the letters that were added: it is carried along, and a tie is decided without walking back. A
survivor that no ending can make the best one is dropped, so that it doesn't hold up the others.

The rows of a conversation come twice in one sorted stream: first without texts, for the search, then
with texts, which take their edits one by one and go on. So a task holds a letter for each row, never
the texts. A conversation is one task's stream, as its repaired text is one hash chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_size, staged

#: States of the output: nothing yet, or the initial of its last role.
STATES = ("", "s", "u", "a")
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Fault codes, in the order in which they are looked for.
FAULTS = (None, "blank", "duplicate", "truncated")
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Rows and characters that are handed on together.
BATCH_ROWS, BATCH_CHARS = 1024, 1 << 22


def follow(state: str, initial: str) -> bool:
    """Whether a role of this initial may come next."""
    return initial != "" and initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state]


def turn_role(state: str) -> str:
    """The initial of the role that an inserted or reroled turn has after ``state``."""
    return "a" if state == "u" else "u"


def _insertions(state: str) -> list[tuple[str, str, int]]:
    """State, letters and cost after none, one or two inserted turns; more only come back to a state at a higher cost."""
    out = [(state, "", 0)]
    for _ in range(2):
        at, letters, cost = out[-1]
        out.append((turn_role(at), letters + "I", cost + INSERT))
    return out


def moves(initial: str, fault: int) -> list[tuple[int, int, str, int]]:
    """Old state, new state, letters and cost of all that can be done with a turn: insertions before it, then its own edit."""
    best: dict[tuple[str, str], tuple[int, str]] = {}
    for old in STATES:
        for at, letters, cost in _insertions(old):
            own = [(at, "D", DELETE)]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                own.append((turn_role(at), "R", REROLE + more))
                if follow(at, initial):
                    own.append((initial, "K", KEEP + more))
            for new, letter, price in own:
                found = (cost + price, letters + letter)
                best[old, new] = min(best.get((old, new), found), found)
    return [(STATES.index(old), STATES.index(new), letters, cost) for (old, new), (cost, letters) in best.items()]


MOVES = {(i, f): moves(i, f) for i in ("s", "u", "a", "") for f in range(4)}
ENDS = [(STATES.index(s), letters, cost) for s in STATES for at, letters, cost in _insertions(s) if at in ("", "a")]


class Node:
    """A run of edits behind ``parent``; ``children`` and a survivor are the references to it."""

    __slots__ = ("parent", "letters", "children", "alive")

    def __init__(self, parent: Node | None, letters: str = "") -> None:
        self.parent, self.letters, self.children, self.alive = parent, bytearray(letters, "ascii"), [], False
        if parent:
            parent.children.append(self)


class Search:
    """The edits of one conversation: ``add`` each turn, then ``finish``; ``edits`` holds what is resolved."""

    def __init__(self) -> None:
        self.edits = bytearray()
        self.root = Node(None)
        self.root.alive = True
        self.survivors: list[tuple[int, int, Node] | None] = [(0, 0, self.root), None, None, None]  # cost, place in the order, node

    def add(self, initial: str, fault: int) -> None:
        old, best = self.survivors, [None] * 4
        for a, b, letters, cost in MOVES[initial, fault]:
            if old[a]:
                found = (old[a][0] + cost, old[a][1], letters, a)
                if best[b] is None or found < best[b]:
                    best[b] = found
        self._drop_hopeless(best)
        order = sorted((x[1], x[2], b) for b, x in enumerate(best) if x)
        new = [None] * 4
        for place, (_, letters, b) in enumerate(order):
            node = Node(old[best[b][3]][2], letters)
            node.alive = True
            new[b] = (best[b][0], place, node)
        self.survivors = new
        for x in old:
            if x:
                x[2].alive = False
        for x in old:
            if x:
                self._release(x[2])
        self.edits += self.root.letters
        self.root.letters.clear()

    @staticmethod
    def _drop_hopeless(best: list) -> None:
        """Nothing yet, and a system turn alone, have no move from elsewhere that would replace them: they go once another survivor does at least as well whatever comes.

        After an assistant turn all goes on as after nothing, but that a system turn to be kept has to be deleted (2); after
        a user turn one insertion (5) comes before. A system turn alone must go on as after an assistant turn or nothing, which may also end.
        """
        e, s, u, a = best
        if e and (a and e[0] > a[0] + DELETE or u and e[0] > u[0] + INSERT + DELETE):
            best[0] = None
        if s and (a and s[:3] > a[:3] or u and s[0] > u[0] + INSERT or best[0] and s[:3] > best[0][:3]):
            best[1] = None

    def _release(self, node: Node) -> None:
        """Removes what nobody refers to and joins chains, from ``node`` towards the root."""
        while node and not node.alive:
            parent = node.parent
            if not node.children:
                if parent:
                    parent.children.remove(node)
            elif len(node.children) == 1:
                child = node.children[0]
                node.letters += child.letters
                node.children, node.alive = child.children, child.alive
                child.parent, child.children = None, []
                for x in node.children:
                    x.parent = node
                if node.alive:
                    self.survivors = [x and (x[0], x[1], node if x[2] is child else x[2]) for x in self.survivors]
                continue
            node = parent

    def finish(self) -> bytearray:
        """All edits, those that were unresolved included."""
        ends = [(x[0] + cost, x[1], letters, state) for state, letters, cost in ENDS if (x := self.survivors[state])]
        _, _, letters, state = min(ends)
        node, tail = self.survivors[state][2], []
        while node:
            tail.append(bytes(node.letters))
            node = node.parent
        return self.edits + b"".join(reversed(tail)) + letters.encode()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20, nulls taken as one space.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("__k")).filter("__k <> 0")
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, fault, turn, role, was, text``: every edit of every conversation, in order within a partition.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored, whatever their names. Rows
    are taken by turn, nulls first, and of one turn by role and a hash of the text. ``edit`` is the letter K, R,
    D or I, ``fault`` the turn's first one (blank, duplicate, truncated, or null), ``role`` the repaired and ``was`` the role before (null for
    an insertion). Null roles and texts count as one space, so such texts are blank. Rows of a null id are one conversation. Repeated rows are
    duplicates, and are deleted. Texts may have any length. A conversation without rows, or an empty table, has no edits.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = rows.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    bare = staged(own.select("conv", "turn", "role", "digest", fault.cast("int").alias("fault")), "turns")
    same = bare.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = join_by_size(bare, same, ["conv", "role", "digest"], "n", bare.count(), "left")
    later = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    search = marked.select("conv", F.lit(0).alias("phase"), "turn", "role", "digest", "fault", later.alias("later"), F.lit(None).cast("string").alias("text"))
    texts = own.select("conv", F.lit(1).alias("phase"), "turn", "role", "digest", F.lit(0).alias("fault"), F.lit(False).alias("later"), "text")
    stream = search.unionByName(texts).repartition(parts, "conv").sortWithinPartitions("conv", "phase", "turn", "role", "digest")
    stream = stream.select(F.col("conv.conv_id").alias("conv_id"), "phase", "turn", "role", "digest", "fault", "later", "text")
    schema = T.StructType([stream.schema["conv_id"], *T._parse_datatype_string("place long, edit string, fault string, turn long, role string, was string, text string").fields])
    return stream.mapInArrow(lambda batches: _repaired(batches, schema), schema)


def _repaired(batches: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    conv, begun, search, faults, edits, before, state, place = None, False, None, None, None, None, "", 0
    out, chars = [], 0

    def apply(turn: int | None, role: str | None, text: str) -> Iterator[tuple]:
        """The row's edit after the insertions before it; without a role those at the end."""
        nonlocal place, state
        while place < len(edits) and (role is None or edits[place] == ord("I")):
            state = turn_role(state)
            yield conv, place, "I", None, None, ROLES[state], None, ""
            place += 1
        if role is None:
            return
        edit, fault = chr(edits[place]), FAULTS[faults.pop()]
        if edit != "D":
            state = turn_role(state) if edit == "R" else role[:1]
        yield conv, place, edit, fault, turn, ROLES[state] if edit == "R" else role, role, text
        place += 1

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.fieldNames())

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        for s in range(0, batch.num_rows, BATCH_ROWS):
            for c, phase, turn, role, digest, fault, later, text in zip(*(column.to_pylist() for column in batch.slice(s, BATCH_ROWS).columns)):
                if not phase:
                    if not begun or c != conv or edits is not None:  # the next conversation
                        if begun:
                            out += apply(None, None, "")
                        conv, begun, search, faults, edits, before, state, place = c, True, Search(), bytearray(), None, None, "", 0
                    same = (turn, role, digest)
                    if fault != BLANK and (later or same == before):
                        fault = DUPLICATE
                    before = same
                    search.add(role[:1] if role[:1] in ("s", "u", "a") else "", fault)
                    faults.append(fault)
                    continue
                if edits is None:
                    edits, search = search.finish(), None
                    faults.reverse()  # taken from the end
                out += apply(turn, role, text)
                chars += len(text)
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch_of(out, kind)
                    out, chars = [], 0
    if begun:
        out += apply(None, None, "")
    if out:
        yield batch_of(out, kind)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``'s result, taken as it streams by: counts of faults and gaps, cost, letters, and the SHA-256 of ``role:text`` lines.

    ``repaired`` must come straight from ``repair``, whose conversations are each in one partition and in order.
    """
    schema = T.StructType([repaired.schema["conv_id"], *T._parse_datatype_string(AUDIT).fields])
    prices = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, one, kind, done = None, None, None, []

        def fresh() -> dict:
            return {"faults": dict.fromkeys(FAULTS, 0), "illegal": 0, "cost": 0, "audit": bytearray(), "hash": hashlib.sha256(), "lines": 0, "last": None, "turns": 0, "least": None, "most": None}

        def row(x: dict) -> tuple:
            gaps = 0 if x["least"] is None else x["most"] - x["least"] + 1 - x["turns"]
            f = x["faults"]
            return conv, gaps, f["blank"], f["duplicate"], f["truncated"], x["illegal"], x["cost"], x["audit"].decode(), x["hash"].hexdigest()

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], schema.fieldNames())

        for batch in batches:
            kind = batch.column("conv_id").type
            for c, place, edit, fault, turn, role, was, text in zip(*(column.to_pylist() for column in batch.columns)):
                if place == 0:
                    if one:
                        done.append(row(one))
                    conv, one = c, fresh()
                one["audit"] += edit.encode()
                one["cost"] += prices[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "I":
                    one["faults"][fault] += 1
                    pair, one["last"] = (one["last"] or "") + was[:1], was[:1]
                    one["illegal"] += one["lines"] > 0 and pair not in ("su", "ua", "au")
                    one["lines"] += 1
                    if turn is not None and turn != one["most"]:  # they ascend
                        one["least"], one["most"], one["turns"] = turn if one["least"] is None else one["least"], turn, one["turns"] + 1
                if edit != "D":
                    one["hash"].update(f"{one.get('sep', '')}{role}:{text}".encode())
                    one["sep"] = "\n"
            if len(done) >= BATCH_ROWS:
                yield batch_of()
                done = []
        if one:
            done.append(row(one))
        if done:
            yield batch_of()

    return repaired.mapInArrow(run, schema)


def audit_conversations(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``audits`` of ``rows`` for each ``conv_id`` of ``every``; a conversation that has lost all its rows has zeros, no letters and the hash of nothing."""
    found = audits(repair(rows)).withColumn("__conv", F.struct("conv_id")).drop("conv_id")
    ids = every.select(F.struct("conv_id").alias("__conv")).distinct()
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found, "__conv", "left").select(F.col("__conv.conv_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
