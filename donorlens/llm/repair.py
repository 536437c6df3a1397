"""Conversation structure repair by a shortest path through the edit lattice.

*Rows.*  A conversation's rows are taken by turn (null first), then role and
text.  A row's first fault counts: blank (nothing but white space), duplicate
(role and text seen earlier in the conversation), truncated (its last
character that is not white space is none of ``.!?``).

*Lattice.*  A node is (rows consumed, role last given): nothing, system, user
or assistant.  Edges: K keep (0), R give the row the role user or assistant
(3), D delete (4, the only edge of blank and duplicate rows), I insert an
empty row of user or assistant (3); a truncated row that stays adds 3.  The
roles given must read ``(s?(ua)+)?`` by their initials.

*Search.*  Dijkstra from both ends.  The forward heap keeps the cost of a node
and its least audit (the edits' initials) from the start, the reverse heap the
same up to the end; each settles nodes by cost, equal ones along the rows, as
only K costs nothing.  After the heaps have met they go on while their tops
can still give an equal cost; then every edge from a node settled forward to
one settled in reverse that closes a path of the least cost is a crossing,
and the least concatenated audit wins.  (Of two audits up to one node with
equal costs none is the beginning of the other, so least parts make a least
whole.)

*Long conversations.*  The lattice is cut after every ``block_rows`` rows.
Each block is searched between all pairs of roles at its borders, and the
chain of blocks is joined by least cost and audit.  Conversations of more than
``long_rows`` rows or ``long_bytes`` bytes are dealt by ranges of (turn,
role, text) over many tasks, which search their blocks side by side; equal
rows count as one row with a number.  Only what is sequential by its nature,
the digest of the repaired conversation, is streamed through one task a
conversation, in memory bounded by a batch.  Shorter ones are streamed whole.

Defined results: a null conv_id is a conversation of its own; null roles and
texts count as one space (so such a row is blank or cannot keep its role); an
empty role cannot be kept either; rows of one turn are ordered by role and
text; conversations without rows have zeros, an empty audit and the digest of
an empty string; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LONG_ROWS, LONG_BYTES, BLOCK_ROWS = 1024, 8 << 20, 256
SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: the role given last
STATES, ENDS = range(4), (NOTHING, ASSISTANT)
INITIALS = "sua"
STEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NEXT = (USER, USER, ASSISTANT, USER)  # the state after an R or I: only one of user and assistant fits
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NO_ROWS = hashlib.sha256(b"").hexdigest()

Token = tuple[str, bool, int]  # (initial, truncated, 0), or ("", False, rows that must go)


# --- the lattice ----------------------------------------------------------------

def _edges(token: Token, state: int) -> Iterator[tuple[str, int, int]]:
    """(edits, cost, next state) of the edges that consume a token."""
    initial, truncated, forced = token
    if forced:
        yield "D" * forced, DELETE * forced, state
        return
    more = TRUNCATED * truncated
    kept = STEP[initial][state] if initial in STEP else None
    if kept is not None:
        yield "K", more, kept
    yield "R", REROLE + more, NEXT[state]
    yield "D", DELETE, state


def search(tokens: list[Token], starts: Iterable[int], ends: Iterable[int], tail: bool) -> tuple[int, str]:
    """(cost, least audit) of the cheapest path over all tokens from a start
    to an end state; ``tail``: rows may be inserted after the last token.
    The cost is -1 if there is no path."""
    n = len(tokens)
    backward: dict[Token, list[list[tuple[int, str, int]]]] = {}

    def ahead(i: int, s: int) -> Iterator[tuple[int, int, str, int]]:
        if i < n:
            for edits, cost, t in _edges(tokens[i], s):
                yield i + 1, t, edits, cost
        if i < n or tail:
            yield i, NEXT[s], "I", INSERT

    def behind(i: int, t: int) -> Iterator[tuple[int, int, str, int]]:
        if i:
            token = tokens[i - 1]
            if token not in backward:
                backward[token] = [[] for _ in STATES]
                for s in STATES:
                    for edits, cost, to in _edges(token, s):
                        backward[token][to].append((s, edits, cost))
            for s, edits, cost in backward[token][t]:
                yield i - 1, s, edits, cost
        if i < n or tail:
            for s in STATES:
                if NEXT[s] == t:
                    yield i, s, "I", INSERT

    ahead_label = {(0, s): (0, "") for s in starts}
    behind_label = {(n, s): (0, "") for s in ends}
    ahead_heap = [(0, i, s) for i, s in ahead_label]
    behind_heap = [(0, -i, s) for i, s in behind_label]
    heapq.heapify(ahead_heap)
    heapq.heapify(behind_heap)
    ahead_done: set = set()
    behind_done: set = set()
    best = -1
    while (ahead_heap and behind_heap) if best < 0 else (ahead_heap or behind_heap):
        tops = [heap[0][0] if heap else 0 for heap in (ahead_heap, behind_heap)]  # an empty heap has settled all it can reach
        both_ends = not (ahead_heap and not tops[0] or behind_heap and not tops[1])  # the ends themselves are settled
        if 0 <= best < sum(tops) and both_ends:
            break
        forward = not behind_heap or (bool(ahead_heap) and tops[0] <= tops[1])
        cost, i, s = heapq.heappop(ahead_heap if forward else behind_heap)
        node = (abs(i), s)
        done, label, other = (ahead_done, ahead_label, behind_label) if forward else (behind_done, behind_label, ahead_label)
        if node in done or label[node][0] != cost:
            continue
        done.add(node)
        audit = label[node][1]
        if node in other and (best < 0 or cost + other[node][0] < best):
            best = cost + other[node][0]
        for j, t, edits, step in (ahead if forward else behind)(*node):
            new = (cost + step, audit + edits if forward else edits + audit)
            if (j, t) not in done and ((j, t) not in label or new < label[j, t]):
                if (j, t) not in label or new[0] != label[j, t][0]:
                    heapq.heappush(ahead_heap if forward else behind_heap, (new[0], j if forward else -j, t))
                label[j, t] = new
    if best < 0:
        return -1, ""
    least = None
    for node in ahead_done:
        cost, audit = ahead_label[node]
        crossings = [(*node, "", 0), *ahead(*node)]
        for j, t, edits, step in crossings:
            if (j, t) in behind_done and cost + step + behind_label[j, t][0] == best:
                whole = audit + edits + behind_label[j, t][1]
                least = whole if least is None or whole < least else least
    return best, least


@functools.lru_cache(maxsize=50_000)
def _short(tokens: tuple[Token, ...]) -> tuple[int, str]:
    return search(list(tokens), [NOTHING], ENDS, True)


def matrix(tokens: list[Token]) -> tuple[list[int], list[str]]:
    """Costs and audits of a block: from each state to each state without a
    tail, then from each state to the end of the conversation."""
    found = [search(tokens, [s], [t], False) for s in STATES for t in STATES] + [search(tokens, [s], ENDS, True) for s in STATES]
    return [c for c, _ in found], [a for _, a in found]


class _Path:
    """A path over blocks: the last block's audit and entry state, and the path before."""

    __slots__ = ("before", "audit", "entry")

    def __init__(self, before: _Path | None, audit: str, entry: int):
        self.before, self.audit, self.entry = before, audit, entry

    def blocks(self) -> list[tuple[int, str]]:
        out, path = [], self
        while path is not None:
            out.append((path.entry, path.audit))
            path = path.before
        return out[::-1]

    def less(self, other: _Path) -> bool:
        """Whether the whole audit is less: the first block that differs decides."""
        a, b, result = self, other, False
        while a is not b and a is not None:
            if a.audit != b.audit:
                result = a.audit < b.audit
            a, b = a.before, b.before
        return result


class Chain:
    """Joins the blocks of one conversation, in order."""

    def __init__(self):
        self.labels: dict[int, tuple[int, _Path | None]] = {NOTHING: (0, None)}
        self.waiting: tuple[list[int], list[str]] | None = None

    def add(self, costs: list[int], audits: list[str]) -> None:
        self._take(False)
        self.waiting = costs, audits

    def _take(self, last: bool) -> None:
        if self.waiting is None:
            return
        costs, audits = self.waiting
        new: dict[int, tuple[int, _Path | None]] = {}
        for s, (cost, path) in self.labels.items():
            for t in [NOTHING] if last else STATES:
                k = 16 + s if last else 4 * s + t
                if costs[k] < 0:
                    continue
                total, way = cost + costs[k], _Path(path, audits[k], s)
                if t not in new or total < new[t][0] or (total == new[t][0] and way.less(new[t][1])):
                    new[t] = total, way
        self.labels, self.waiting = new, None

    def finish(self) -> tuple[int, list[tuple[int, str]]]:
        """(cost, (entry state, audit) of every block)."""
        self._take(True)
        cost, path = self.labels[NOTHING]
        return cost, path.blocks() if path else []


def solve(tokens: list[Token], block_rows: int = BLOCK_ROWS) -> tuple[int, str]:
    """(cost, least audit) of a conversation."""
    if len(tokens) <= min(block_rows, 24):
        return _short(tuple(tokens))
    if len(tokens) <= block_rows:
        return search(tokens, [NOTHING], ENDS, True)
    chain = Chain()
    for a in range(0, len(tokens), block_rows):
        chain.add(*matrix(tokens[a:a + block_rows]))
    cost, blocks = chain.finish()
    return cost, "".join(audit for _, audit in blocks)


# --- rows of a conversation -----------------------------------------------------

class Rows:
    """Counts and tokens of consecutive rows of a conversation, as they come."""

    def __init__(self):
        self.tokens: list[Token] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None  # initials
        self.turns: list[int] = []  # lowest, highest
        self.n_turns = 0

    def _must_go(self, n: int) -> None:
        if self.tokens and self.tokens[-1][2]:
            n += self.tokens.pop()[2]
        self.tokens.append(("", False, n))

    def add(self, turn: int | None, role: str, text: str, n: int, again: bool) -> None:
        """A row that stands ``n`` times; ``again``: its role and text came earlier."""
        end = text.rstrip(SPACE)[-1:]
        if not end:
            self.blank += n
            self._must_go(n)
        else:
            self.duplicate += n - 1 + again
            if not again:
                cut = end not in ".!?"
                self.truncated += cut
                self.tokens.append((role[:1], cut, 0))
            if n - 1 + again:
                self._must_go(n - 1 + again)
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += n - 1  # a row and its equal: never two different initials
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.n_turns += 1


def gaps(low: int | None, high: int | None, n_turns: int) -> int:
    return 0 if low is None else high - low + 1 - n_turns


def repaired(rows: Iterable[tuple[str, str, int]], audit: str, state: int) -> Iterator[str | int]:
    """Lines ``role:text`` of (role, text, n) after their edits; the last item is the state."""
    at = 0

    def inserted() -> Iterator[str]:
        nonlocal at, state
        while audit[at:at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield f"{ROLE[state]}:"

    for role, text, n in rows:
        for _ in range(n):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = STEP[role[:1]][state]
                yield f"{role}:{text}"
            elif edit == "R":
                state = NEXT[state]
                yield f"{ROLE[state]}:{text}"
    yield from inserted()
    yield state


class _Digest:
    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def line(self, line: str) -> None:
        self.hash.update(("\n" + line if self.any else line).encode())
        self.any = True


# --- streams over sorted rows ---------------------------------------------------

def _rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _flushed(made: Iterator[tuple], schema: str, rows: int) -> Iterator[pa.RecordBatch]:
    ready: list[tuple] = []
    for row in made:
        ready.append(row)
        if len(ready) == rows:
            yield _packed(ready, schema)
            ready = []
    if ready:
        yield _packed(ready, schema)


def _short_batches(block_rows: int) -> Callable:
    """Whole conversations, one after the other."""

    def finished(conv_id: int | None, rows: list[tuple]) -> tuple:
        seen: set = set()
        facts = Rows()
        for turn, role, text, n in rows:
            facts.add(turn, role, text, n, (role, text) in seen)
            seen.add((role, text))
        cost, audit = solve(facts.tokens, block_rows)
        digest = _Digest()
        for line in repaired([r[1:] for r in rows], audit, NOTHING):
            if isinstance(line, str):
                digest.line(line)
        low, high = facts.turns or (None, None)
        return (conv_id, gaps(low, high, facts.n_turns), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, digest.hash.hexdigest())

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, conv, rows = None, None, []
        for batch in batches:
            for new_name, conv_id, *row in _rows_of(batch, "name", "conv_id", "turn", "role", "text", "n"):
                if new_name != name and name is not None:
                    yield finished(conv, rows)
                    rows = []
                name, conv = new_name, conv_id
                rows.append(tuple(row))
        if name is not None:
            yield finished(conv, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flushed(results(batches), OUT, 512)

    return run


NUMBERED = "name string, conv_id long, part int, k long, pos long, turn long, role string, text string, n long, again boolean"
BLOCKS = ("name string, conv_id long, part int, k long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
          "low long, high long, n_turns long, costs array<long>, audits array<string>")
PIECES = ("name string, conv_id long, part int, k long, entry int, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string")


def _number_batches(block_rows: int) -> Callable:
    """Adds (part, k, pos): task, block in the task, place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, pos, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            ks, places = [], []
            for name in batch.column("name").to_pylist():
                if name != last or pos == block_rows:
                    k, pos, last = k + 1, 0, name
                ks.append(k)
                places.append(pos)
                pos += 1
            made = {"part": pa.array([part] * batch.num_rows, pa.int32()), "k": pa.array(ks, pa.int64()), "pos": pa.array(places, pa.int64())}
            names = [f.split(" ")[0] for f in NUMBERED.split(", ")]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: counts, border facts, costs and audits."""

    def results() -> Iterator[tuple]:
        key, facts = None, Rows()
        for batch in batches:
            for name, conv_id, part, k, *row in _rows_of(batch, "name", "conv_id", "part", "k", "turn", "role", "text", "n", "again"):
                if key is not None and (name, part, k) != (key[0], *key[2:]):
                    yield block(key, facts)
                    facts = Rows()
                key = (name, conv_id, part, k)
                facts.add(*row)
        if key is not None:
            yield block(key, facts)

    def block(key: tuple, facts: Rows) -> tuple:
        low, high = facts.turns or (None, None)
        return (*key, facts.blank, facts.duplicate, facts.truncated, facts.illegal, facts.first, facts.last, low, high, facts.n_turns, *matrix(facts.tokens))

    return _flushed(results(), BLOCKS, 16)


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the blocks of each conversation; the first row of a conversation has its totals."""

    def finished(keys: list[tuple], totals: list[int], turns: list, chain: Chain) -> Iterator[tuple]:
        cost, blocks = chain.finish()
        facts = (gaps(*turns), *totals, cost, "".join(a for _, a in blocks))
        for key, (entry, piece) in zip(keys, blocks, strict=True):
            yield (*key, entry, piece, *facts)
            facts = (None,) * len(facts)

    def results() -> Iterator[tuple]:
        keys: list[tuple] = []
        for batch in batches:
            names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
            for name, conv_id, part, k, blank, duplicate, truncated, illegal, first, last, low, high, n_turns, costs, audits in _rows_of(batch, *names):
                if keys and keys[0][0] != name:
                    yield from finished(keys, totals, turns, chain)
                    keys = []
                if not keys:
                    totals, turns, chain, before = [0] * 4, [None, None, 0], Chain(), None
                keys.append((name, conv_id, part, k))
                border = before is not None and before + first not in LEGAL
                totals = [a + b for a, b in zip(totals, (blank, duplicate, truncated, illegal + border), strict=True)]
                if low is not None:
                    turns = [low if turns[0] is None else turns[0], high, turns[2] + n_turns - (turns[1] == low)]
                before = last
                chain.add(costs, audits)
        if keys:
            yield from finished(keys, totals, turns, chain)

    return _flushed(results(), PIECES, 256)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the rows of each long conversation, block by block, into its digest."""

    def results() -> Iterator[tuple]:
        name, digest, rows, audit, entry, key = None, _Digest(), [], "", NOTHING, None

        def take() -> None:
            for line in repaired(rows, audit, entry):
                if isinstance(line, str):
                    digest.line(line)

        for batch in batches:
            for new, part, k, role, text, n, piece, state in _rows_of(batch, "name", "part", "k", "role", "text", "n", "piece", "entry"):
                if key is not None and (new, part, k) != key:
                    take()
                    rows = []
                if name is not None and new != name:
                    yield name, digest.hash.hexdigest()
                    digest = _Digest()
                if piece is not None:
                    audit, entry = piece, state
                name, key = new, (new, part, k)
                rows.append((role, text, n))
        if key is not None:
            take()
            yield name, digest.hash.hexdigest()

    return _flushed(results(), "name string, repaired_sha256 string", 256)


# --- jobs -----------------------------------------------------------------------

def named_rows(conversations: DataFrame) -> DataFrame:
    """(name, conv_id, turn, role, text): nulls of role and text are one space, ``name`` is never null."""
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("name"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """``named_rows`` after damage, with ``n``, how often each stands (0: dropped)."""
    rows = named_rows(conversations)
    kind = F.crc32(F.concat("name", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return rows.select("name", "conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of (name, conv_id, turn, role, text, n), ``n``
    being how often a row stands there: its counts of faults, the cost and
    the audit of the cheapest edits, and the digest of what they make of it."""
    sizes = written(rows.groupBy("name", "conv_id").agg(
        F.sum("n").alias("n_rows"), F.sum(F.octet_length("text") * F.col("n")).alias("n_bytes")), "conversations")
    standing = rows.where("n > 0")
    long = written(sizes.where((F.col("n_rows") > long_rows) | (F.col("n_bytes") > long_bytes)).select(F.col("name").alias("long_name")), "long-conversations")
    is_long = F.col("name") == F.col("long_name")
    order = ["name", "turn", "role", "text"]
    short = (standing.join(long, is_long, "left_anti").repartition("name").sortWithinPartitions(*order).mapInArrow(_short_batches(block_rows), OUT))
    none = sizes.where("n_rows = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                            F.lit("").alias("audit"), F.lit(NO_ROWS).alias("repaired_sha256"))
    return short.union(_long(standing.join(long, is_long, "left_semi"), block_rows)).union(none)


def _long(rows: DataFrame, block_rows: int) -> DataFrame:
    equal = (rows.groupBy("name", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
             .withColumn("text_hash", F.sha2("text", 256)).withColumn("when", F.struct(F.col("turn").isNotNull().alias("some"), "turn")))
    firsts = equal.groupBy("name", "role", "text_hash").agg(F.min("when").alias("first_when"))
    flagged = equal.join(firsts, ["name", "role", "text_hash"]).withColumn("again", F.col("when") != F.col("first_when"))
    place = ["name", "turn", "role", F.substring("text", 1, 64)]
    numbered = written(
        flagged.repartitionByRange(*place).sortWithinPartitions("name", "turn", "role", "text")
        .select("name", "conv_id", "turn", "role", "text", "n", "again").mapInArrow(_number_batches(block_rows), NUMBERED), "numbered")
    in_blocks = ["name", "part", "k"]
    blocks = numbered.repartition(*in_blocks).sortWithinPartitions(*in_blocks, "pos").mapInArrow(_block_batches, BLOCKS)
    pieces = written(blocks.repartition("name").sortWithinPartitions(*in_blocks).mapInArrow(_chain_batches, PIECES), "pieces")
    starts = pieces.select("name", "part", "k", F.lit(0).cast("long").alias("pos"), "piece", "entry")
    digests = (numbered.join(starts, [*in_blocks, "pos"], "left").repartition("name").sortWithinPartitions(*in_blocks, "pos")
               .mapInArrow(_digest_batches, "name string, repaired_sha256 string"))
    totals = pieces.where("audit IS NOT NULL")
    return totals.join(digests, "name").select([f.split(" ")[0] for f in OUT.split(", ")])
