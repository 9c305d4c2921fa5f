"""Conversation structure repair by divide and conquer over four-state cost vectors.

A repaired conversation is empty, or turns of user and assistant in alternation that end with an assistant, after at most
one system turn.  What has been read of it is in one of four states: nothing, system, user, assistant.  Each row is kept,
given another role or deleted, and empty turns may be inserted; the cheapest way is wanted, and of the cheapest the one
whose edits' initials (D, I, K, R) come first in ASCII.

`Solver` finds it in linear space, as Hirschberg does for alignments: a vector of costs runs forward from the start to the
middle row, another runs backward from the end, and the state in which both together cost least is where the best way
crosses; both halves are solved in the same manner.  The edits decide the state, so two ways that end a row in different
states part at some letter before, and the forward vector carries the order of its four ways beside their costs: ties at
the crossing go to the way that is first.

On Spark the rows are laid out by range of (conversation, turn), so a conversation of any length is many blocks.  A block
is condensed to a matrix of costs and orders from state to state; the crossings between the blocks of a conversation are
chosen with these, and then every block is solved by itself.  A conversation has one row for each of its blocks in that
step.  Only the digest of a repaired conversation is one stream for each conversation, read in order with one turn held
at a time.

Defined results: a null role or text is one space; rows without a turn come first; rows of one turn come in the order of
a hash of role and text, equal rows beside each other; a row without a conv_id belongs to the conversation without one;
a role with no initial s, u or a (or none) cannot be kept; rows of a conversation may repeat; a conversation without rows
has zeros and an empty audit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import materialise, read

#: Costs of a new role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bytes of text and rows of a block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 50_000
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: Initials by number; whole, truncated, blank and duplicate rows by number.  A row is the letter A + initial + 4 x fault.
INITIALS = "sua?"
WHOLE, CUT, BLANK, COPY = range(4)
_INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


# ---------------------------------------------------------------- one block

def _ways(code: int) -> list[list[tuple[int, str] | None]]:
    """From state to state over one row: the cheapest cost and its letters, insertions before the row included."""
    initial, fault = code % 4, code // 4
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        at, cost, letters = p, 0, ""
        for _ in range(3):                           # none, one or two insertions
            ends = [(at, cost + DELETE, letters + "D")]
            if fault in (WHOLE, CUT):
                stay = cost + (TRUNCATED if fault == CUT else 0)
                if (at, initial) in _KEPT:
                    ends.append((_KEPT[at, initial], stay, letters + "K"))
                ends.append((_INSERTED[at], stay + REROLE, letters + "R"))
            for q, c, w in ends:
                if table[p][q] is None or (c, w) < table[p][q]:
                    table[p][q] = (c, w)
            at, cost, letters = _INSERTED[at], cost + INSERT, letters + "I"
    return table


WAYS = {chr(65 + code): _ways(code) for code in range(16)}
_STEPS = {code: [[(p, *table[p][q]) for p in range(4) if table[p][q]] for q in range(4)] for code, table in WAYS.items()}
_BACK = {code: [[(q, table[p][q][0]) for q in range(4) if table[p][q]] for p in range(4)] for code, table in WAYS.items()}
#: What is added after the last row so that the end is a legal one.
FINAL = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

Vector = tuple[list[int], list[int]]      # costs, and the order of the four ways among each other


def start_vector(p: int) -> Vector:
    return [0 if q == p else FAR for q in range(4)], [0] * 4


def forward(vector: Vector, codes: str) -> Vector:
    costs, order = vector
    for code in codes:
        best = []
        for q, steps in enumerate(_STEPS[code]):
            found = (FAR, 0, "")
            for p, c, w in steps:
                if costs[p] < FAR:
                    way = (costs[p] + c, order[p], w)
                    if way < found:
                        found = way
            best.append(found)
        ranked = sorted(range(4), key=lambda q: best[q][1:])
        costs, order = [b[0] for b in best], [0] * 4
        for k, q in enumerate(ranked):
            order[q] = k
    return costs, order


def backward(costs: list[int], codes: str) -> list[int]:
    for code in reversed(codes):
        costs = [min(costs[q] + c for q, c in steps) for steps in _BACK[code]]
    return costs


def crossing(vector: Vector, rest: list[int]) -> int:
    """The state in which the best way crosses; of equal ones, that of the way which is first."""
    costs, order = vector
    return min(range(4), key=lambda q: (costs[q] + rest[q], order[q]))


def _between(codes: str, p: int, q: int) -> str:
    """The letters of the best way over some rows from state p to state q."""
    if len(codes) == 1:
        return WAYS[codes][p][q][1]
    half = len(codes) // 2
    middle = crossing(forward(start_vector(p), codes[:half]), backward([0 if s == q else FAR for s in range(4)], codes[half:]))
    return _between(codes[:half], p, middle) + _between(codes[half:], middle, q)


@lru_cache(maxsize=1 << 16)
def _short_between(codes: str, p: int, q: int) -> str:
    return _between(codes, p, q) if codes else ""


@lru_cache(maxsize=1 << 14)
def _short_matrix(codes: str) -> tuple[int, ...]:
    return _matrix(codes)


def _matrix(codes: str) -> tuple[int, ...]:
    out: list[int] = []
    for p in range(4):
        costs, order = forward(start_vector(p), codes)
        out += costs + order
    return tuple(out)


class Solver:
    """The best edits of rows given as letters."""

    SHORT = 64                                       # rows up to which answers are remembered

    def between(self, codes: str, p: int, q: int) -> str:
        return (_short_between if len(codes) <= self.SHORT else _between)(codes, p, q)

    def matrix(self, codes: str) -> tuple[int, ...]:
        """For each first state the costs of the last states and the order of these ways."""
        return (_short_matrix if len(codes) <= self.SHORT else _matrix)(codes)

    def whole(self, codes: str) -> str:
        last = crossing(forward(start_vector(NOTHING), codes), [FINAL[q][0] for q in range(4)])
        return self.between(codes, NOTHING, last) + FINAL[last][1]

    def chain(self, matrices: list[tuple[int, ...]]) -> list[int]:
        """The states before each block and after the last, from the blocks' matrices."""
        rest = [[FINAL[q][0] for q in range(4)]]
        for m in reversed(matrices):
            rest.append([min(m[8 * p + q] + rest[-1][q] for q in range(4)) for p in range(4)])
        rest.reverse()
        states = [NOTHING]
        for m, after in zip(matrices, rest[1:]):
            p = states[-1]
            states.append(crossing((list(m[8 * p:8 * p + 4]), list(m[8 * p + 4:8 * p + 8])), after))
        return states


def illegal_pairs(codes: str, before: str = "") -> int:
    row = "".join(INITIALS[(ord(c) - 65) % 4] for c in before[-1:] + codes)
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(row, row[1:])))


def cost_of(codes: str, audit: str) -> int:
    """The cost of edits over rows."""
    total, at = 0, 0
    for letter in audit:
        total += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
        if letter != "I":
            total += TRUNCATED if letter in "KR" and (ord(codes[at]) - 65) // 4 == CUT else 0
            at += 1
    return total


# ---------------------------------------------------------------- rows

def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows with planted faults, n times each; dropped rows are missing."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"),
                                     F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(k == 3, 2).otherwise(1).alias("n"))


def _state_of_text(text: Column) -> Column:
    """Whole, truncated or blank."""
    left = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(left == "", BLANK).when(F.right(left, F.lit(1)).isin(".", "!", "?"), WHOLE).otherwise(CUT)


def place(rows: DataFrame) -> DataFrame:
    """The rows in order of conversation and turn, cut into ranges: `place` grows in that order."""
    x = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                    *([F.col("n").cast("int").alias("n")] if "n" in rows.columns else [F.lit(1).alias("n")]))
    size = x.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("role")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    parts = 1 + max(size["bytes"] // BLOCK_BYTES, size["rows"] // BLOCK_ROWS)
    x = x.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("_row").asc()]
    return materialise(x.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row").withColumn("fault", _state_of_text(F.col("text")))
                       .withColumn("place", F.monotonically_increasing_id()), "turns")


def blocks(placed: DataFrame) -> DataFrame:
    """conv_id, first, codes: the rows of a conversation in one range as letters."""
    firsts = placed.where(F.col("fault") != BLANK).groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("seen_first"))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    rows = placed.select("conv_id", "place", "fault", "n", initial.alias("initial")).join(firsts, "place", "left")
    letter = lambda fault: F.char(F.lit(65) + F.col("initial") + 4 * fault)
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(COPY)
    one = F.when((F.col("fault") == BLANK) | F.col("seen_first").isNotNull(), F.col("fault")).otherwise(COPY)
    rows = rows.select("conv_id", "place", F.concat(letter(one), F.repeat(letter(again), F.col("n") - 1)).alias("codes"))
    return (rows.groupBy("conv_id", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "codes"))).alias("rows"))
            .select("conv_id", "first", F.array_join("rows.codes", "").alias("codes")))


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def solve(cut: DataFrame) -> DataFrame:
    """first, conv_id, codes, state, audit, before: every block with its state at the start and the letters of its edits."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    solver = Solver()

    def condense(batches):
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("first"), pa.array([c[-1:] for c in codes], pa.string()),
                                              pa.array([list(solver.matrix(c)) for c in codes], pa.list_(pa.int64()))], ["conv_id", "first", "ends", "matrix"])

    def choose(batches):
        conv, held = None, []

        def flush():
            states = solver.chain([m for _, _, m in held])
            return [(first, p, q, k == len(held) - 1, held[k - 1][1] if k else "") for k, ((first, _, _), p, q) in enumerate(zip(held, states, states[1:]))]
        names, types, out = ["first", "state", "until", "last", "before"], [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()], []
        for batch in batches:
            for c, first, ends, matrix in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and c != conv:
                    out += flush()
                    held = []
                    if len(out) > 5000:
                        yield _batches(out, names, types)
                        out = []
                conv = c
                held.append((first, ends, tuple(matrix)))
        out += flush() if held else []
        if out:
            yield _batches(out, names, types)

    def finish(batches):
        for batch in batches:
            audits = [solver.between(c, p, q) + (FINAL[q][1] if last else "") for c, p, q, last in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 6)), pa.array(audits, pa.string())], ["first", "conv_id", "codes", "state", "before", "audit"])
    matrices = cut.mapInArrow(condense, f"conv_id {kind}, first long, ends string, matrix array<long>")
    chosen = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(choose, "first long, state int, until int, last boolean, before string")
    return (cut.join(chosen, "first").select("first", "conv_id", "codes", "state", "until", "last", "before")
            .mapInArrow(finish, f"first long, conv_id {kind}, codes string, state int, before string, audit string"))


def apply_edits(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, edit, role, text: the edits of every conversation in order, deleted rows included.

    A partition holds whole conversations, each from its first row to its last; a task holds one batch of rows."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    both = (solved.select("conv_id", F.col("first").alias("place"), F.lit(0).alias("part"), "state", F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))
            .unionByName(placed.select("conv_id", "place", F.lit(1).alias("part"), F.lit(0).alias("state"), "role", "text", "n")))

    def walk(batches):
        out: list[tuple] = []
        size = 0
        conv, audit, at, state = None, "", 0, NOTHING

        def insertions():
            nonlocal at, state
            while audit[at:at + 1] == "I":
                at, state = at + 1, _INSERTED[state]
                out.append((conv, "I", _ROLE[state], ""))
        names, types = ["conv_id", "edit", "role", "text"], None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.string(), pa.string(), pa.string()]
            for c, part, s, role, text, n in zip(*(batch.column(k) for k in range(6))):
                if part.as_py() == 0:
                    insertions()
                    conv, audit, at, state = c.as_py(), role.as_py(), 0, s.as_py()
                    continue
                role, text = role.as_py(), text.as_py()
                for _ in range(n.as_py()):
                    insertions()
                    letter = audit[at]
                    at += 1
                    if letter == "K":
                        state = _KEPT[state, INITIALS.index(role[:1])]
                    elif letter == "R":
                        state = _INSERTED[state]
                    out.append((conv, letter, _ROLE[state] if letter == "R" else role, text))
                    size += len(text)
                if len(out) > 2000 or size > 1 << 20:
                    yield _batches(out, names, types)
                    out, size = [], 0
        insertions()
        if out:
            yield _batches(out, names, types)
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "part", "state", "role", "text", "n")
            .mapInArrow(walk, f"conv_id {kind}, edit string, role string, text string"))


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of edits in order."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def walk(batches):
        out, started, conv, audit, digest, lines = [], False, None, [], None, 0
        names, types = ["conv_id", "audit", "repaired_sha256"], None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.string(), pa.string()]
            for c, edit, role, text in zip(*(batch.column(k) for k in range(4))):
                c, edit = c.as_py(), edit.as_py()
                if not started or c != conv:
                    if started:
                        out.append((conv, "".join(audit), digest.hexdigest()))
                    started, conv, audit, digest, lines = True, c, [], hashlib.sha256(), 0
                audit.append(edit)
                if edit != "D":
                    digest.update(("\n" if lines else "").encode() + f"{role.as_py()}:".encode() + text.as_py().encode())
                    lines += 1
            if len(out) > 2000:
                yield _batches(out, names, types)
                out = []
        if started:
            out.append((conv, "".join(audit), digest.hexdigest()))
        if out:
            yield _batches(out, names, types)
    return edits.mapInArrow(walk, f"conv_id {kind}, audit string, repaired_sha256 string")


def faults(solved: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, by block."""
    kind = solved.schema["conv_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for codes, before, audit in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                kinds = [(ord(c) - 65) // 4 for c in codes]
                rows.append((kinds.count(BLANK), kinds.count(COPY), kinds.count(CUT), illegal_pairs(codes, before), cost_of(codes, audit)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost"])
    return solved.select("conv_id", "codes", "before", "audit").mapInArrow(count, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows as they were placed, the solved blocks, and the edits (conv_id, edit, role, text) of each conversation in order."""
    placed = place(rows)
    solved = materialise(solve(materialise(blocks(placed), "blocks")), "edits")
    return placed, solved, apply_edits(placed, solved)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that repair it, and a digest of what they give."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    placed, solved, edits = repair(damage(rows))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    texts = ["audit", "repaired_sha256"]
    turns = placed.where("turn is not null").groupBy("conv_id", "turn").agg(F.count("*")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    parts = [rows.select("conv_id").distinct(), turns, faults(solved), digests(edits)]
    filled = [p.select("conv_id", *[F.col(c) if c in p.columns else F.lit(None).cast("long").alias(c) for c in numbers],
                       *[F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in texts]) for p in parts]
    x = filled[0].unionByName(filled[1]).unionByName(filled[2]).unionByName(filled[3])
    return x.groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                    F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b))"
_WAYS = ", ".join(f"('{code}', {p}, {q}, {way[0]}, '{way[1]}')" for code, table in WAYS.items() for p in range(4) for q, way in enumerate(table[p]) if way)
OP11_SQL = fr"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS k FROM key, tab),
bad AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE k <> 0),
laid AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS left_text FROM bad),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM laid),
row_codes AS (SELECT conv_id, turn, role, text, i, CASE WHEN left_text = '' THEN 2 WHEN again THEN 3 WHEN left_text[-1] IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
  CASE role[1] WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial FROM seen),
ways(code, p, q, c, w) AS (VALUES {_WAYS}),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM row_codes)
  UNION ALL
  SELECT conv_id, i, q, m.cost, m.audit FROM (SELECT b.conv_id, r.i, w.q, min({{'cost': b.cost + w.c, 'audit': b.audit || w.w}}) AS m
    FROM best b JOIN row_codes r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN ways w ON w.code = chr(65 + r.initial + 4 * r.fault) AND w.p = b.q GROUP BY 1, 2, 3)),
n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM row_codes GROUP BY 1),
done AS (SELECT b.conv_id, min({{'cost': b.cost + CASE b.q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE b.q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS m
  FROM best b JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.i GROUP BY 1),
pairs AS (SELECT conv_id, count(*) FILTER (NOT coalesce(lag_initial || initial IN ('01', '12', '21'), true)) AS illegal
  FROM (SELECT conv_id, CAST(initial AS VARCHAR) AS initial, lag(CAST(initial AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY i) AS lag_initial FROM row_codes) GROUP BY 1),
letters AS (SELECT conv_id, j, m.audit[j] AS e, length(replace(m.audit[1:j], 'I', '')) AS i FROM (SELECT conv_id, m, unnest(range(1, length(m.audit) + 1)) AS j FROM done)),
stay AS (SELECT l.conv_id, l.j, l.e, r.role, CASE WHEN l.e = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS k,
  first_value(CASE WHEN l.e = 'K' AND r.initial = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.j) AS s
  FROM letters l LEFT JOIN row_codes r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.e <> 'I' WHERE l.e <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM stay GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(done.m.cost, 0) AS BIGINT) AS cost, coalesce(done.m.audit, '') AS audit, sha256(coalesce(lines.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id
"""
