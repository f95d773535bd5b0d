"""Conversation structure repair: cheapest edits to a grammar of turns.

A conversation's rows, in order of turn, become the cheapest sequence of role
initials ``(s?(ua)+)?`` by keeping rows (K, 0), giving them the role that is due
(R, 2), deleting them (D, 3; blank and duplicate rows must go) and inserting
empty turns (I, 2); a truncated row that stays costs 1 more. A backward pass
gives the cost-to-go of every grammar state behind every row; a forward walk from
the start takes, among the transitions that are tight to it, the ASCII-least
letter, which is the ASCII-least of all cheapest sequences, as each letter
leaves one state only.

On Spark: which (role, text) was seen earlier comes from an aggregation that
combines before its shuffle, joined back. Then one shuffle by conversation
brings each row twice: first its symbol alone, in falling order, for the backward
pass, which keeps the cost vector at every ``BLOCK`` rows or ``BLOCK_BYTES`` only; then the row, in
rising order, for the walk, block by block. So a task streams over conversations
of any length in the memory of one block, beside the audit it returns. One
conversation's digest and audit are one value of its whole text in order, which
only one task can compute.

Defined results: in every column but the id a null counts as one space, also in
the key that is hashed for damage; rows without an id are one conversation. Rows
go by turn (nulls first), then role, then SHA-256 of the text; equal rows stand
next to each other and all but the first are duplicates. A role's initial is its
first character, none for an empty role, which no state takes. A conversation of
which no row is left has zeros, an empty audit and the digest of the empty
string. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BLOCK, BLOCK_BYTES = 4096, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: at the start, behind a system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the due turn leads to, and its role.
DUE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept row leads to, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60
_MARK, _SYMBOL, _ROW = 0, 1, 2

Costs = tuple[int, int, int, int]


def with_inserts(costs: list[int]) -> Costs:
    c = list(costs)
    c[ASSISTANT] = min(c[ASSISTANT], INSERT + c[USER])
    c[USER] = min(c[USER], INSERT + c[ASSISTANT])
    for q in (START, SYSTEM):
        c[q] = min(c[q], INSERT + c[USER])
    return tuple(c)


AT_END = with_inserts([0, _FAR, _FAR, 0])


def row_costs(symbol: tuple[str, bool, bool], q: int, behind: Costs) -> dict[str, int]:
    """Cost of each edit of a row in state ``q``. ``symbol``: initial, must go, truncated."""
    initial, goes, cut = symbol
    out = {"D": DELETE + behind[q]}
    if not goes:
        to = KEPT.get(initial, {}).get(q)
        if to is not None:
            out["K"] = TRUNCATED * cut + behind[to]
        out["R"] = REROLE + TRUNCATED * cut + behind[DUE[q]]
    return out


def backward(symbol: tuple[str, bool, bool], behind: Costs) -> Costs:
    """Cost-to-go before a row, by that behind it."""
    return with_inserts([min(row_costs(symbol, q, behind).values()) for q in range(4)])


def walk(symbols: list[tuple[str, bool, bool]], q: int, behind: Costs, last: bool) -> Iterator[tuple[str, int, int]]:
    """(letter, row or -1, state) of the cheapest, then ASCII-least edits of
    ``symbols`` from state ``q``; ``last``: nothing comes behind them."""
    costs = [behind]
    for s in reversed(symbols):
        costs.append(backward(s, costs[-1]))
    costs.reverse()
    for i in range(len(symbols) + 1):
        while True:
            here = costs[i]
            if i == len(symbols):
                if not last or here[q] == 0:
                    break
                letter = "I"
            else:
                found = row_costs(symbols[i], q, costs[i + 1]) | {"I": INSERT + here[DUE[q]]}
                letter = min(k for k, c in found.items() if c == here[q])
            q = KEPT[symbols[i][0]][q] if letter == "K" else DUE[q] if letter in "RI" else q
            yield letter, -1 if letter == "I" else i, q
            if letter != "I":
                break


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, id_col: str, turn_col: str) -> DataFrame:
    """(id, turn, role, text, gone): ``rows`` with faults by a hash of their key; a
    dropped row stays as a mark."""
    own = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"))
    kind = F.crc32(F.concat_ws(":", spaced(F.col("id")), spaced(F.col("turn"))).cast("binary")) % 20
    own = own.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), twice.alias("copy")).drop("copy")


def undamaged(rows: DataFrame, id_col: str, turn_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), F.lit(False).alias("gone"))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with their text's digest, whether they are blank, seen in an earlier
    turn and truncated."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumns({"digest": F.sha2("text", 256), "blank": blank, "truncated": cut})
    here = F.struct(F.col("turn").isNotNull().alias("b"), F.coalesce("turn", F.lit(0).cast("long")).alias("t"))
    first = rows.where("not gone").groupBy("id", "role", "digest").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last")
    first = first.select(F.col("id").alias("f_id"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first")
    same = rows["id"].eqNullSafe(first["f_id"]) & (rows["role"] == first["f_role"]) & (rows["digest"] == first["f_digest"])
    return rows.join(first, same, "left").withColumn("seen", F.coalesce(F.col("first") < here, F.lit(False))).drop("f_id", "f_role", "f_digest", "first")


def streamed(rows: DataFrame) -> DataFrame:
    """Every row as mark, or as symbol and as row, by conversation: first marks,
    then symbols in falling order, then rows in rising order."""
    kinds = F.when(F.col("gone"), F.array(F.lit(_MARK))).otherwise(F.array(F.lit(_SYMBOL), F.lit(_ROW)))
    both = rows.withColumn("kind", F.explode(kinds)).withColumns({"size": F.octet_length("text"), "text": F.when(F.col("kind") == _ROW, F.col("text"))})
    order = ("turn", "role", "digest")
    symbol = F.col("kind") == _SYMBOL
    falling = [F.desc_nulls_last(F.when(symbol, F.col(c))) for c in order]
    rising = [F.asc_nulls_first(F.when(~symbol, F.col(c))) for c in order]
    return both.repartition("id").sortWithinPartitions("id", "kind", *falling, *rising).select("id", "kind", "turn", "role", "digest", "text", "blank", "seen", "truncated", "size")


class Conversation:
    """One conversation as its rows stream by. Symbols come first, from the last
    row to the first; a row equal to the one before it in rising order is known
    as such only when that one arrives, so one symbol is held back."""

    def __init__(self, key, emit: Callable[[list], None]):
        self.key, self.emit = key, emit
        self.count, self.held, self.vectors, self.behind = 0, None, [], AT_END
        self.since, self.bytes = 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.cost = self.done = 0
        self.low = self.high = self.before = self.first = None
        self.state, self.audit, self.hash, self.said, self.started = START, [], hashlib.sha256(), False, False
        self.rows = []

    def push(self, row, equal: bool):
        """A held symbol enters the backward pass."""
        self.behind = backward(self.symbol(row, equal), self.behind)
        self.count, self.since, self.bytes = self.count + 1, self.since + 1, self.bytes + row[-1]
        if self.since >= BLOCK or self.bytes >= BLOCK_BYTES:
            self.vectors.append((self.count, self.behind))
            self.since = self.bytes = 0

    @staticmethod
    def symbol(row, equal: bool) -> tuple[str, bool, bool]:
        _, role, _, _, blank, seen, cut, _ = row
        return role[:1], blank or seen or equal, cut

    def add_symbol(self, row):
        if self.held is not None:
            self.push(self.held, self.held[:3] == row[:3])
        self.held = row

    def start(self):
        if self.held is not None:
            self.push(self.held, False)
            self.held = None
        self.started, self.cost, self.left = True, self.behind[START] if self.count else 0, self.count
        self.vectors = [(0, AT_END), *(v for v in self.vectors if v[0] < self.count)]

    def add_row(self, row):
        if not self.started:
            self.start()
        turn, role, _, text, blank, seen, cut, _ = row
        equal = self.before is not None and self.before == row[:3]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high is None or turn != self.high
            self.high = turn
        again = not blank and (seen or equal)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + (cut and not blank and not again)
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = row[:3]
        self.rows.append((self.symbol(row, equal), role, text))
        self.left -= 1
        if self.left == self.vectors[-1][0]:
            self.flush()

    def flush(self):
        """Walks a block whose cost vector behind it is the last one kept."""
        at, behind = self.vectors.pop()
        for letter, i, self.state in walk([r[0] for r in self.rows], self.state, behind, at == 0):
            self.audit.append(letter)
            if letter != "D":
                role = self.rows[i][1] if letter == "K" else ROLES[self.state]
                text = self.rows[i][2] if i >= 0 else ""
                self.hash.update((f"\n{role}:{text}" if self.said else f"{role}:{text}").encode())
                self.said = True
                self.emit([self.key, self.done, letter, role, text])
                self.done += 1
        self.rows = []

    def report(self) -> list:
        gaps = min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1) if self.high is not None else 0
        return [self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def conversations(rows: DataFrame, schema: str, turns: bool) -> DataFrame:
    """The stream's rebuilt turns, or one report of each conversation."""
    struct = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema, out, own, weight = to_arrow_schema(struct), [], None, 0

        def emit(record: list):
            nonlocal weight
            if turns:
                out.append(record)
                weight += len(record[-1])

        def batch_out() -> pa.RecordBatch:
            nonlocal weight
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(out_schema)], schema=out_schema)
            out.clear()
            weight = 0
            return made

        def ended():
            nonlocal weight
            if own is not None and not turns:
                out.append(own.report())
                weight += len(out[-1][-2])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, kind, *row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                    if own is None or key != own.key:
                        ended()
                        own = Conversation(key, emit)
                    if kind == _SYMBOL:
                        own.add_symbol(row)
                    elif kind == _ROW:
                        own.add_row(row)
                    if len(out) >= BLOCK or weight > BLOCK_BYTES:
                        yield batch_out()
        ended()
        if out:
            yield batch_out()

    return rows.mapInArrow(run, struct)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", damage: bool = True, turns: bool = False) -> DataFrame:
    """One report of every conversation of ``rows`` (id, turn, role, text): gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; or, with
    ``turns``, its rebuilt turns (id, pos, edit, role, text). ``damage`` plants
    faults first."""
    kind = rows.schema[id_col].dataType.simpleString()
    own = (damaged if damage else undamaged)(rows.withColumn(turn_col, F.col(turn_col).cast("long")), id_col, turn_col)
    if turns:
        schema = f"`{id_col}` {kind}, pos long, edit string, role string, text string"
    else:
        schema = f"`{id_col}` {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return conversations(streamed(judged(own)), schema, turns)


def oracle_sql() -> str:
    """The same reports as DuckDB SQL over ids that are not null: CRC-32 as a fold over
    a key's bytes, one recursion for the cost-to-go and one for the walk."""
    step = "(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    cost = lambda q, keep, due: f"least({DELETE} + c{q}, CASE WHEN goes THEN 1000000000 ELSE least({REROLE} + cut + c{due}, {keep}) END)"
    kept = lambda *cases: "CASE r " + " ".join(f"WHEN '{r}' THEN cut + c{to}" for r, to in cases) + " ELSE 1000000000 END"
    raw = ", ".join(f"{x} AS x{q}" for q, x in enumerate((cost(0, kept(("s", 1), ("u", 2)), 2), cost(1, kept(("u", 2)), 2), cost(2, kept(("a", 3)), 3), cost(3, kept(("u", 2)), 2))))
    return rf"""WITH RECURSIVE
crc AS (SELECT i, 0 AS n, i AS c FROM range(256) AS r(i) UNION ALL SELECT i, n + 1, {step} FROM crc WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE n = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT) AS x FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), 4294967295), 4294967295) % 20 AS kind FROM k, tab),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM e),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, (NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$'))::INT AS cut, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, blank OR seen AS goes FROM f),
sizes AS (SELECT conv_id, count(*) AS n FROM g GROUP BY conv_id),
c AS (SELECT conv_id, n AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM sizes
 UNION ALL SELECT conv_id, i, least(x0, {INSERT} + least(x2, {INSERT} + least(x3, {INSERT} + x2))), least(x1, {INSERT} + least(x2, {INSERT} + least(x3, {INSERT} + x2))), least(x2, {INSERT} + least(x3, {INSERT} + x2)), least(x3, {INSERT} + x2)
 FROM (SELECT c.conv_id, c.i - 1 AS i, {raw} FROM c JOIN g ON g.conv_id = c.conv_id AND g.i = c.i)),
h AS (SELECT c.conv_id, c.i, [c0, c1, c2, c3] AS here, lead([c0, c1, c2, c3]) OVER (PARTITION BY c.conv_id ORDER BY c.i) AS next, role, text, goes, cut, r FROM c LEFT JOIN g ON g.conv_id = c.conv_id AND g.i = c.i + 1),
w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS said FROM sizes
 UNION ALL SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept ELSE due END, audit || letter,
 CASE letter WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE due WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
 FROM (SELECT *, CASE WHEN next IS NOT NULL AND {DELETE} + next[q + 1] = here[q + 1] THEN 'D' WHEN {INSERT} + here[due + 1] = here[q + 1] THEN 'I' WHEN NOT goes AND kept IS NOT NULL AND cut + next[kept + 1] = here[q + 1] THEN 'K' ELSE 'R' END AS letter
  FROM (SELECT w.conv_id, w.i, w.q, w.audit, w.said, here, next, role, text, goes, cut, CASE WHEN q = 2 THEN 3 ELSE 2 END AS due, CASE WHEN r = 's' AND q = 0 THEN 1 WHEN r = 'u' AND q <> 2 THEN 2 WHEN r = 'a' AND q = 2 THEN 3 END AS kept FROM w JOIN h ON h.conv_id = w.conv_id AND h.i = w.i)
  WHERE next IS NOT NULL OR here[q + 1] > 0)),
ends AS (SELECT w.conv_id, audit, said FROM w JOIN sizes USING (conv_id) JOIN h ON h.conv_id = w.conv_id AND h.i = w.i WHERE w.i = n AND here[q + 1] = 0),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut = 1 AND NOT goes) AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id) LEFT JOIN (SELECT conv_id, c0 FROM c WHERE i = 0) AS z USING (conv_id)"""
