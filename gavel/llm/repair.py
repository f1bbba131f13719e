"""Operator 11: repair of conversation structure by error-correcting Earley parsing.

The grammar of role sequences is weighted: a turn is kept (0), given the role that stands there (rerole, 1), deleted (2)
or put in (insert, 5). It is left-linear, so every chart item starts at the first turn and a set has at most one item for
each dotted production::

    None   -> . | None delete                            nothing kept yet
    System -> None keep(s) | System delete
    User   -> (None | System | Answer) user | User delete
    Answer -> User answer | Answer delete
    Goal   -> None | Answer
    user   -> keep(u) | rerole | insert                  answer -> keep(a) | rerole | insert

A chart item holds the minimum (cost, audit) of its symbol, where the audit is the string of the edits' initials, and the
running digest of what that repair has put out. Audits of equal cost are compared as strings; of two audits that reach the
same item none is the start of the other at equal cost, so the least stays least whatever follows. The completed chart yields the repair.

Spark deals the turns by conversation and sorts them; a task then reads its turns once, in order. Of a conversation it holds
four items, the audits (one letter a turn, the size of the result's cell) and a digest of each differing turn, no texts; so a conversation that
holds a third of all rows streams through a task, as the digest of its repaired text in order asks for.

Defined results: a null role or text is one space; rows of a null conv_id are a conversation of their own; null turns come first, rows of the same turn are
ordered by role and text; a role is told by its first character, and one that is empty or not of s, u, a can only be given
another or deleted; a conversation whose turns were all dropped has zeros, an empty audit and the digest of nothing; an
empty table has no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import batch_of

#: Costs of the edits, and of a truncated turn that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Letters of a block of an audit; blocks are shared by the items that grew from the same one.
BLOCK = 4096
NAMES = {"u": "user", "a": "assistant"}
#: symbol -> symbols that may stand before it and the role that follows them there
BEFORE = {"System": ("None",), "User": ("None", "System", "Answer"), "Answer": ("User",)}
ROLE = {"System": "s", "User": "u", "Answer": "a"}
GOAL = ("None", "Answer")
LEGAL = {"su", "ua", "au"}
SCHEMA = (
    "conv_id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, opens string, repaired_sha256 string"
)
EDITS = "conv_id long, old long, place long, edit string, given string"
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


class Item:
    """A chart item: cost, audit as (blocks, tail), the first role it put out, and the digest of all it put out."""

    __slots__ = ("blocks", "cost", "opens", "sha", "tail")

    def __init__(self, cost=0, blocks=None, tail="", opens=None, sha=None):
        self.cost, self.blocks, self.tail, self.opens, self.sha = cost, blocks, tail, opens, sha or hashlib.sha256()

    def audit(self) -> str:
        parts, b = [self.tail], self.blocks
        while b:
            parts.append(b[1])
            b = b[0]
        return "".join(reversed(parts))


def _less(a: tuple, b: tuple) -> bool:
    """Whether edit a, (cost, item before, letter, ...), gives a smaller (cost, audit) than b."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y = a[1], b[1]
    if x.blocks is y.blocks:
        return x.tail + a[2] < y.tail + b[2]
    xs, ys, p, q = [x.tail + a[2]], [y.tail + b[2]], x.blocks, y.blocks
    while p is not q:  # up to the block they share
        i, j = p[2] if p else 0, q[2] if q else 0
        if i >= j:
            xs.append(p[1])
            p = p[0]
        if j >= i:
            ys.append(q[1])
            q = q[0]
    return "".join(reversed(xs)) < "".join(reversed(ys))


def _made(edit: tuple) -> Item:
    """The item an edit leads to."""
    cost, item, letter, role, text = edit
    blocks, tail, sha, opens = item.blocks, item.tail + letter, item.sha, item.opens
    if len(tail) == BLOCK:
        blocks, tail = (blocks, tail, (blocks[2] if blocks else 0) + 1), ""
    if role is not None:
        sha = sha.copy()
        sha.update(f"{'' if opens is None else chr(10)}{role}:{text}".encode())
        opens = role if opens is None else opens
    return Item(cost, blocks, tail, opens, sha)


def _least(edits: list[tuple]) -> tuple | None:
    best = None
    for e in edits:
        if best is None or _less(e, best):
            best = e
    return best


def inserted(chart: dict[str, Item]) -> dict[str, Item]:
    """Predict and complete inside one set: symbols that an insertion reaches, until none gets cheaper."""
    chart, work = dict(chart), ["User", "Answer"]
    while work:
        symbol = work.pop(0)
        edits = [(chart[p].cost + INSERT, chart[p], "I", NAMES[ROLE[symbol]], "") for p in BEFORE[symbol] if p in chart]
        best = _least(edits)
        if best and (symbol not in chart or _less(best, (chart[symbol].cost, chart[symbol], ""))):
            chart[symbol] = _made(best)
            work += [s for s in ("User", "Answer") if symbol in BEFORE[s] and s not in work]
    return chart


def scanned(chart: dict[str, Item], role: str, text: str, must_go: bool, truncated: bool) -> dict[str, Item]:
    """Scan one turn: the next set's symbols with their least (cost, audit)."""
    initial, more = role[:1], TRUNCATED if truncated else 0
    out = {}
    for symbol in ("None", "System", "User", "Answer"):
        edits = [(chart[symbol].cost + DELETE, chart[symbol], "D", None, "")] if symbol in chart else []
        for p in () if must_go else BEFORE.get(symbol, ()):
            if p not in chart:
                continue
            if initial == ROLE[symbol]:
                edits.append((chart[p].cost + KEEP + more, chart[p], "K", role, text))
            elif symbol != "System":
                edits.append((chart[p].cost + REROLE + more, chart[p], "R", NAMES[ROLE[symbol]], text))
        best = _least(edits)
        if best:
            out[symbol] = _made(best)
    return out


class Conversation:
    """Reads the turns of one conversation in order."""

    def __init__(self):
        self.chart, self.seen = {"None": Item()}, set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.distinct = 0
        self.first = self.last = self.before = None

    def read(self, turn: int | None, role: str, text: str) -> None:
        self.turns += 1
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        raw = role.encode()
        key = hashlib.blake2b(len(raw).to_bytes(8, "big") + raw + text.encode(), digest_size=16).digest()
        again = key in self.seen
        self.seen.add(key)
        last = text.rstrip(_SPACE)[-1:]
        blank, cut = not last, last not in ("", ".", "!", "?")
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not again
        self.chart = scanned(inserted(self.chart), role, text, blank or again, cut)

    def row(self, conv_id: int | None) -> tuple:
        chart = inserted(self.chart)
        best = _least([(chart[s].cost, chart[s], "") for s in GOAL if s in chart])[1]
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return conv_id, self.turns, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit(), best.opens, best.sha.hexdigest()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, now, out = (), None, []
    for batch in batches:
        for conv_id, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (conv_id,):
                if now:
                    out.append(now.row(at[0]))
                at, now = (conv_id,), Conversation()
            if not dropped:
                now.read(turn, role, text)
        if len(out) >= 2000:
            yield batch_of(out, SCHEMA)
            out = []
    if now:
        out.append(now.row(at[0]))
    if out:
        yield batch_of(out, SCHEMA)


def _turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) with nulls as one space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, F.col("dropped").alias("dropped") if "dropped" in df.columns else F.lit(False).alias("dropped"))


def damaged(df: DataFrame) -> DataFrame:
    """Damage by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without its stops, repeated, or said by the user.

    A dropped turn stays as a row with dropped = true and no text, so that its conversation is still known.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    df = _turns(df.select("conv_id", "turn", "role", "text")).withColumn("kind", kind)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    out = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, and cost, audit and digest of its cheapest repair. turns: conv_id, turn, role, text, and dropped if there."""
    rows = _turns(turns)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_stream, SCHEMA)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit that leaves a turn: the place of its turn before (null: put in) and after, its letter and new role (null: kept)."""
    for batch in batches:
        for conv_id, audit, opens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = new = 0
            shift = (opens or "").startswith("s")
            for a in range(0, len(audit), 1 << 16):
                rows = []
                for letter in audit[a : a + (1 << 16)]:
                    old += letter != "I"
                    if letter != "D":
                        new += 1
                        rows.append((conv_id, None if letter == "I" else old, new, letter, None if letter == "K" else NAMES["ua"[(new - shift) % 2 == 0]]))
                if rows:
                    yield batch_of(rows, EDITS)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 1), role, text, edit (K, R or I). repairs: what repair(turns) gave."""
    rows = _turns(turns).filter("not dropped")
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").alias("c"), F.row_number().over(own).cast("long").alias("n"), "role", "text")
    edits = repairs.select("conv_id", "audit", "opens").mapInArrow(_edits, EDITS)
    joined = edits.join(rows, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("old") == F.col("n")), "left")
    return joined.select("conv_id", "place", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII string (polynomial EDB88320, a bit at a time)."""
    bits = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _oracle() -> str:
    """The query in SQL: the four symbols of a set, each with (cost, audit, text), folded along each conversation's turns."""

    def put(p: str, cost: str | int, letter: str, role: str = "", text: str = "''") -> str:
        said = f" || chr(10) || {role} || ':' || {text}" if role else ""
        return f"{{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}', 't': {p}.t{said}}}"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    def let(name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def closed(value: str) -> str:
        user = least("y.u", *(put(f"y.{p}", INSERT, "I", "'user'") for p in "nsa"))
        answer = least("z.a", put("z.u", INSERT, "I", "'assistant'"))
        return let("z", let("y", value, f"{{'n': y.n, 's': y.s, 'u': {user}, 'a': y.a}}"), f"{{'n': z.n, 's': z.s, 'u': z.u, 'a': {answer}}}")

    far, more = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}", f"(case when x.cut then {TRUNCATED} else 0 end)"

    def kept(p: str, role: str) -> str:
        return f"case when x.role[1] = '{role}' and not x.gone then {put(f'm.{p}', more, 'K', 'x.role', 'x.text')} else {far} end"

    def given(p: str, role: str) -> str:
        name = f"'{NAMES[role]}'"
        return f"case when x.gone then {far} else {put(f'm.{p}', f'{REROLE} + {more}', 'R', name, 'x.text')} end"

    gone = {p: put(f"m.{p}", DELETE, "D") for p in "nsua"}
    user = least(gone["u"], *(kept(p, "u") for p in "nsa"), *(given(p, "u") for p in "nsa"))
    scan = f"{{'n': {gone['n']}, 's': {least(gone['s'], kept('n', 's'))}, 'u': {user}, 'a': {least(gone['a'], kept('u', 'a'), given('u', 'a'))}}}"
    start = f"{{'n': {{'c': 0::BIGINT, 'a': '', 't': ''}}, 's': {far}, 'u': {far}, 'a': {far}}}"
    step = f"lambda p, x: {{'st': {let('m', closed('p.st'), scan)}, 'role': x.role, 'text': x.text, 'gone': x.gone, 'cut': x.cut}}"
    folded = f"list_reduce(turns, {step}, {{'st': {start}, 'role': '', 'text': '', 'gone': false, 'cut': false}}).st"
    order, ids = "turn nulls first, role, text", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
with d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql(ids)} % 20 as kind from conversations),
e as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [1, 2] else [1] end) as copy from d where kind != 0),
f as (select *, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as ending,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
        lag(role[1]) over (partition by conv_id order by {order}) || role[1] not in ('su', 'ua', 'au') as odd from e),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::BIGINT as gaps, count(*) filter (ending = '') as blank,
        count(*) filter (ending != '' and again) as duplicate, count(*) filter (not again and ending not in ('', '.', '!', '?')) as truncated, count(*) filter (odd) as illegal,
        list({{'st': {start}, 'role': role, 'text': text, 'gone': ending = '' or again, 'cut': ending not in ('', '.', '!', '?')}} order by {order}, again) as turns
        from f group by conv_id),
h as (select * exclude (turns), {let("q", closed(folded), least("q.n", "q.a"))} as best from g)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::BIGINT as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join h on i.conv_id is not distinct from h.conv_id"""


ORACLE = _oracle()
