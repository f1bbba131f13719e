"""Byte-level byte-pair encoding of one text: alphabet, vocabulary, merges, decoding. gavel.operators.tokenizer does tables."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.text import PRE_TOKEN, marker_pattern

CONTROL, USER_DEFINED = 3, 4


def _shown(b: int) -> str:
    """The visible stand-in of a byte."""
    if b <= 0x20:
        return chr(b + 0x100)
    if 0x7F <= b <= 0xA0:
        return chr(b + 0xA2)
    return "Ń" if b == 0xAD else chr(b)


ALPHABET = [_shown(b) for b in range(256)]
BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}


def to_alphabet(text: str) -> str:
    return text.encode().decode("latin-1").translate({b: c for b, c in enumerate(ALPHABET)})


def from_alphabet(piece: str) -> bytes:
    """The bytes of a piece; U+2581 is a space, other characters are their own UTF-8."""
    return b"".join(b" " if c == "▁" else bytes([BYTE_OF[c]]) if c in BYTE_OF else c.encode() for c in piece)


_MOVED = [b for b in range(256) if ALPHABET[b] != chr(b)]
_RAW, _SHOWN = "".join(map(chr, _MOVED)), "".join(ALPHABET[b] for b in _MOVED)
#: A character that stands for no byte, in a pattern.
_OTHER = r"[^!-~\x{a1}-\x{ac}\x{ae}-\x{143}]"


def shown(text: Column | str) -> Column:
    """UTF-8 bytes as characters of the byte alphabet."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _RAW, _SHOWN)


byte_encoded = shown


def raw_hex(piece: Column | str) -> Column:
    """Hex digits of the bytes of a vocabulary piece: U+2581 is a space, characters outside the alphabet are their own UTF-8."""
    own = "".join(sorted(ALPHABET))  # translate() drops what it would turn into byte 0, so that is told apart

    def one(c: Column) -> Column:
        known = F.instr(F.lit(own), c) > 0
        return F.when(c == "▁", "20").when(c == ALPHABET[0], "00").when(known, F.hex(F.encode(F.translate(c, _SHOWN, _RAW), "ISO-8859-1"))).otherwise(F.hex(F.encode(c, "UTF-8")))

    col = F.col(piece) if isinstance(piece, str) else piece
    return F.when(col == "", "").otherwise(F.array_join(F.transform(F.split(col, ""), one), ""))


def byte_decoded(piece: Column | str) -> Column:
    """The text of a piece or of a whole text in the byte alphabet; what is not UTF-8 becomes U+FFFD."""
    col = F.col(piece) if isinstance(piece, str) else piece
    runs = F.transform(F.split(F.replace(col, F.lit("▁"), F.lit(" ")), ALPHABET[0]), lambda s: F.translate(s, _SHOWN, _RAW))
    # a text of the alphabet's characters alone is turned at once, others a character at a time
    plain = ~F.replace(col, F.lit("▁"), F.lit(ALPHABET[32])).rlike(_OTHER)
    raw = F.when(plain, F.encode(F.array_join(runs, "\0"), "ISO-8859-1")).otherwise(F.unhex(raw_hex(col)))
    return F.make_valid_utf8(raw.cast("string"))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their types, merges by rank, and the ids that begin and end a sequence."""

    pieces: tuple[str, ...]
    types: tuple[int, ...]
    merges: tuple[tuple[str, str], ...]
    bos: int = 1
    eos: int = 2
    add_bos: bool = True
    add_eos: bool = False
    more_eos: tuple[int, ...] = ()
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @cached_property
    def ids(self) -> dict[str, int]:
        """The lowest id of each piece."""
        return {p: i for i, p in reversed(list(enumerate(self.pieces)))}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {m: r for r, m in reversed(list(enumerate(self.merges)))}

    @cached_property
    def markers(self) -> tuple[str, ...]:
        own = {p for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if p and (t in (CONTROL, USER_DEFINED) or i in self.ends)}
        return tuple(sorted(own, key=lambda m: (-len(m), m)))

    @cached_property
    def ends(self) -> tuple[int, ...]:
        return tuple(dict.fromkeys((self.eos, *self.more_eos)))

    def lookup(self, piece: str) -> int:
        return self.ids.get(piece, -1)

    def merge(self, piece: str) -> list[int]:
        """Ids of a piece: its own, or those of its symbols after all merges; symbols without an id are dropped."""
        return [self.ids[piece]] if piece in self.ids else [self.ids[s] for s in self.merged(list(piece)) if s in self.ids]

    def merged(self, symbol: list[str | None]) -> list[str]:
        """Merge the lowest rank first, leftmost of equals."""
        left, right = list(range(-1, len(symbol) - 1)), [*range(1, len(symbol)), -1]
        queue: list[tuple[int, int, str, str]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rank := self.ranks.get((symbol[i], symbol[j]))) is not None and symbol[i] + symbol[j] in self.ids:
                heapq.heappush(queue, (rank, i, symbol[i], symbol[j]))

        for i in range(len(symbol) - 1):
            push(i, i + 1)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i] if symbol[i] == a else -1
            if j < 0 or symbol[j] != b:
                continue  # one of them went into another merge
            symbol[i], symbol[j] = a + b, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(left[i], i)
            push(i, right[i])
        return [s for s in symbol if s is not None]

    def encode(self, text: str, special: bool = True) -> list[int]:
        """One text on one machine."""
        import regex

        out = [self.bos] if special and self.add_bos else []
        parts = re.split(f"({marker_pattern(self.markers)})", text) if self.markers else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.ids[part])
                continue
            for piece in regex.findall(PRE_TOKEN, part):
                if piece not in self._memo:
                    if len(self._memo) > 100_000:
                        self._memo.clear()
                    self._memo[piece] = self.merge(to_alphabet(piece))
                out += self._memo[piece]
        return out + ([self.eos] if special and self.add_eos else [])

    def decode(self, ids: list[int], special: bool = False) -> str:
        out = b""
        for i in ids:
            if not 0 <= i < len(self.pieces):
                raise ValueError(f"no token {i}")
            marker = self.types[i] in (CONTROL, USER_DEFINED)
            out += (self.pieces[i].encode() if special else b"") if marker else from_alphabet(self.pieces[i])
        return out.decode("utf-8", "replace")


def derive_merges(pieces: list[str]) -> list[tuple[str, str]]:
    """Merges of a vocabulary in rank order: a piece that the earlier ones split in two is the merge of these."""
    rank = {p: i for i, p in enumerate(pieces)}
    out = []
    for i, p in enumerate(pieces):
        parts = list(p)
        while len(parts) > 2:
            best = min(((rank.get(a + b, i), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(i, 0))
            if best[0] >= i:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def tiny_vocabulary(extra: tuple[str, ...] = ("yes", "no", "Yes", "No", " yes", " no", "he", "er", "in", "th", "the", " the", "on", "an")) -> Vocabulary:
    """Bytes, the prompt's markers, and merges that build a few words: enough for tests without a published vocabulary."""
    special = ("<unk>", "<s>", "</s>", "[INST]", "[/INST]", "[IMG]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]")
    words: list[str] = []
    for w in map(to_alphabet, extra):
        for n in range(2, len(w) + 1):
            if w[:n] not in words:
                words.append(w[:n])
    plain = [*ALPHABET, *words]
    return Vocabulary((*special, *plain), (2, *[CONTROL] * (len(special) - 1), *[1] * len(plain)), tuple((w[:-1], w[-1]) for w in words))
