"""Operator 4: token counts with a whole-token shortcut.

Offline proof, once per worker, from the vocabulary alone:

* A merge joins two neighbours only if their concatenation is a piece, so two
  characters that are neighbours in no piece never end in one token. If no
  piece holds U+2581 after another character, a text falls apart into
  pre-tokens ``U+2581+ other*`` that encode independently of each other.
* Every piece that starts with U+2581 is encoded alone; those that give one
  token are the whole tokens, counted without any merging.

Other pre-tokens go through the library, each distinct one once per slice.

Defined results: null or empty text has 0 bytes and 0 tokens; a very long text
is counted whole; an empty table has no rows; repeated rows
and ids each give a row; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gavel.llm.common import map_slices

MARK = "▁"
#: Distinct pre-tokens whose counts a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that isn't empty, without their first mark."""
    if MARK not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]


class PieceCounter:
    """Counts the tokens of texts as the library does."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        self.splits = not any(b == MARK != a for p in pieces for a, b in zip(p, p[1:], strict=False))
        # the normalizer must add one mark in front and keep white space, else whole texts go to the library
        self.splits &= self._ids("a") == self._ids(MARK + "a", raw=True) and len(self._text("a  b ")) == 6
        own = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        self.whole = {w: 1 for w, ids in zip(own, self.sp.encode(own, num_threads=1), strict=True) if len(ids) == 1}
        self.whole[""] = 1  # a single mark: one piece of its own, not reachable as a whole text
        self.known = dict(self.whole)

    def _text(self, s: str) -> str:
        return "".join(self.sp.encode(s, out_type=str, num_threads=1))

    def _ids(self, s: str, raw: bool = False) -> list[int]:
        ids = self.sp.encode(s, num_threads=1)
        return ids if not raw else [self.sp.piece_to_id(s)] if self.sp.piece_to_id(s) != self.sp.unk_id() else ids

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        cut = [pre_tokens(t) if t else [] for t in texts]
        known = self.known
        rest = list({w for words in cut for w in words if w not in known})
        lengths = dict(zip(rest, map(len, self.sp.encode(rest, num_threads=1)), strict=True)) if rest else {}
        if len(known) + len(rest) > REMEMBERED:
            known = self.known = dict(self.whole)
        if any(len(w) > LONGEST for w in rest):
            both = known | lengths
            known.update((w, n) for w, n in lengths.items() if len(w) <= LONGEST)
        else:
            known.update(lengths)
            both = known
        try:
            return [sum(map(both.__getitem__, words)) for words in cut]
        except KeyError:  # the memory was just emptied
            more = list({w for words in cut for w in words if w not in both})
            both = both | dict(zip(more, map(len, self.sp.encode(more, num_threads=1)), strict=True))
            return [sum(map(both.__getitem__, words)) for words in cut]


@cache
def counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether tokens exceed the limit."""
    path = model or default_model()

    def make():
        count = counter(path).count

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = count(texts)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return run

    return map_slices(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, SCHEMA)
