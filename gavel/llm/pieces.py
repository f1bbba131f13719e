"""Operator 7: SentencePiece encoding and decoding by an Aho-Corasick Viterbi pass.

All pieces go into one Aho-Corasick automaton. A single pass over a text
follows its states; at every position the output links list the pieces that end
there, longest first, and each relaxes the best score of its end from that of
its start, so the best segmentation is known after one pass. A character that
no piece covers becomes its UTF-8 byte pieces, at a score below all others.
Of equal scores the one with the longer last piece stays.

A white-space mark never follows another character inside a piece (proved from
the vocabulary), so a best segmentation of a text is made of those of its
pre-tokens ``mark+ other*``, and each distinct pre-token is segmented once.

Decoding joins the pieces, turns marks into spaces and byte pieces into
characters (invalid ones into U+FFFD) and drops the space added in front.

Defined results: null and empty texts have no tokens and decode to empty;
U+2581 in a text decodes to a space (round_trip false); a very long text is segmented whole; an empty table has no rows; repeated rows each give
a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from gavel.llm.common import map_slices
from gavel.llm.token_counts import LONGEST, MARK, default_model, pre_tokens

#: Distinct pre-tokens whose segmentations a worker remembers.
REMEMBERED = 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, token_ids array<int>, round_trip boolean"


class PieceModel:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.below = min(self.score.values()) - 10
        self.splits = not any(b == MARK != a for p in self.score for a, b in zip(p, p[1:], strict=False))
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            p = self.pieces[i]
            self.automaton.add_word(p, (len(p), sp.get_score(i), i))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])

    def fallback(self, c: str) -> list[int]:
        raw = c.encode()
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def viterbi(self, s: str) -> list[int]:
        """The ids of the best segmentation of s, which already holds its marks."""
        n, below = len(s), self.below
        best, length, piece = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        end = 0
        for i, (size, score, own) in self.automaton.iter(s):
            if i >= end:  # the first and longest piece that ends here
                for at in range(end + 1, i + 2):
                    best[at] = best[at - 1] + below
                end = i + 1
            x = best[end - size] + score
            if x >= best[end] and (x > best[end] or piece[end] < 0):
                best[end], length[end], piece[end] = x, size, own
        out: list[int] = []
        at = n
        while at:
            i = piece[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.fallback(s[at - 1])[::-1])
            at -= length[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.splits:
            return self.viterbi(MARK + text.replace(" ", MARK))
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = {}
        words = pre_tokens(text)
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:
            pass
        out: list[int] = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = tuple(self.viterbi(MARK + w))
                if len(w) <= LONGEST:
                    known[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


@cache
def piece_model(model: str) -> PieceModel:
    return PieceModel(model)


def digest(ids: list[int]) -> str:
    """SHA-256 of the ids as little-endian 32-bit numbers."""
    return hashlib.sha256(array("i", ids).tobytes()).hexdigest()


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, token_ids, round_trip (decoding gives the text again)."""
    path = model or default_model()

    def make():
        m = piece_model(path)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = [array("i", m.encode(t)) for t in texts]
            cut = [0]
            for x in ids:
                cut.append(cut[-1] + len(x))
            flat = array("i")
            for x in ids:
                flat.extend(x)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            return pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), lists, pa.array([m.decode(x) == t for x, t in zip(ids, texts, strict=True)])],
                names=["doc_id", "n_bytes", "n_tokens", "token_ids", "round_trip"],
            )

        return run

    return map_slices(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, SCHEMA)


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, token_ids) back to (doc_id, text)."""
    path = model or default_model()

    def run(batches):
        m = piece_model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
