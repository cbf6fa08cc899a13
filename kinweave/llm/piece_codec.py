"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A merge-type model joins the adjacent pair of the best score (the leftmost of equals) until no pair is a piece. The result is
the one sequence of pieces in which every adjacent pair, merged anew from its characters, comes out as that pair. It is found
left to right: an Aho-Corasick automaton gives the longest piece at each place, a piece is taken if it is compatible with the
one before it, otherwise the next shorter piece that starts there is tried, and a place from which nothing leads on is marked
in a bitfield so that it is never entered again.

No piece has the space mark after another character, so texts fall apart before runs of spaces and each distinct chunk is
encoded and decoded once while it stays in the cache. Characters outside the vocabulary become their bytes.

Edge cases: null text is empty, and an empty text is the begin and end ids alone and decodes to empty; rows with null doc_id
are coded too; repeated rows give repeated results; very long texts, with spaces or without, are coded whole; of merges with equal
scores the leftmost comes first; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import BoundedCache, id_and_text

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"


class PieceCodec:
    """encode(text) and decode(ids) of a merge-type model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)  # reads the vocabulary; it encodes nothing here
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.text_of: list[str | None] = []
        self.byte_of: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text_of.append("" if model.is_control(i) else piece)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id_of[piece] = model.get_score(i), i
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.widest = max(map(len, self.id_of))
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.single = {c for p in self.id_of for c in p}
        if not all(c in self.id_of for c in self.single) or any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a vocabulary whose chunks can't be coded apart")
        self.automaton = ahocorasick.Automaton()
        reachable = [p for p in self.id_of if len(p) == 1 or self._merge(p) == [p]]
        for p in reachable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = set(reachable)
        # The automaton tells how far a text follows a path of its trie; this is the longest piece on each path.
        self.longest: dict[str, str] = {}
        for p in reachable:
            for k in range(1, len(p) + 1):
                if p[:k] not in self.longest:
                    self.longest[p[:k]] = p[:k] if p[:k] in known else self.longest[p[: k - 1]]
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in reachable}
        self.fits = BoundedCache(lambda pair: self._merge(pair[0] + pair[1]) == [*pair], 400_000)
        self.chunks = BoundedCache(self._chunk, limit)

    def _merge(self, text: str) -> list[str]:
        """Merging by the definition; only for a piece, or for two adjacent ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _run(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        out: list[str] = []
        fits, shorter, longest, reach = self.fits, self.shorter, self.longest, self.automaton.longest_prefix
        failed, at, last, n = 0, 0, None, len(text)
        piece = longest[text[: reach(text)]]
        while True:
            stop = at + len(piece)
            if not failed >> stop & 1 and (last is None or fits[last, piece]):
                out.append(piece)
                if stop == n:
                    return out
                at, last = stop, piece
                rest = text[at : at + self.widest] if n - at > self.widest else text[at:]
                piece = longest[rest[: reach(rest)]]
                continue
            piece = shorter[piece]
            while piece is None:  # nothing starts here: mark the place and shorten the piece that led to it
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
                piece = shorter[piece]

    def _chunk(self, key: str) -> tuple[bytes, str]:
        """Ids and surface of a space mark and key."""
        end = len(key)
        while end > 1 and key[end - 2 : end] not in self.inside:  # no piece holds these two: the last character stands alone
            end -= 1
        if end < len(key):
            ids, surface = self.chunks[key[:end]]
            tails = [self._coded(c) for c in key[end:]]
            return ids + b"".join([t[0] for t in tails]), surface + "".join([t[1] for t in tails])
        return self._coded(SPACE + key)

    def _coded(self, text: str) -> tuple[bytes, str]:
        if self.single.issuperset(text):
            pieces = self._run(text)
            return array("I", map(self.id_of.__getitem__, pieces)).tobytes(), "".join(pieces).replace(SPACE, " ")
        ids: list[int] = []
        at = 0
        for k, c in enumerate(text):
            if c not in self.single:
                ids += [self.id_of[p] for p in self._run(text[at:k])] if k > at else []
                ids += [self.id_of_byte[b] for b in c.encode()]
                at = k + 1
        if at < len(text):
            ids += [self.id_of[p] for p in self._run(text[at:])]
        return array("I", ids).tobytes(), self._surface(ids)

    def _surface(self, ids) -> str:
        """Pieces put together; runs of byte ids become UTF-8, each byte that is not part of a character U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.text_of[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def chunks_of(self, text: str) -> list[str]:
        """A text with its dummy prefix, cut before each run of spaces, without the first space mark of each."""
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], -1
        for p in parts:
            spaces += 1
            if p:
                out.append(SPACE * spaces + p)
                spaces = -1
        return out + [SPACE * spaces] if spaces >= 0 else out

    def code(self, text: str) -> tuple[bytes, str]:
        """Ids with begin and end as little-endian 32-bit bytes, and what they decode to."""
        found = list(map(self.chunks.__getitem__, self.chunks_of(text))) if text else []
        self.chunks.trim()
        self.fits.trim()
        ids = b"".join([f[0] for f in found])
        return array("I", [self.begin]).tobytes() + ids + array("I", [self.end]).tobytes(), "".join([f[1] for f in found])[1:]

    def encode(self, text: str) -> list[int]:
        return array("I", self.code(text)[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        surface = self._surface(ids)
        return surface[1:] if surface.startswith(" ") else surface


@cache  # once per Python worker
def codec_at(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_and_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and decoded of every row of docs."""
    return _mapped(docs, vocabulary, lambda ids, decoded: (ids, decoded), [("ids", "binary", pa.binary()), ("decoded", "string", pa.string())])


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""

    def row(ids: bytes, decoded: str):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, vocabulary, row, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def _mapped(docs: DataFrame, vocabulary: str, row, fields) -> DataFrame:
    def run(batches):
        codec = codec_at(public_tokenizers.path(vocabulary))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                columns = zip(*(row(*codec.code(t)) for t in part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f[2]) for c, f in zip(columns, fields, strict=True))], names=["doc_id", *(f[0] for f in fields)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in fields))
