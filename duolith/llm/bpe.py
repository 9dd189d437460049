"""Byte-level BPE by backtracking over longest dictionary matches.

The vocabulary's byte strings are mapped to Latin-1 text and put into an
Aho-Corasick automaton, which lists every token at every place of a piece in
one pass. The encoder walks forward with the longest token that is compatible
with the one before it and steps back where none is. Two adjacent tokens are
compatible when merging their joined bytes by rank gives just these two; a
sequence whose neighbours are all compatible is the one that merging gives, so
every place is reached by one sequence at most and a place found dead stays
dead: the work is linear in the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import ahocorasick
import regex
from pyspark.sql import DataFrame

from duolith.llm.common import map_texts

#: Entries a worker remembers; later ones are computed each time.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Plain merging by rank: the definition, used on short byte strings."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Encoder:
    """Encodes pieces with a vocabulary of ranks; remembers what it has seen, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.length_of = {r: len(b) for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = merged(self.ranks, self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.fits) < 4 * REMEMBERED:
                self.fits[a, b] = known
        return known

    def encode_piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is not None:
            return known
        raw = piece.encode("utf-8", "surrogatepass")
        out = array("I", [whole] if (whole := self.ranks.get(raw)) is not None else self.split_piece(raw)).tobytes()
        if len(self.pieces) < REMEMBERED:
            self.pieces[piece] = out
        return out

    def split_piece(self, raw: bytes) -> list[int]:
        """The longest match at each place first: where all neighbours are compatible, that is the encoding."""
        out = [token for _, token in self.automaton.iter_long(raw.decode("latin-1"))]
        fits, before = self.fits, out[0]
        for token in out[1:]:
            known = fits.get((before, token))
            if not (self.compatible(before, token) if known is None else known):
                return self.backtrack(raw)
            before = token
        return out

    def backtrack(self, raw: bytes) -> list[int]:
        n, length_of, compatible = len(raw), self.length_of, self.compatible
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            at[end + 1 - length_of[token]].append(token)  # shorter ones come first
        out: list[int] = []
        tries: list[list[int]] = [at[0].copy()]
        dead = bytearray(n + 1)
        place = 0
        while place < n:
            left = tries[-1]
            while left:
                token = left.pop()
                end = place + length_of[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    place = end
                    tries.append(at[end].copy() if end < n else [])
                    break
            else:
                dead[place] = 1
                tries.pop()
                place -= length_of[out.pop()]
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        found, known = self.find(chunk), self.pieces.get
        out = b"".join([known(p) or self.encode_piece(p) for p in found])
        if len(found) > 1 and len(self.chunks) < REMEMBERED:
            self.chunks[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces, chunks, fresh = self.pieces.get, self.chunks.get, self.encode_chunk
        return b"".join([pieces(c) or chunks(c) or fresh(c) for c in chunks_of(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


#: Spaces followed by white space or nothing: there, a piece may reach over a space.
LOOSE = re.compile(r"\s\s| \Z")
CUT = regex.compile(r"\s?\S+|\s+(?!\S)|\s+")


def chunks_of(text: str) -> list[str]:
    """Cuts a text only where no piece of the split pattern can cross: before a space that a non-space follows.

    A piece holds white space only at its start or alone, so the pieces of the
    chunks are the pieces of the text, and chunks repeat often enough to be worth
    remembering.
    """
    if not text:
        return []
    if LOOSE.search(text):
        return CUT.findall(text)
    head, *rest = text.split(" ")
    out = [" " + c for c in rest]
    return [head, *out] if head else out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """Encodes each whole text and decodes it again.

    Returns a row for each input row: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 and, with keep_ids, ids
    (array of bigint). Null and empty texts have no tokens and the digests of no
    bytes; repeated rows give repeated rows; an empty table gives an empty table;
    further columns of the input are not read.
    """

    def make(texts: list[str]) -> dict[str, list]:
        enc = encoder(path, pattern)
        ids = [enc.encode(t) for t in texts]
        out = {
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(enc.decode(i)).hexdigest() for i in ids],
        }
        return out | {"ids": [array("I", i).tolist() for i in ids]} if keep_ids else out

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * keep_ids)
