"""Best-fit-decreasing packing of token pieces into windows, planned from a histogram.

Documents are cut into full windows and one rest. Best-fit decreasing looks at
the pieces' lengths only, and there are at most `window` lengths: the plan is
made once from the count of each length, with windows of equal free room kept as
runs. A segment tree over the free room finds the tightest window that still
takes a piece. The plan's size depends on the window, not on the data; a piece
finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duolith.llm.common import map_texts, staged

#: How a byte-level file without a pattern of its own splits text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Settings of a tokenizers file that this module follows; a file that differs is refused.
PLAIN_BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
#: Pieces of one length that a part should hold; a common length is dealt into parts for ranking.
PIECES_OF_A_PART = 500


class FreeRoom:
    """Segment tree over free room 0..window: which rooms have windows, and the least room of at least n."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.tree = bytearray(2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        if not count:
            return
        self.runs[room].append((first, count))
        self._mark(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return run

    def _mark(self, room: int, value: int) -> None:
        node = room + self.size
        self.tree[node] = value
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] | self.tree[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.size
        if self.tree[node]:
            return least
        while node > 1:  # up to the first subtree to the right that has a window
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.size


def plan_windows(counts: dict[int, int], window: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Rows: length, first rank, pieces of it in one window, first sequence, offset.
    Ranks from the first on go to sequence first + (rank - first rank) // pieces.
    """
    rooms, rows, fresh = FreeRoom(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, count = window, fresh, -(-left // (window // length))
                fresh += count
            else:
                first, count = rooms.take(room)
            each = room // length
            rows.append((length, rank, each, first, window - room))
            full = min(count, left // each)
            rooms.add(room - each * length, first, full)
            placed, used = full * each, full
            if full < count and left > placed:  # the last one gets what is left
                rooms.add(room - (left - placed) * length, first + full, 1)
                placed, used = left, full + 1
            rooms.add(room, first + used, count - used)
            left -= placed
            rank += placed
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


_encodings: dict[str, tiktoken.Encoding] = {}


def differs(told: dict, want: dict) -> list[str]:
    return [k for k, v in want.items() if told.get(k, v) != v]


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file with its added tokens; one for each worker process.

    The file lists its merges in the order of their ids, so its vocabulary gives
    the ranks that the core of tiktoken needs; the ids are the file's own. Added
    tokens are cut out of a text before it is split, as the library does.
    """
    if path not in _encodings:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        odd = differs(told["model"], PLAIN_BPE) + differs(told.get("pre_tokenizer") or {"type": None}, PLAIN_SPLIT)
        odd += [k for t in told["added_tokens"] for k in differs(t, PLAIN_TOKEN)] + ["normalizer"] * (told.get("normalizer") is not None)
        if odd:
            raise ValueError(f"{path}: not followed here: {', '.join(odd)}")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
        _encodings[path] = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    return _encodings[path]


def pieces_of(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """Tokens of each document, cut into full windows and a rest: doc_id, start, length, ids_crc32, doc_tokens."""

    def make(texts: list[str]) -> dict[str, list]:
        end, encode = np.array([end_id], dtype="<u4").tobytes(), encoding(tokenizer_path).encode_to_numpy
        rows = []
        for i, text in enumerate(texts):
            raw = encode(text, allowed_special="all").tobytes() + end
            n = len(raw) // 4
            rows += [(i, s, min(window, n - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
        return dict(zip(("_row", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows, strict=True), strict=True))

    return map_texts(docs, make, "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs every document's tokens, each followed by end_id, into sequences of at most `window` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every token lies in one piece, offsets of a sequence have
    no gaps, and a sequence's unused end is its padding. Null and empty texts are
    the end id alone; a token that the file adds, written in a text, is that token;
    repeated rows are packed as often as they occur; ties of length go by a hash of
    id and start, then id, start and crc; an empty table gives an empty table;
    further columns of the input are not read, whatever their names.
    """
    pieces = staged(pieces_of(docs, tokenizer_path, window, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    parts = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // PIECES_OF_A_PART))) for n in range(window + 1)])
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.get(parts, F.col("length").cast("int"))))
    held = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")) - 1)
        .join(before.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_rank") + F.col("_before")).alias("_rank"))
    )
    plan = plan_windows(counts, window)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))] if len(plan) else plan

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 40
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = plan[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            along = rank - row[:, 1]
            told = [row[:, 3] + along // row[:, 2], row[:, 4] + along % row[:, 2] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, told)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
