"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is its sequence of lower-case words. Its k-mers of five words are
labelled with their occurrence, so that repeats count; each of BANDS hash orders
picks the least of them, and the picked k-mers are kept in text order. Two texts
agree in a band if the same k-mers come in the same order, which is the likelier
the smaller their edit distance. Documents that agree in a band are candidates;
a pair is a link if an alignment within a band of diagonals shows that the edits
are at most a fifth of the longer text. Classes are the connected components.

Equal word sequences are one node from the start. Each node is compared with the
least node of all its groups first, and components are contracted. Where a group
still holds several, each node is compared with the group's least one if that is in
another component (in a group above MOST nodes also with the least of those that
agree in the band's four least k-mers), and components are contracted again.
Groups that still hold several components then meet in blocks, each pair in the
first band that it has in common: a small group is one block, a large one is cut
by classes of length into salted parts. Lengths and word histograms rule pairs
out, the rest is aligned there. No pair is left out: the work grows with the
square of what isn't contracted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolith.llm.common import map_batches, map_texts, membership, staged

WORDS_OF_KMER, BANDS, SIMILARITY = 5, 16, 0.8
#: Texts of up to so many words have bands of 2-mers too: an edit spoils a large part of their 5-mers.
SHORT = 40
#: Nodes of a group above which it is contracted by parts too.
MOST = 40
#: Places of the word histogram that bounds the edit distance from below.
BINS = 256
BLOCK = 1 << 16
#: Nodes and words of one side of a block, and pairs looked at together there.
SIDE, WORDS_OF_SIDE, AT_ONCE = 500, 400_000, 1 << 13

OTHER = re.compile(r"\W+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SEEDS = np.random.default_rng(2019).integers(1, 1 << 63, size=2 * BANDS, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def plain(text: str) -> bytes:
    """The words of a text, lower case, with single spaces between."""
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def word_hashes(told: bytes) -> np.ndarray:
    if not told:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(told, np.uint8)
    up, down = powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up, dtype=np.uint64)])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers, labelled with their occurrence; a shorter text is one k-mer."""
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : len(words) - k + 1 + i]
    out = mixed(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    if not fresh.all():
        at = np.arange(len(out))
        out[order] = mixed(ranked + (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64))
    return out


def least_in_order(hashes: np.ndarray, seeds: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each seed, keys of the two and of the four least k-mers in text order."""
    best_v = best_at = None
    for start in range(0, len(hashes), BLOCK):
        v = mixed(hashes[None, start : start + BLOCK] ^ seeds[:, None])
        n = min(most, v.shape[1])
        at = np.argpartition(v, n - 1, axis=1)[:, :n] if v.shape[1] > n else np.broadcast_to(np.arange(n), (len(seeds), n))
        v, at = np.take_along_axis(v, at, 1), at + start
        best_v = v if best_v is None else np.concatenate([best_v, v], 1)
        best_at = at if best_at is None else np.concatenate([best_at, at], 1)
    rank = np.argsort(best_v, axis=1, kind="stable")[:, :most]
    best_at = np.take_along_axis(best_at, rank, 1)
    keys = []
    for n in (2, most):
        picked = hashes[np.sort(best_at[:, :n], axis=1)]
        key = seeds.copy()
        for i in range(picked.shape[1]):
            key = mixed(key * np.uint64(BASE) + picked[:, i])
        keys.append(key.view(np.int64))
    return keys[0], keys[1]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2 (digest of the word sequence), n (words), two, four (a key for each band), bins."""

    def make(texts: list[str]) -> dict[str, list]:
        rows = []
        for text in texts:
            told = plain(text)
            words = word_hashes(told)
            two, four = [], []
            if len(words):
                bands = [(WORDS_OF_KMER, SEEDS[:BANDS])] + [(2, SEEDS[BANDS:])] * (len(words) <= SHORT)
                for k, seeds in bands:
                    a, b = least_in_order(kmers(words, k), seeds)
                    two += a.tolist()
                    four += b.tolist()
            bins = np.minimum(np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()
            d = xxhash.xxh3_128_intdigest(told)
            rows.append((*((x ^ (1 << 63)) - (1 << 63) for x in (d >> 64, d & (1 << 64) - 1)), len(words), two, four, bins))
        return dict(zip(("d1", "d2", "n", "two", "four", "bins"), zip(*rows, strict=True), strict=True))

    return map_texts(docs, make, "d1 bigint, d2 bigint, n int, two array<bigint>, four array<bigint>, bins binary")


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether a word alignment with at most so many edits exists.

    Equal ends are set aside; the words' counts bound the edits from below; then
    the band of 2 * most + 1 diagonals goes through the table column by column, as
    bits of whole numbers that say where costs rise and fall (Hyyrö's banded form of
    the bit-parallel algorithm).
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return False
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    _, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    over = np.bincount(x, minlength=where.max() + 1) - np.bincount(y, minlength=where.max() + 1)
    if max(over[over > 0].sum(), -over[over < 0].sum()) > most:
        return False
    return aligned_within(x.tolist(), y.tolist(), most)


def aligned_within(x: list[int], y: list[int], most: int) -> bool:
    """The band itself: neither side empty, lengths at most `most` apart.

    In column j bit t stands for row j - most + t. The cost is followed along the
    band's lowest diagonal up to the last row, then along that row.
    """
    rows, columns, width = len(x), len(y), 2 * most + 1
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full, low = (1 << width) - 1, 1 << width - 1
    rise, fall = (1 << most + 1) - 1 << most, 0  # between each row and the one above
    cost, bend = min(rows, most), max(0, rows - most)
    for j in range(columns):
        hit = places.get(y[j], 0)
        hit = (hit >> j - most if j >= most else hit << most - j) & full
        same = (((hit & rise) + rise) ^ rise | hit | fall) & full
        right, left = fall | full & ~(same | rise), same & rise  # up or down against the column before
        if j < bend:
            cost += not same & low
            if cost > most + columns - bend:
                return False
        else:
            last = rows - j - 1 + most
            cost += (right >> last & 1) - (left >> last & 1)
            if cost - (columns - j - 1) > most:
                return False
        down = same >> 1
        rise, fall = left | full & ~(down | right), down & right
    return cost <= most


def most_edits(longer: int, similarity: float) -> int:
    return int(longer * (1 - similarity) + 1e-9)


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """The definition: word edits are at most 1 - similarity of the longer text's words."""
    x, y = word_hashes(plain(a)), word_hashes(plain(b))
    return edits_within(x, y, most_edits(max(len(x), len(y)), similarity))


def could_be(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, a_n, b_n, a_bins, b_bins, ...) whose lengths and word histograms don't rule out a link, without these four."""
    kinds = {c: kind for c, kind in pairs.dtypes if c not in ("a_n", "b_n", "a_bins", "b_bins")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.maximum(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            low = np.minimum(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("a_bins", "b_bins"))
            most = (n * (1 - similarity) + 1e-9).astype(np.int64)
            keep = (n - low <= most) & (np.abs(x - y).sum(1) <= 2 * most)
            yield batch.select(list(kinds)).filter(pa.array(keep))

    return map_batches(pairs, run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ids (a, b) that are links, with all columns."""
    columns = pairs.columns
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("bins").alias(f"{s}_bins"))
    left = staged(could_be(pairs.join(side("a"), "a").join(side("b"), "b"), similarity), "pairs")
    holds = membership(left.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h")))
    texts = docs.where(holds(F.xxhash64("doc_id"))).select("doc_id", "text")
    full = left.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select(*columns, "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            words = lambda t: seen[t] if t in seen else seen.setdefault(t, word_hashes(plain(t)))  # noqa: B023, E731
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = words(x or ""), words(y or "")
                keep.append(edits_within(x, y, most_edits(max(len(x), len(y)), similarity)))
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return map_batches(full, run, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes)).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, label (the least id of its component) of every id in links (a, b) that is linked to another.

    Each id hooks onto its least neighbour, and hooks are followed to their ends. Links
    become links of these ends, and those within one end go, so a link is joined once a
    round for as long as it leads elsewhere. Two rounds halve the ids that are left.
    """
    edges, labels = staged(ordered_pairs(links, F.col("a"), F.col("b")), "edges"), None
    while True:
        ends = edges.select("a", "b").unionAll(edges.select("b", "a"))
        ends = staged(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
        while True:
            new = staged(ends.join(ends.toDF("label", "_next"), "label").select("id", F.col("_next").alias("label"), F.col("label").alias("_old")), "labels")
            ends, still = new.select("id", "label"), new.where("label != _old").isEmpty()
            if still:
                break
        labels = ends if labels is None else staged(relabelled(labels, ends), "labels")
        edges = staged(of_labels(edges, ends), "edges")
        if edges.isEmpty():
            return labels


def relabelled(label: DataFrame, roots: DataFrame) -> DataFrame:
    """label (id, label) with the labels of its labels in roots (id, label), where they have one."""
    return label.join(roots.toDF("label", "_root"), "label", "left").select(*[F.coalesce("_root", "label").alias(c) if c == "label" else c for c in label.columns])


def grouped(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1")


def ordered_pairs(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()


def several(told: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys, id, label, ...) of groups that hold several labels."""
    open_ = told.groupBy(*keys).agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select(*keys)
    return told.join(open_, keys)


def from_least(told: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of a group's least node and its nodes of another label (keys, id, label, first) that weren't compared with it, and their labels (low, high)."""
    least = told.groupBy(*keys).agg(F.min("id").alias("_least"), F.min_by("label", "id").alias("_label"))
    return told.join(least, keys).where("label != _label and _least != first").select(*[f(x, y).alias(c) for x, y, names in (("id", "_least", "ab"), ("label", "_label", ("low", "high"))) for f, c in zip((F.least, F.greatest), names, strict=True)])


def of_labels(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links (a, b) of nodes as links of their labels (id, label)."""
    name = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    return ordered_pairs(links.join(name("a"), "a").join(name("b"), "b"), F.col("a_label"), F.col("b_label"))


class Block:
    """Nodes that meet: part p with part q. Rows as crowds() makes them, after key, cls, p, q."""

    def __init__(self, place: tuple, rows: list[tuple], similarity: float):
        (self.key, _, self.p, self.q), self.rows, self.similarity = place, rows, similarity
        self.ids, self.labels, self.parts, own, n, bins, two = zip(*(r[:7] for r in rows), strict=True)
        _, self.label = np.unique(np.array(self.labels, dtype=object).astype(str), return_inverse=True)
        self.part, self.own, self.n = np.array(self.parts), np.array(own), np.array(n, dtype=np.int64)
        self.bins = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS).astype(np.int16)
        self.few = self.bins.reshape(len(rows), -1, 8).sum(2, dtype=np.int16)  # a first, looser bound
        self.two, self.words = two, {}

    def not_ruled_out(self) -> Iterator[tuple[int, int]]:
        """Pairs of two labels whose lengths and word histograms allow a link; one at least is of the block's own class of length."""
        x, y = (np.flatnonzero(self.part == side) for side in (self.p, self.q))
        step = max(1, AT_ONCE // max(1, len(y)))
        for at in range(0, len(x), step):
            i, j = x[at : at + step, None], y[None, :]
            most = (np.maximum(self.n[i], self.n[j]) * (1 - self.similarity) + 1e-9).astype(np.int64)
            ok = (np.abs(self.n[i] - self.n[j]) <= most) & (self.label[i] != self.label[j]) & (self.own[i] | self.own[j])
            if self.p == self.q:
                ok &= i < j
            p, q = np.nonzero(ok)
            most, p, q = most[p, q], x[at + p], y[q]
            for held in (self.few, self.bins):
                keep = np.abs(held[p] - held[q]).sum(1, dtype=np.int64) <= 2 * most
                p, q, most = p[keep], q[keep], most[keep]
            yield from zip(p.tolist(), q.tolist(), strict=True)

    def words_of(self, i: int) -> np.ndarray:
        if i not in self.words:
            self.words[i] = word_hashes(plain(self.rows[i][7] or ""))
        return self.words[i]

    def links(self) -> Iterator[tuple]:
        """Links, as labels, of pairs that have no earlier band in common: those meet there. What is linked here on the way isn't compared again."""
        root = list(range(int(self.label.max()) + 1))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        for i, j in self.not_ruled_out():
            a, b = find(self.label[i]), find(self.label[j])
            if a == b or next((u for u, v in zip(self.two[i], self.two[j], strict=False) if u == v), self.key) != self.key:
                continue
            x, y = self.words_of(i), self.words_of(j)
            if edits_within(x, y, most_edits(max(len(x), len(y)), self.similarity)):
                root[a] = b
                yield self.labels[i], self.labels[j]


def crowds(told: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links of labels (a, b) that join all nodes of a group (told: key, id, label) that are linked to one of another label.

    A group within SIDE nodes and WORDS_OF_SIDE words is one block. Nodes of a larger
    one meet by class of length, each class with itself and with the next shorter one;
    those of the largest component, which needn't meet each other, and the rest are
    dealt into parts, and a part of the rest meets all other parts.
    """
    held = told.join(nodes.select("id", "n"), "id")  # a group's rows come together by key as ids and lengths only
    sums = held.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sums = sums.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    held = held.join(sums.select("key", "main", ((F.col("c") > SIDE) | (F.col("w") > WORDS_OF_SIDE)).alias("big")), "key")
    columns = ("key", "cls", "p", "q", "id", "label", "part", "own", "n")
    zero = F.lit(0)
    small = held.where("not big").select("key", zero.alias("cls"), zero.alias("p"), zero.alias("q"), "id", "label", zero.alias("part"), F.lit(True).alias("own"), "n")

    wide = math.log(1.01 / similarity) if similarity > 0 else math.inf
    big = held.where("big").withColumn("rest", F.col("label") != F.col("main"))
    big = big.withColumn("cls", F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / wide).cast("int"))
    big = big.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("cls", F.when(F.col("own"), F.col("cls")).otherwise(F.col("cls") + 1))
    parts = lambda side: F.greatest(F.ceil(F.count_if(side) / SIDE), F.ceil(F.coalesce(F.sum(F.when(side, F.col("n"))), zero) / WORDS_OF_SIDE)).cast("int")
    cells = big.groupBy("key", "cls").agg(F.count_if("own").alias("owns"), F.count("*").alias("c"), parts(F.col("rest")).alias("r"), parts(~F.col("rest")).alias("m"))
    big = big.join(cells.where("owns > 0 and r > 0 and c > 1").drop("owns", "c"), ["key", "cls"])
    # Parts of the rest are 0..r-1, those of the main component r..r+m-1; a block is a part of the rest and a part from it on.
    part = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))).cast("int")
    big = big.withColumn("part", F.when(F.col("rest"), part).otherwise(part + F.col("r")))
    others = F.when(F.col("rest"), F.sequence(zero, F.col("r") + F.col("m") - 1)).otherwise(F.sequence(zero, F.col("r") - 1))
    big = big.withColumn("other", F.explode(others)).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})

    blocks = small.unionByName(big.select(*columns))
    holds = membership(told.select(F.xxhash64("id").alias("h")).distinct())
    texts = docs.where(holds(F.xxhash64("doc_id"))).groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"))
    blocks = blocks.join(nodes.select("id", "n", "bins", "two"), ["id", "n"]).join(texts.drop("_h"), "id").select(*columns, "bins", "two", "text")
    place = ("key", "cls", "p", "q")
    blocks = blocks.repartition(*place).sortWithinPartitions(*place, "part", "id")
    kind = dict(nodes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, now, rows = [], None, []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("a", batch.schema.field("id").type), ("b", batch.schema.field("id").type)])
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:4] != now:
                    if rows:
                        found += Block(now, rows, similarity).links()
                    now, rows = r[:4], []
                rows.append(r[4:])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        if rows:
            found += Block(now, rows, similarity).links()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return map_batches(blocks, run, f"a {kind}, b {kind}")


def near_classes(docs: DataFrame, *, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """Class of each document: doc_id, class_id (the least doc_id of its class).

    A row for each row of docs (doc_id, text). Null and empty texts, and texts
    without a word, are one word sequence, so one class. Rows with one doc_id are
    one document. Rows without doc_id are in no class: class_id is null. Repeated
    rows stay; an empty table gives an empty table; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    sketches = staged(sketch(docs), "sketches")
    known = sketches.where("doc_id is not null")
    nodes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "two", "four", "bins")])
    nodes = staged(nodes, "nodes")
    entries = nodes.select("id", F.explode(F.arrays_zip("two", "four")).alias("k")).select("id", "k.*").distinct()
    groups = entries.join(grouped(entries, "two").select("two", "size", "least"), "two").withColumnRenamed("two", "key")
    groups = staged(groups, "groups")
    alone = groups.groupBy("id").agg(F.min("least").alias("first"))
    first = staged(ordered_pairs(alone, F.col("id"), F.col("first")), "stars")
    label = components(verified(first, nodes, docs, similarity))
    label = staged(alone.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), "first")

    told = staged(several(groups.join(label, "id"), ["key"]), "open")
    stars = from_least(told, ["key"]).unionByName(from_least(told.where(F.col("size") > most), ["key", "four"]))
    links = verified(staged(stars.distinct(), "stars"), nodes, docs, similarity)
    root = components(links.select(F.col("low").alias("a"), F.col("high").alias("b")))

    told = relabelled(told.where("size > 2").select("key", "id", "label"), root)
    told = staged(several(told, ["key"]).select("key", "id", "label"), "told")
    label = relabelled(relabelled(label.select("id", "label"), root), components(crowds(told, nodes, docs, similarity)))

    classes = nodes.select("d1", "d2", "id").join(label, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("class_id"))
    out = sketches.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, with all columns, without the documents that aren't the least of their class; of rows with one doc_id one stays.

    Rows without doc_id stay. Of rows with one doc_id and different texts any may be
    the one that stays. An empty table gives an empty table.
    """
    members = staged(near_classes(docs, **options), "members")
    gone = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).where("doc_id != class_id or doc_id is not null and n > 1")
    gone = staged(gone.select(F.col("doc_id").alias("_class_of"), (F.col("doc_id") == F.col("class_id")).alias("_least")), "gone")
    test = membership(gone.select(F.xxhash64("_class_of").alias("h")))(F.xxhash64("doc_id"))
    some = docs.where(test).join(gone, F.col("doc_id") == F.col("_class_of"), "left")
    alone = some.where("_class_of is null").select(*docs.columns)
    again = some.where("_least").select(*docs.columns).dropDuplicates(["doc_id"])
    return docs.where(~test).unionByName(alone).unionByName(again)
