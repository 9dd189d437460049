"""BPE, packing, fingerprints and media against definitions."""

import bisect
import hashlib
import json
import random
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duolith.llm import bpe, fingerprint, media, packing

ODD = [" \n\t  x", "", "it's  a\n\ntest ", "日本語 é ½ 12", "<|endoftext|>", "   ", "a" * 400, "don't  stop\r\n now", " x　y"]


def encoder():
    return bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


LIBRARY = library()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\taeéz'sdt.,019½漢　<|>", max_size=80))
def test_bpe_equals_the_library_and_round_trips(text):
    ids = encoder().encode(text)
    assert list(array("I", ids)) == LIBRARY.encode_ordinary(text)
    assert encoder().decode(ids) == text.encode()


def test_backtracking_equals_merging_where_longest_matches_fail():
    e, dice, stepped_back = encoder(), random.Random(1), 0
    for _ in range(3000):
        raw = bytes(dice.choice(b"etaoinshrdlu") for _ in range(dice.randint(1, 14)))
        assert e.split_piece(raw) == e.backtrack(raw) == bpe.merged(e.ranks, raw)
        longest = [t for _, t in e.automaton.iter_long(raw.decode("latin-1"))]
        stepped_back += longest != e.backtrack(raw)
    assert stepped_back > 100


def test_chunks_join_to_the_text_and_cut_no_piece():
    import regex

    for text in ODD:
        chunks = bpe.chunks_of(text)
        assert "".join(chunks) == text
        assert [p for c in chunks for p in regex.findall(P.PATTERN, c)] == regex.findall(P.PATTERN, text)


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")


def test_encode_documents(spark):
    rows = bpe.encode_documents(rows_of(spark, [*ODD, None, ODD[2]]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("doc_id").collect()
    assert len(rows) == len(ODD) + 2
    for r, t in zip(rows, [*ODD, "", ODD[2]], strict=True):
        ids = LIBRARY.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_documents(rows_of(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    dice, bits = random.Random(5), ["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "a", "it's", "½", "漢", "\t x"]
    for text in [*ODD, *("".join(dice.choice(bits) for _ in range(dice.randint(1, 12))) for _ in range(300))]:
        assert packing.encoding(P.path("byte_bpe_50k.json")).encode_to_numpy(text, allowed_special="all").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}])
def test_tokenizer_files_that_differ_are_refused(tmp_path, change):
    told = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8")) | change
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="not followed"):
        packing.encoding(str(tmp_path / "t.json"))


def best_fit_decreasing(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else window
        bisect.insort(rooms, room - n)
    return Counter(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=120))))
def test_plan_equals_best_fit_decreasing(case):
    window, lengths = case
    counts = Counter(lengths)
    plan = packing.plan_windows(counts, window).tolist()
    held = defaultdict(list)
    for length, n in counts.items():
        runs = sorted(r for r in plan if r[0] == length)
        for rank in range(n):
            _, first, each, seq, offset = [r for r in runs if r[1] <= rank][-1]
            held[seq + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert Counter(window - sum(n for _, n in parts) for parts in held.values()) == best_fit_decreasing(lengths, window)


def test_pack(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PIECES_OF_A_PART", 20)
    texts = [*ODD, None, "word " * 5000, ODD[2]]
    clashing = rows_of(spark, texts).selectExpr("*", "'y' AS length", "0 AS start", "1 AS sequence_id", "2 AS _part")
    rows = packing.pack(clashing, P.path("byte_bpe_50k.json"), window=64).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(docs[i], key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(rows_of(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()


def test_fingerprints_of_edits(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    texts = ["Straße  A", "STRASSE a", "", None, "ﬁn é", "fin é", "x" * 50, "x" * 50, "abcdefgh", "ABCDEFGH ", "z", " tail 漢字 "]
    rows = fingerprint.fingerprint_edits(rows_of(spark, texts)).orderBy("doc_id").collect()
    plain, seen = [t or "" for t in texts], defaultdict(set)
    for i, r in enumerate(rows):
        t, following = plain[i], plain[(i + 1) % len(plain)]
        cut = len(t) // 4
        e = t[: len(t) - cut] + following[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == float(canon(t) == canon(e)) and r.near_next == float(canon(t) == canon(following))
        seen[canon(t)].add(r.fingerprint)
        seen[canon(e)].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == len(seen)
    assert fingerprint.fingerprint_edits(rows_of(spark, [])).count() == 0


def test_fingerprint_groups_and_clashes(spark, monkeypatch):
    df = rows_of(spark, ["a b", "A  b", "c", None, ""])
    assert {r.doc_id: r.group_rows for r in fingerprint.fingerprint(df).collect()} == {0: 2, 1: 2, 2: 1, 3: 2, 4: 2}
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "digest_keys", lambda text: [F.lit(7).cast("bigint"), F.lit(9).cast("bigint")])
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(df).collect()}
    assert got[0] == got[1] != got[2] and len(set(got.values())) == 3


def test_media_round_trip(spark):
    texts = [*ODD, None, "GIF89a BM RIFF %PDF-1.4"]
    for r, t in zip(media.text_media(rows_of(spark, texts)).orderBy("doc_id").collect(), [t or "" for t in texts], strict=True):
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert '"type":"audio/wav","corrected":true,"length_ok":true' in r.feature


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(
    len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big") for n, d in ((b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0"), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b""))
)
GIF = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"


def test_media_are_sniffed_and_carved(spark):
    rows = [(1, "image/png", PNG), (2, "image/gif", PNG), (3, "x", b"junk" + PNG + GIF + media.wave(b"abc")), (4, "image/png", PNG[:-1]), (5, None, None), (6, "x", GIF)]
    got = {r.media_id: r for r in media.correct(spark.createDataFrame(rows, "media_id int, declared string, content binary")).collect()}
    assert (got[1].detected, got[1].corrected, got[1].length_ok) == ("image/png", False, True)
    assert (got[2].detected, got[2].corrected) == ("image/png", True)
    assert [e.type for e in got[3].embedded] == ["image/png", "image/gif", "audio/wav"] and got[3].detected is None
    assert got[4].detected is None and got[5].detected is None and got[6].detected == "image/gif"
    assert media.carve(rows[2][2]) == [("image/png", PNG), ("image/gif", GIF), ("audio/wav", media.wave(b"abc"))]


def pdf(body=b"", extra=b""):
    head = b"%PDF-1.4\n" + body
    return head + b"xref\n0 0\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(head) + extra


def flac_stream(blocks, total):
    """Frames of one 8-bit channel: constant, verbatim, or Rice-coded differences."""
    out = b"fLaC\x80\0\0\x22" + b"\0\x10" * 2 + b"\0" * 6 + ((8000 << 44) | (0 << 41) | (7 << 36) | total).to_bytes(8, "big") + b"\0" * 16
    for i, (kind, xs) in enumerate(blocks):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, i, len(xs) - 1])
        head += bytes([media.crc8(head)])
        u = lambda v, n: f"{v & (1 << n) - 1:0{n}b}"
        bits = {"constant": "0" + u(0, 6) + "0" + u(xs[0], 8), "verbatim": "0" + u(1, 6) + "0" + "".join(u(x, 8) for x in xs)}.get(kind)
        if bits is None:
            bits = "0" + u(9, 6) + "0" + u(xs[0], 8) + u(0, 2) + u(0, 4) + u(2, 4)
            for a, b in zip(xs, xs[1:], strict=False):
                folded = 2 * (b - a) if b >= a else 2 * (a - b) - 1
                bits += "0" * (folded >> 2) + "1" + u(folded, 2)
        bits += "0" * (-len(bits) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + media.crc16(frame).to_bytes(2, "big")
    return out


def test_media_end_where_their_structure_says():
    two = pdf(b"1 0 obj\n") + b"junk in between" + pdf()
    assert [x for _, x in media.carve(b"?" + two)] == [pdf(b"1 0 obj\n"), pdf()]
    updated = pdf()
    updated += b"\nxref\n/Prev\nstartxref\n%d\n%%%%EOF" % (len(updated) + 1)
    assert [x for _, x in media.carve(b"?" + updated + PNG)] == [updated, PNG]
    assert media.carve(b"?" + pdf(pdf())) == [("application/pdf", pdf(pdf()))]
    frames = [("rice", [0, 3, -5, 7, 100, -100, 0, 1]), ("constant", [5] * 16), ("verbatim", list(range(-8, 8)))]
    whole = flac_stream(frames, 40)
    assert media.carve(b"?" + whole + b"other data" + PNG) == [("audio/flac", whole), ("image/png", PNG)]
    assert media.carve(b"?" + flac_stream(frames, 0) + b"\xff\xf8data") == [("audio/flac", flac_stream(frames, 0))]
    assert media.carve(b"?" + flac_stream(frames, 41) + b"x" * 30) == []
    assert media.carve(b"?" + whole[:-1] + b"?") == []


@pytest.mark.parametrize("bit", [b"%PDF-1", b"%PDF-1 startxref 5 %%EOF", b"PK\3\4", b"PK\3\4PK\5\6" + b"\0" * 18, b"\xff\xd8\xff", b"RIFF", b"fLaC", b"BM"])
def test_sniffing_is_linear(bit):
    import time

    began = time.process_time()
    media.sniff(b"?" + bit * (400_000 // len(bit)))
    assert time.process_time() - began < 5


@pytest.mark.parametrize("cut", range(0, len(PNG), 7))
def test_broken_media_count_for_nothing(cut):
    assert media.sniff(PNG[:cut] + b"?" + PNG[cut + 1 :])[0] is None
