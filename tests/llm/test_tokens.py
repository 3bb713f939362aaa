"""Operators 1, 4 and 8 against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from helpers import ODD, SF, docs, save, texts_of, vocabulary
from tokenizers import Tokenizer

import __spark_entry__ as E
from tactica.llm import bpe, packing, token_count

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(vocabulary(BYTE))


def test_automaton_small_by_hand():
    # merges: a a, aa b, b c  over the bytes a b c
    spec = '{"model": {"vocab": {"a":0,"b":1,"c":2,"aa":3,"aab":4,"bc":5}, "merges": ["a a", "aa b", "b c"]}}'
    m = bpe.TokenAutomaton(spec)
    names = {0: "a", 1: "b", 2: "c", 3: "aa", 4: "aab", 5: "bc"}

    def by_rank(word):
        parts = list(word)
        for pair in (("a", "a"), ("aa", "b"), ("b", "c")):
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == pair:
                    parts[i:i + 2] = ["".join(pair)]
                i += 1
        return parts

    import itertools
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert [names[i] for i in m.encode_word(word)] == by_rank(word), word


def test_automaton_matches_library(byte_library):
    machine = bpe.automaton(bpe.read_spec(vocabulary(BYTE)))
    for text in [*texts_of().values(), *(t for t in ODD if t), "a" * 2000, "ab" * 1500, "zzz " * 50]:
        ids = machine.encode(text)
        assert ids == byte_library.encode(text, add_special_tokens=False).ids
        assert machine.decode(ids) == byte_library.decode(ids, skip_special_tokens=False) == text


def test_op1(spark, byte_library):
    rows = {r.doc_id: r for r in E.queries()["op1_bpe_round_trip"](spark, SF).collect()}
    assert len(rows) == len(texts_of())
    for i, text in texts_of().items():
        ids = byte_library.encode(text or "", add_special_tokens=False).ids
        back = byte_library.decode(ids, skip_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_encode_edge_cases(spark):
    df = docs(spark, [*enumerate(ODD), (0, "again"), (None, "no id")], extra="ids decoded")
    out = bpe.encode(df, vocabulary(BYTE), decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.decoded == (r.text or "") and bool(r.ids) == bool(r.text) for r in rows)
    again = bpe.decode(out.drop("decoded"), vocabulary(BYTE), text_col="text").collect()
    assert [r.text for r in again] == [r.decoded for r in rows]
    assert bpe.encode(df.limit(0), vocabulary(BYTE)).count() == 0


def test_op4(spark):
    library = Tokenizer.from_file(vocabulary(WORD))
    for r in E.queries()["op4_token_counts"](spark, SF).collect():
        text = texts_of()[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (1000, 100)])
def test_counts_with_small_chunks(spark, chunk, overlap):
    library = Tokenizer.from_file(vocabulary(WORD))
    long = [t for t in list(texts_of().values())[:30]] + ["w" * 700 + " tail " * 40, "don't we'll " * 60, "a1b2 " * 99, "é" * 900, "!?" * 500]
    rows = [*enumerate(ODD + long), (3, ODD[10]), (None, long[0]), (3, long[1])]
    out = token_count.count_tokens(docs(spark, rows, extra="n_tokens key"), vocabulary(WORD), chunk, overlap).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in out) == want


def test_counts_of_other_tokenizers_and_empty_table(spark, byte_library):
    df = docs(spark, enumerate(ODD))
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, vocabulary(BYTE), 50, 8).collect()} == {
        i: len(byte_library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    assert token_count.count_tokens(df.limit(0), vocabulary(WORD)).count() == 0


def check_pieces(rows, texts, library, length):
    """Pieces rebuild every document, and sequences are gapless, full but the last, and padded right."""
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    seen, places = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen.get(r.doc_id, 0) and r.length > 0
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[r.doc_id] = r.start + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    assert seen == {i: len(x) for i, x in ids.items()}
    assert sorted(places) == list(range(len(places)))
    for s, pieces in places.items():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == length if s < len(places) - 1 else 0 < at <= length
        assert {p for _, _, p in pieces} == {at if at & (at - 1) == 0 else length}


def test_op8(spark, byte_library):
    check_pieces(E.queries()["op8_pack"](spark, SF).collect(), texts_of(), byte_library, 1024)


def test_ids_of_very_long_runs(byte_library):
    ids = packing.library(bpe.read_spec(vocabulary(BYTE)))
    machine = bpe.automaton(bpe.read_spec(vocabulary(BYTE)))
    for text in ("\n" * 700_000, "x" + " " * 800_000 + "y", "a" * 400_000, "ab1 " * 60_000):
        want = byte_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(text), "<u2").tolist() == want == machine.encode(text)


def test_pack_edge_cases(spark, byte_library, tmp_path):
    df = docs(spark, enumerate(ODD), extra="ids part before").repartition(5)
    for length in (1, 7, 64):
        check_pieces(packing.pack(df, vocabulary(BYTE), length).collect(), dict(enumerate(ODD)), byte_library, length)
    assert packing.pack(df.limit(0), vocabulary(BYTE)).count() == 0
    twice = packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), vocabulary(BYTE), 4).collect()
    assert sum(r.length for r in twice) == 9 and {r.doc_id for r in twice} == {1, None}
    folder = save(spark, tmp_path, documents=docs(spark, enumerate(ODD)))
    check_pieces(E.queries()["op8_pack"](spark, folder).collect(), dict(enumerate(ODD)), byte_library, 1024)
