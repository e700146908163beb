import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stemma.llm import encode
from stemma.llm.encode import Encoder, layout
from stemma.llm.packing import pack, piece_lengths
from stemma.llm.token_files import manifest, read_token_files, write_token_files

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TOK = {n: Tokenizer.from_file(P.path(n)) for n in NAMES}
ENC = {n: Encoder(P.path(n)) for n in NAMES}
ODD = ["", None, " ", "  ", "a  b", "a   b", "\n \n x", "it's  the\tend ", "<|endoftext|>x <|endoftext|> y", "<|STARTOFTEXT|> Ab", "x" * 5000, "ÉTÉ é ́", "\x1c a\x85b", "漢字 かな", "ends \n", " lead", "a\n b\n  c"]


def whole(name, text):
    return TOK[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_cuts_equal_whole_texts(name):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENC[name].batch(ODD)] == [whole(name, t) for t in ODD]


def test_words_that_collide_under_polynomial_hashes(spark):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    texts = [bits, bits.translate({97: "b", 98: "a"}), f"x {bits[:1024]} y", f"x {bits[1024:2048]} y"]
    for name in NAMES:
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(P.path(name)).batch(texts)] == [whole(name, t) for t in texts]
    files = write_token_files(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), NAMES[0], 2)
    assert [np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in read_token_files(spark, files).orderBy("start").collect()] == [whole(NAMES[0], t) for t in texts]


@given(st.text(alphabet=" \n\t\r 　abAB'sé1.,!́<|>", max_size=30))
@settings(max_examples=300, deadline=None)
def test_cuts_equal_whole_random_texts(text):
    for name in NAMES:
        assert np.frombuffer(ENC[name].batch([text])[0], "<u4").tolist() == whole(name, text)


@pytest.mark.parametrize("name", NAMES)
def test_words_are_encoded_once_whatever_mark_follows(name):
    enc, texts = Encoder(P.path(name)), ["a zyxwv, zyxwv. zyxwv!! zyxwv;zyxwv zyxwv\n", "a zyxwv: été, été. été?"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.batch(texts)] == [whole(name, t) for t in texts]
    space = " " if name == NAMES[0] else ""
    assert {w.decode() for w in enc.words if len(w) > 4} == {f"{space}zyxwv", ";zyxwv", f"{space}été"}


@pytest.mark.parametrize("name", NAMES)
def test_every_latin_letter_and_mark(name):
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]]
    texts = [f"{a}\n{a}{b} x{a}{m}{b} {m}{a}'s {a}{m}́" for a, b in zip(letters, reversed(letters), strict=True) for m in "!#,.;<>|=-×÷'"]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(P.path(name)).batch(texts)] == [whole(name, t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_old_words_stay_a_while(name, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_WORDS", 6)
    enc, rng, encoded = Encoder(P.path(name)), np.random.default_rng(1), []
    monkeypatch.setattr(enc, "_words", lambda pieces, words=enc._words: (encoded.extend(pieces), words(pieces))[1])
    for i in range(60):
        text = " ".join(["a common word", *("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(i % 4))])
        assert np.frombuffer(enc.batch([text])[0], "<u4").tolist() == whole(name, text)
    assert len(enc.words) < 30 and len(enc.old) < 30 and encoded.count(b" common") + encoded.count(b"common") == 1


def test_layout_of_unknown_tokenizer():
    assert layout({"added_tokens": [], "pre_tokenizer": {"type": "Metaspace"}, "normalizer": None}) == "whole"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, DOC_ID string, lang string")


def test_round_trip(spark):
    rows = [(i * 7 % 23 - 3, t, "clash", None) for i, t in enumerate(ODD)] + [(None, "no id", None, None), (5, "twice", None, None), (5, "twice", None, None)]
    files = write_token_files(frame(spark, rows), NAMES[0], 2)
    got = read_token_files(spark, files).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got.sort(key=lambda r: r.start)
    at = 0
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        ids = [*whole(NAMES[0], w[1]), 2]
        assert (g.doc_id, g.start, g.n_tokens) == (w[0], at, len(ids))
        assert np.frombuffer(g.ids, "<u4").tolist() == ids
        at += len(ids)
    assert manifest(spark, files).agg({"n_ids": "sum"}).first()[0] == at


def test_empty_table(spark):
    empty = frame(spark, [])
    assert read_token_files(spark, write_token_files(empty, NAMES[0], 2)).count() == 0
    assert pack(empty, NAMES[1], 2).count() == 0


def test_piece_lengths():
    for n in range(1, 300):
        sizes = piece_lengths(n, 64)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 for s in sizes)
        assert len(sizes) == n // 64 + bin(n % 64).count("1")


def test_packing_holds_each_id_once(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(ODD)] + [(99, "word " * 9000, None, None)]
    got = pack(frame(spark, rows), NAMES[1], 2).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_number = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted((r.length for r in got), reverse=True)
    for doc_id, text, *_ in rows:
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        ids = [*whole(NAMES[1], text), 2]
        assert b"".join(r.ids for r in mine) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in mine] == [sum(m.length for m in mine[:k]) for k in range(len(mine))]
        assert all(r.doc_tokens == len(ids) and r.offset == 0 and r.length in (1 << np.arange(13)) for r in mine)


def test_crc_matches_zlib(spark):
    from pyspark.sql import functions as F

    row = pack(frame(spark, [(1, "some words here", None, None)]), NAMES[1], 2, longest=4096).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(row.ids)
