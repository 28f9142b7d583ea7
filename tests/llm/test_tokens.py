"""Encoding and packing beside the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from passel.llm.bpe import BEYOND, FragmentEncoder, encode_texts
from passel.llm.packing import pack_documents
from passel.llm.registered import QUERIES, VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
ODD = ["a", "b", " ", "\n", "'", "s", "ll", "<|endoftext|>", "<|", "é", "é", "́", "Σ", "ς", "İ", "ß", "1", "²", "½", "_", "!", "日本"]
ODD += ["\x1c", "\u0085", "\xa0", " ", "​", "ᄒ", "ᅡ", "Ⅷ", "Å", "٣", "क", "\U0001f600", "x" * 70, "'re", "'T", "th" * 60]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return FragmentEncoder(file.read())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_letter_of_the_quick_way(own, library):
    for code in range(0x530):
        c = chr(code)
        text = f"a{c}1{c}!{c}{c} {c}"
        assert BEYOND.search(text) or own.encode(text) == ids_of(library, text), hex(code)


def test_odd_texts(own, library):
    chance = random.Random(1)
    for _ in range(5000):
        parts = (chance.choice(ODD) if chance.random() < 0.7 else chr(chance.randrange(0xD800)) for _ in range(chance.randrange(12)))
        text = "".join(parts)
        ids = own.encode(text)
        assert ids == ids_of(library, text), repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 30000, "ab" * 3000, "!" * 5000, "word " * 300000, "Ünder\n" * 1000])
def test_long_texts(own, library, text):
    assert own.encode(text) == ids_of(library, text)


def test_fragments_merge_like_single_words(own):
    """Words merged together, and one by one with a heap, have the same ids."""
    chance = random.Random(4)
    words = ["".join(chance.choice("etaoinshrdlué'.!1") for _ in range(chance.randrange(1, 40))).encode() for _ in range(3000)]
    assert own.encode_words(words) == [own.encode_long(w) for w in words]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr("passel.llm.bpe.REMEMBERED", 3)
    with open(PATH, encoding="utf-8") as file:
        small = FragmentEncoder(file.read())
    text = "one two three four five one two six seven one " * 3
    for _ in range(3):
        assert small.encode_batch([text, "", text[::-1]]) is not None
        assert small.encode(text) == ids_of(library, text) and len(small.known) <= 3


def test_cuts_are_certain(own):
    """No token of the vocabulary spans a place where a word is cut."""
    chance = random.Random(3)
    for token, number in chance.sample(sorted(own.vocabulary.items()), 3000):
        ends = token.endswith(own.end)
        word = bytes(own.letters[c] for c in token.removesuffix(own.end))
        inner = word if ends else word + b"\0"
        codes, begins = own._codes([inner])
        assert not begins[1 : len(word)].any(), token


def test_query_equals_library(spark, tables, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_bpe"](spark, tables).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for r in docs:
        ids = ids_of(library, r.text)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_encoding_of_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "the", 6), (1, "", 7), (1, "the", 8)], "doc_id long, text string, ids long")
    rows = encode_texts(docs, PATH)
    assert rows.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in rows.collect()), key=repr)
    assert got == sorted([(1, [], ""), (None, [518], "the</w>"), (1, [], ""), (1, [518], "the</w>")], key=repr)
    assert encode_texts(docs.limit(0), PATH).count() == 0


def packed_right(rows, want, size=4096):
    """Every id of every document in one piece, every sequence without gaps; gives the share of padding."""
    documents, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert documents.keys() == want.keys()
    for doc, ids in want.items():
        at = 0
        for r in sorted(documents[doc], key=lambda r: r.start):
            piece = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece)) and r.length > 0
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding / sum(map(len, want.values()))


def test_packing(spark, tables, library):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = {r.doc_id: [*ids_of(library, r.text), 2] for r in docs.collect()}
    assert packed_right(QUERIES["op7_packing"](spark, tables).collect(), want) < 0.03
    # Windows left over by many partitions are merged.
    assert packed_right(pack_documents(docs.repartition(40), PATH).collect(), want) < 0.03


@pytest.mark.parametrize("n_open", [1, 3])
def test_packing_of_edge_rows(spark, library, n_open):
    texts = [None, "", "the " * 5000, "the " * 15, "the " * 63, "x", "the " * 8191]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "the", 3)], "doc_id long, text string, length long")
    want = {i: [*ids_of(library, t), 2] for i, t in enumerate(texts)} | {None: [518, 2]}
    packed_right(pack_documents(docs.coalesce(2), PATH, n_open=n_open).collect(), want)
    packed_right(pack_documents(docs, PATH, size=16, n_open=n_open).collect(), want, 16)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "the the")] * 3, "doc_id long, text string")
    rows = pack_documents(docs, PATH).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == [(1, 0, 3)] * 3
