import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crossfade.llm.packing import pack
from crossfade.llm.text import pieces
from crossfade.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "<|endoftext|> Hi<|ENDOFTEXT|>x <|StartOfText|>", "İstanbul ŉ ª it's IT'S don't… a.b,c.,, ,.", "é Éx\u0085 nb x\x1cy\x85z 12a3 ½ ²",
    "日本語 テスト Ελληνικός ΣΑΣ.", "", "   ", "a\tb\x0bc\x0cd\re", "'s's ''ll", "ﬁ ǅ K Å straße STRASSE ſ", "The, THE. the ... x.,", "ÉCOLE, école. école",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kept", [2, 1000])
def test_ids_equal_those_of_whole_texts(whole, kept):
    words = WordTokenizer(PATH, kept)
    for text in [*ODD, *ODD]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert words.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text


def test_pieces_keep_words_whole():
    text = b"aa bbbb\tcc  " + b"x" * 50 + b" d"
    for size in (1, 3, 7, 1000):
        assert b"".join(pieces(text, size)) == text
        assert [w for p in pieces(text, size) for w in p.split()] == text.split()


def _held(whole, rows, found, capacity):
    """Every token in one piece, every sequence full or as long as a power of two."""
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(doc_id, []).append(whole.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = {}, {}
    for p in found:
        assert len(p.ids) == 4 * p.length > 0
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, texts in ids.items():
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(texts[0]))
                assert list(struct.unpack(f"<{p.length}I", p.ids)) == texts[0][at : at + p.length]
                at += p.length
    for pieces_ in by_sequence.values():
        at = 0
        for p in sorted(pieces_, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return by_sequence


@pytest.mark.parametrize("capacity", [1, 8, 64])
def test_every_token_once_and_no_padding(spark, whole, capacity):
    rows = [(i, " ".join(f"word{j}" for j in range(i * i % 41))) for i in range(60)]
    rows += [(None, "no id"), (100, None), (101, ""), (102, "same"), (102, "same"), (103, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, ids string, length int").repartition(3)
    _held(whole, rows, pack(docs, PATH, capacity, block_tokens=500).collect(), capacity)


def test_costs_are_balanced(spark, whole):
    rows = [(i, "a " * (1 + i * 37 % 61)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = _held(whole, rows, pack(docs, PATH, 128).collect(), 128)
    costs = sorted(sum(p.length**2 for p in s) for s in found.values() if sum(p.length for p in s) == 128)
    assert costs[-1] < 2 * costs[0]


def test_empty_and_unfit(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack(docs, PATH).count() == 0
    with pytest.raises(ValueError):
        pack(docs, PATH, 1000)
