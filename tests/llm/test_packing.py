"""Packing: exact round trip of ids, gapless sequences, the bitset against a plain best fit, odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanloom.llm.packing import LENGTH, Packer, cut, encode, pack_documents

DIR = "/root/testdata/sf0.001"


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    r = random.Random(3)
    letters = "ab E's\n\t\r\x0b　é1ß漢字!?  ​'ll\x00😀"
    texts = ["", " ", "<|endoftext|> a", "a<|endoftext|>", "x" * 5000, " " * 5000, "I'll've it's", "\n\n \n a"] + ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(300)]
    for t in texts:
        assert encode(t) == reference_ids(t)


def test_cut():
    for n in (1, 2, 1023, 1024, 1025, 2048, 5000):
        pieces = cut(n)
        assert sum(x for _, x in pieces) == n and all(x == LENGTH for _, x in pieces[1:])
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [x for _, x in pieces[:-1]]))


def test_packer_is_a_plain_best_fit():
    r = random.Random(1)
    for most in (2, 5, 1000):
        packer, open_, made = Packer(50, most), {}, 0
        for _ in range(2000):
            n = r.randrange(1, 51)
            number, offset = packer.put(n)
            fits = [free for free in open_.values() if free >= n]
            if fits:
                assert open_[number] == min(fits) and offset == 50 - open_[number]
                left = open_.pop(number) - n
            else:
                assert number == made and offset == 0
                made, left = made + 1, 50 - n
            if left:
                if len(open_) == most:  # the fullest closes
                    fullest = min(open_.values())
                    gone = [k for k, v in open_.items() if v == fullest]
                    open_.pop(gone[-1])
                open_[number] = left
            assert len(open_) <= most


def check(rows, texts):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ids, sequences = {}, {}
    for r in rows:
        if r["doc_id"] not in ids:
            ids[r["doc_id"]] = reference_ids(texts[r["doc_id"]] or "") + [2]
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= LENGTH
    return ids, sequences


def test_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = pack_documents(docs).collect()
    ids, sequences = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert {k: sum(r["length"] for r in rows if r["doc_id"] == k) for k in ids} == {k: len(v) for k, v in ids.items()}
    assert len(ids) == docs.count()
    assert len(sequences) <= 1.1 * sum(map(len, ids.values())) / LENGTH + 8


def test_odd_tables(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, "a b", 5), (2, None, None), (3, "", 1), (4, "word " * 4000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = pack_documents(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got if r["doc_id"] != 4) == [(0, 3), (1, 3), (1, 3), (2, 1), (3, 1)]
    check([r for r in got if r["doc_id"] == 4], {4: "word " * 4000})
    assert pack_documents(docs.limit(0)).count() == 0
