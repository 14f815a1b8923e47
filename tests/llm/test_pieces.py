import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from parlance.llm import pieces
from tests.llm.fixtures import SF, awkward, docs, prose


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


def test_every_text_round_trips(spark, vocab):
    got = pieces.encode(docs(spark), vocab)
    back = pieces.decode(got, vocab).collect()
    assert len(back) == len(awkward()) and all(r["lossless"] for r in back)
    assert all(r["decoded"] == r["text"] for r in back)
    assert all(r["n_tokens"] == len(r["tokens"] or []) for r in back)
    assert all((r["tokens"] is None) == (r["text"] is None) for r in back)


def test_registered_query_is_lossless(spark, vocab):
    got = pieces.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert pieces.decode(got, vocab).where("not lossless or decoded <> text").count() == 0


def test_without_dropout_it_is_the_plain_segmentation(spark, vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [prose(k, 50) for k in range(20)] + ["One, two; three (four) 1999.", "a b c"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["tokens"] for r in pieces.encode(docs(spark, rows), vocab, dropout=0.0).collect()}
    assert all(got[i] == sp.encode(t) for i, t in enumerate(texts))


def test_seed_and_key_and_place_vary_the_segmentation(spark, vocab):
    text = "international understanding of extraordinary circumstances " * 4
    rows = [(i, text, None, None) for i in range(40)]
    encode = lambda df, **kw: {r["doc_id"]: tuple(r["tokens"]) for r in pieces.encode(df, vocab, **kw).collect()}
    one = encode(docs(spark, rows))
    assert one == encode(docs(spark, rows).repartition(5)) and one != encode(docs(spark, rows), seed=8)
    assert len(set(one.values())) > 30  # of 40 keys, at the rate that is used
    cuts = set()
    for ids in one.values():  # words of one text differ among themselves
        words = pieces.decode_ids(vocab, np.array(ids)).decode()
        assert words == text
        cuts.add(len(ids))
    assert len(cuts) > 5


MASK = (1 << 64) - 1


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def brute(sp, text: str, key: int, dropout: float, seed: int) -> list[int]:
    """One candidate at a time over lists, with whole numbers: merges that a draw passes over stay away until one of
    their two symbols changes."""
    out = []
    for number, chunk in enumerate(re.findall(r"\n| *[^ \n]+| +", " " + text) if text else []):
        salt = mixed(mixed(key + seed * pieces._C & MASK) + number * pieces._B & MASK)
        symbols, passed, step = [c.replace(" ", "▁") for c in chunk], set(), 0
        marks = list(range(len(symbols)))  # a symbol made anew gets a new mark
        while True:
            able = []
            for i in range(len(symbols) - 1):
                piece = sp.piece_to_id(symbols[i] + symbols[i + 1])
                fine = all(not sp.is_unknown(sp.piece_to_id(x)) for x in symbols[i : i + 2]) and not sp.is_unknown(piece)
                if fine and (marks[i], marks[i + 1]) not in passed:
                    able.append((-sp.get_score(piece), piece, i))
            if not able:
                break
            _, _, i = min(able)
            step += 1
            if mixed(salt + (step - 1) * pieces._A & MASK) >> 32 < int(dropout * 2**32):
                passed.add((marks[i], marks[i + 1]))
                continue
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            marks[i : i + 2] = [max(marks) + len(chunk) + 1]
        for x in symbols:
            known = sp.piece_to_id(x)
            out += [sp.piece_to_id(f"<0x{b:02X}>") for b in x.encode()] if sp.is_unknown(known) else [known]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_dropout_against_brute_force(vocab, dropout):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [prose(k, 40) for k in range(12)] + ["", "naïve  Ünïcødé 漢字かな 😀\n\n  end ", " ", "\n", "x" * 200, "the " * 30, "".join(prose(3, 20).split())]
    keys = np.arange(7, 7 + len(texts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    raw = [t.encode() for t in texts]
    ids, many, fine = pieces.Encoder(vocab, dropout, 5).texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), keys)
    assert fine.all()
    upto = np.concatenate([[0], np.cumsum(many)])
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == brute(sp, t, int(keys[k]), dropout, 5), t


def test_slices_and_long_chunks_make_no_difference(vocab, monkeypatch):
    text = " ".join(["".join(prose(k, 12).split()) for k in range(12)] + [prose(1, 300)]).encode()
    run = lambda: pieces.Encoder(vocab, 0.2, 3).texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.ones(1, np.uint64))[0].tolist()
    whole = run()
    monkeypatch.setattr(pieces, "LONG_CHUNK", 3)
    assert run() == whole
    monkeypatch.setattr(pieces, "SLICE", 50)
    assert run() == whole


def test_empty_table(spark, vocab):
    assert pieces.encode(docs(spark, []), vocab).count() == 0
    assert pieces.decode(docs(spark, []).withColumn("tokens", F.array().cast("array<int>")), vocab).count() == 0
