"""Texts that collide under every polynomial hash modulo 2**64 (Thue-Morse strings) stay apart."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mercato.llm import bpe, chat, jaccard, lbl, packing, textbatch


def thue_morse(n, a="a", b="b"):
    x = a
    while len(x) < n:
        x += x.translate(str.maketrans(a + b, b + a))
    return x[:n]


ONE, OTHER = thue_morse(2048), thue_morse(2048, "b", "a")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, ONE), (2, OTHER), (3, ONE + " tail"), (4, OTHER[:1024]), (5, ONE[:1024])]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_span_hashes_and_numbers():
    rng = np.random.default_rng(0)
    spans = [ONE.encode(), OTHER.encode(), b"", *{bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in range(1, 600) for _ in range(3)}]
    at = np.append(0, np.cumsum([len(s) for s in spans]))
    data = np.frombuffer(b"".join(spans), np.uint8)
    assert len(set(textbatch.span_hashes(data, at[:-1], at[1:]).tolist())) == len(spans)
    twice = np.frombuffer(b"x".join(spans + spans), np.uint8)
    starts = np.cumsum([0] + [len(s) + 1 for s in (spans + spans)[:-1]])
    ends = starts + [len(s) for s in spans + spans]
    hashes = textbatch.span_hashes(twice, starts, ends)
    assert (hashes[: len(spans)] == hashes[len(spans) :]).all() and (hashes[: len(spans)] == textbatch.span_hashes(data, at[:-1], at[1:])).all()
    number, distinct = textbatch.span_numbers(twice, starts, ends)
    assert [distinct[i].as_py() for i in number.tolist()] == spans + spans and len(distinct) == len(spans)


def test_packing_gives_each_text_its_own_ids(docs):
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = {}
    for r in packing.pack_documents(docs).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert {r["doc_tokens"] for r in pieces[i]} == {len(ids)}
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces[i])


def test_chats_read_back(spark):
    import hashlib

    rows = [(1, 0, "user", ONE), (1, 1, "assistant", OTHER), (2, 0, "user", OTHER), (2, 1, "assistant", ONE)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        said = "".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == c)
        assert out[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_jaccard_keeps_them_apart(docs):
    out = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_counts_keep_them_apart(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    taught = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, ONE + " word " + " ".join(f"w{i % 7}" for _ in range(5))) for i in taught[:40]] + [(held[0], OTHER), (held[1], ONE)]
    out = {r["doc_id"]: r for r in lbl.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known = {w for i, t in rows if i in taught for w in re.findall(r"\S+", t)}
    assert ONE in known and OTHER not in known
    assert out[held[0]]["n_known"] == 1 and out[held[1]]["n_known"] == 2  # the end mark is known
