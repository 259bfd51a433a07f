import base64
import random

import pytest
from tokenizers import Tokenizer

from kildespor.llm import encode
from kildespor.llm.queries import BPE, TOKENIZERS

PATH = f"{TOKENIZERS}/{BPE}"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def odd_texts():
    rng = random.Random(8)
    made = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(80))) for _ in range(400)]
    return [*made, "<|endoftext|> x", "a" * 20_000, " " * 5000 + "x", "x\n\n\n y z\x1c\x85q", "it's WE'LL don't", "aaaa bbbb aaaa", "og og og", "日本 🕯️", "\r\n\t "]


def test_ids_are_the_tokenizers(spark, tokenizer):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["id"]: r["ids"] for r in encode.encoded(df, "doc_id", "text", PATH).collect()}
    wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == wanted
    sizes = {r["id"]: r["n_tokens"] for r in encode.encoded(df, "doc_id", "text", PATH, only_counts=True).collect()}
    assert [sizes[i] for i in range(len(texts))] == [len(w) for w in wanted]


def test_round_trip(spark):
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in encode.encoded(df, "doc_id", "text", PATH).collect():
        assert b"".join(ranks[i] for i in r["ids"]).decode() == texts[r["id"]]


def test_null_empty_and_repeated(spark, rows, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hej"), (3, "hej")], "doc_id bigint, text string")
    got = rows(encode.encoded(df, "doc_id", "text", PATH))
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got) == 4
    assert rows(encode.encoded(df.where("false"), "doc_id", "text", PATH)) == []


def test_small_stretches_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"ord{i % 7} og {i}") for i in range(900)], "doc_id bigint, text string")
    whole = {r["id"]: r["ids"] for r in encode.encoded(df, "doc_id", "text", PATH).collect()}
    monkeypatch.setattr(encode, "STRETCH", 50)
    monkeypatch.setattr(encode, "REPLAYED", 5)
    assert {r["id"]: r["ids"] for r in encode.encoded(df, "doc_id", "text", PATH).collect()} == whole


def test_another_kind_of_tokenizer_is_refused(spark):
    df = spark.createDataFrame([(1, "hej")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="byte-level"):
        encode.encoded(df, "doc_id", "text", f"{TOKENIZERS}/word_bpe_49k.json")


def test_overlapping_pairs_merge_from_the_left():
    class Table:
        of_byte = list(range(256))
        pairs = {(97, 97): (0, 300), (300, 97): (1, 301), (300, 300): (2, 302)}

    assert encode.replay(["aaa", "aaaa", "aaaaa", "", "ba"], Table()) == [[301], [302], [300, 301], [], [98, 97]]  # the lower rank first
