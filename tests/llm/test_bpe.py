import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.llm import bpe

RAW = bpe.vocabulary_bytes()
OURS = bpe.encoder(RAW)
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RAW.splitlines() if line)}
THEIRS = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_random_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "ไม่มีช่องว่าง" * 300, "地图" * 2000, "<|endoftext|>", "\r\n\t  x", "😀" * 500, "don't we'll I'm"])
def test_hard_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert bpe.decode(RAW, OURS.encode(text)) == text


def test_queue_order():
    q = bpe.RankQueue(60**2 + 5)
    for rank, at in [(3604, 1), (7, 9), (7, 2), (60, 5), (3600, 0), (0, 4)]:
        q.add(rank, at, at + 2)
    out = []
    while (x := q.pop()) is not None:
        out.append(x[:2])
    assert out == [(0, 4), (7, 2), (7, 9), (60, 5), (3600, 0), (3604, 1)]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    e = bpe.Encoder(RANKS)
    text = " ".join(f"word{i}" for i in range(200))
    assert e.encode(text) == THEIRS.encode_ordinary(text) and len(e.memo) <= 10


def test_columns(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("k"))
    rows = {r.doc_id: r.ids for r in bpe.encode_column(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert rows == {k: THEIRS.encode_ordinary(t or "") for k, t in texts.items()}
    assert {r.doc_id: r.tokens for r in bpe.count_column(df).collect()} == {k: len(v) for k, v in rows.items()}
