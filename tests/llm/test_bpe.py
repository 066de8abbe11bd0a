import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from phasegrid.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN, limit=100_000)


def test_perfect_hash_is_minimal_and_proves_its_keys():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(3000))
    assert sorted(table.rank) == list(range(3000))
    assert all(table.get(f"other{i}".encode()) == -1 for i in range(500))
    assert bpe.PerfectHash([]).get(b"a") == -1


def test_random_texts_equal_the_library(reference, codec):
    rng = random.Random(3)
    alphabet = "abcde ABC  \n\t'sll1234.,!?-äöüßéñ漢字\u00a0\u2003😀\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", "<|endoftext|>", "a" * 5000, "ab" * 4000, " " * 300, "it's they'll WE'VE '", "!" * 2000]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_merge_takes_the_leftmost_pair_of_lowest_rank():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300, b"aaa": 301}
    assert bpe.merge(b"aaaaa", ranks) == [300, 301]
    assert bpe.merge(b"a", ranks) == [97]


def test_rows_are_whole(spark, corpus, empty, reference):
    out = bpe.decode(bpe.encode(corpus.withColumn("ids", F.lit(3)), PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == [*corpus.columns, "ids", "decoded"]
    rows = bpe.id_lists(out, out_col="list").collect()
    assert len(rows) == corpus.count()
    for r in rows:
        assert r["list"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_splitter_equals_the_pattern_on_all_characters():
    split, whole = bpe.splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    random.Random(5).shuffle(points)
    for lo in range(0, len(points), 40):
        text = "".join(map(chr, points[lo : lo + 40]))
        assert split(text) == whole(text)
        plain = "".join(c for c in text if c < "\U00010000") + " it's  1\x1c\n \t x "
        assert split(plain) == whole(plain)
    for other in (r"(?i:'s)|\p{L}+", r"[^\s\d]+|\s", r"\p{Gothic}+|\s", r"[\s]+(?!\S)|\w"):
        assert bpe.splitter(other)("It'S a1 \U00010330 ") == regex.findall(other, "It'S a1 \U00010330 ")


def test_a_codec_that_only_decodes_makes_no_encoder():
    codec = bpe.Codec([bytes([c]) for c in range(256)], P.PATTERN)
    rows = codec.decode_rows(np.array([104, 105, 0, 255], "<u4"), np.array([0, 2, 2, 4]))
    assert rows.to_pylist() == [b"hi", b"", b"\x00\xff"]
    assert codec.decode_rows(np.array([], "<u4"), np.array([0, 0, 0])).to_pylist() == [b"", b""]
    assert not {"whole", "ranks"} & set(vars(codec))


def test_memo_is_bounded_by_bytes():
    codec = bpe.Codec([bytes([c]) for c in range(256)], P.PATTERN, limit=40_000)
    for i in range(2000):
        assert codec.decode(codec.encode(f"word{i} again")) == f"word{i} again".encode()
        assert len(codec) + len(codec.older) <= 40_000 // bpe.ENTRY_BYTES + 2
    codec.forget()
    assert not codec and not codec.older
