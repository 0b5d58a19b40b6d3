"""Byte BPE against the rank library, and the round trip."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from robustlens.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    return [None, "", " ", "a" * 3000, "abab" * 400 + "ba", "x\x1c\x1d  \n\n\t z　 ​", "<|endoftext|> it's don't WE'RE 12345 ½²³ ٣", "中文没有空格" * 80,
            "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(1500)), "".join(chr(rng.randrange(0x4e00, 0x9fff)) for _ in range(800)),
            "".join(rng.choice("abcdefgh") for _ in range(3000)), "The same row. ", "The same row. ", "é ñandú \U0001f600\U0001f468‍\U0001f469"]


def test_equals_library_and_round_trip(spark, library):
    rows = [(i, t, "extra") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = bytebpe.decode(bytebpe.encode(docs, PATH, PATTERN), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t, _ in rows:
        assert list(got[i].ids) == library.encode_ordinary(t or ""), i
        assert bytes(got[i].decoded) == (t or "").encode()
    digest = {r.doc_id: r for r in bytebpe.round_trip(docs, PATH, PATTERN).collect()}
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        assert digest[i].n_tokens == len(ids)
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_leftmost_mode_and_irregular_ranks(tmp_path):
    """A rank file with a token that its own merges never make is contracted at one place a step, and equals the plain loop."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abcd", b"ab", b"cd", b"aa", b"aab"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    v = bytebpe.Vocabulary(str(path))
    assert not v.together
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(n)).encode() for n in range(1, 60)] + [b"a" * 120]

    def plain(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            best = min(((v.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.ranks), default=None)
            if best is None:
                return [v.ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert [list(x) for x in v.merge(words)] == [plain(w) for w in words]
    assert bytebpe.Vocabulary(PATH).together


def test_empty_table_and_bad_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.decode(bytebpe.encode(docs, PATH, PATTERN), PATH).collect() == []
    v = bytebpe.Vocabulary(PATH, False)
    assert v.decode([]) == [] and v.decode([np.zeros(0, np.int32)]) == [b""]
    with pytest.raises(ValueError):
        v.decode([np.array([10 ** 6], np.int32)])
