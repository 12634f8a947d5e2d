"""Encoding against the tokenizers library, and the tree against a direct encoding."""

import hashlib
import random

import public_tokenizers
import pytest

from grainloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "   ", "\n\t", "Hello, World it's 123", "Straße ÀÉÎÕÜ ÿ", "<|endoftext|> a <|startoftext|>b", "ΑΣ Σ. İstanbul á", "x y\x1cz​w",
    "\U0001f600\U0001f600 ok", "don't we'll I'M 'S", "!!!???...", "日本語テキスト 한국어", "a" * 9000, "ab" * 5000 + " c", "!?" * 4000, "é" * 6000, "é" * 3000, "x<|endoftext|>" * 400, "a \xa0 b \u3000",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    got = bpe.tokenizer(PATH).encode(text)
    assert [int(i) for e in got for i in e[1].split(" ")] == want
    assert " ".join(e[2] for e in got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(12))
def test_tree_of_unsplit_text(library, seed):
    r = random.Random(seed)
    parts = r.choice([["the", "ing", "ab", "z", "qu", "tion"], list("abcde"), ["é", "ü", "n"], ["aa", "a"], ["ha", "haha", "ah"]])
    text = "".join(r.choice(parts) for _ in range(r.randint(1, 4000)))
    tree = bpe.TreeBpe(PATH, long=8, leaf=r.choice([3, 7, 64]))
    want = library.encode(text, add_special_tokens=False).ids
    assert [int(i) for e in tree.encode(text) for i in e[1].split(" ")] == want


def test_frames(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again")], "doc_id long, text string, ids string")
    for r in bpe.digest_texts(df, PATH).collect():
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.encode_texts(df, PATH)
    back = {r.doc_id: r.text for r in bpe.decode_ids(ids, PATH).collect()}
    assert back == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(TEXTS)}
    assert bpe.digest_texts(df.limit(0), PATH).count() == 0
