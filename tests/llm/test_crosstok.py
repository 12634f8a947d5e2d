"""Cross-tokenizer alignment against both libraries and plain sets of offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from grainloom.llm import crosstok, registry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a \n b\n\nc \t d", "Hello, World it's 123", "Straße ÀÉÎÕÜ ÿ", "x▁y", "<s> </s> <unk> <|endoftext|>", "日本語 テキスト", "é   z　", "\x00 \x1c a",
    "don't  we'll I'M 'S", "ab" * 3000, "\U0001f600 ok \U0001f600", "trailing\n", "\n lead", "a\r\n b", "tab\there  \t", "<0x41> z", "½ ² ß", "the the the of the",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), crosstok.aligner(A, B)


def plain(libraries, texts):
    """Rows by definition: whole texts, sets of offsets."""
    a, b, tables = libraries
    found = []
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ta, tb = [tables.bytes_a[i] for i in ia], [tables.bytes_b[i] for i in ib]
        if not t or b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            found.append(([], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        both, groups, i, j = sorted(set(ea) & set(eb)), [], 0, 0
        for e in both:
            k, m = ea.index(e) + 1, eb.index(e) + 1
            groups.append((ia[i:k], ib[j:m]))
            i, j = k, m
        found.append((ia, ib, groups, [(x[-1], y[-1]) for x, y in groups]))
    counts = Counter(p for f in found for p in f[3])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return [(len(x), len(y), len(g), len(p), sum(counts[q] == best[q[1]] for q in p), sum(counts[q] for q in p), digest(g)) for x, y, g, p in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("pairs", [2_000_000, 7])
def test_frames(spark, libraries, monkeypatch, pairs):
    monkeypatch.setattr(crosstok, "PAIRS", pairs)
    texts = [*TEXTS, TEXTS[9], TEXTS[9]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, key int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in crosstok.align(df, A, B).select(*COLUMNS).collect()}
    assert [got[i] for i in range(len(texts))] == plain(libraries, texts)
    assert crosstok.align(df.limit(0), A, B).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_units_encode_as_in_the_text(libraries, seed):
    r = random.Random(seed)
    parts = ["the", "The", "ing", "'s", "12", "é", "ß", ".", ",", " ", " ", "  ", "\n", "\t", "\r\n", "_", "<s>", "▁" if seed == 5 else "a", "½" if seed == 4 else "b"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 200))) for _ in range(100)]
    rows, links, sizes = libraries[2].align(texts)
    want = plain(libraries, texts)
    assert [(x[0], x[1], x[2], x[3]) for x in rows] == [(w[0], w[1], w[2], w[6]) for w in want]
    assert int(sizes.sum()) == len(links) == sum(w[3] for w in want)


def test_forgetting(libraries, monkeypatch):
    monkeypatch.setattr(crosstok, "REMEMBERED", 3)
    texts = ["some words here", "and other words there", "日本 x", "some more"]
    for _ in range(3):
        assert [x[3] for x in libraries[2].align(texts)[0]] == [w[6] for w in plain(libraries, texts)]


def test_rank_and_select():
    r = np.random.default_rng(0)
    a, b = r.integers(1, 9, 500), r.integers(1, 9, 900)
    size = int(min(a.sum(), b.sum()))
    trim = lambda x: np.append(x[: np.searchsorted(np.cumsum(x), size)], size - np.cumsum(x)[np.searchsorted(np.cumsum(x), size) - 1])
    a, b = trim(a), trim(b)
    places, ra, rb = crosstok.shared_cuts(a, b, size)
    ea, eb = np.cumsum(a), np.cumsum(b)
    both = np.intersect1d(ea, eb)
    assert (places == both - 1).all()
    assert (ra == np.searchsorted(ea, both) + 1).all() and (rb == np.searchsorted(eb, both) + 1).all()


def test_query_as_defined(spark, libraries):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op13_alignment"](spark, d).select(*COLUMNS).collect()}
    assert [got[i] for i in docs] == plain(libraries, list(docs.values()))
