import zlib

import numpy as np
import pytest
import zstandard
from seedloom.llm.packing import pack
from seedloom.llm.token_counts import packed_bag, token_counts, unpacked_bag
from seedloom.llm.tokenizing import slices, tokenizer, vocabulary_path

TEXTS = [
    "Hello  world, it's\n\nfine.",
    "",
    None,
    "a <|endoftext|> b  <|endoftext|>c <|ENDOFTEXT|>. <|endoftext|>, It'S. a.b. DON'T, 'S. x., 1. 12, é. É,",
    " \t lead\x0b and trail \n",
    "num 12345 x y z \x1c\x85 q",
    "Éá ß ΣΑΣ é",
    "long " * 3000,
    "long " * 3000,
    "   ",
    "x" * 500,
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "y"), (3, TEXTS[0], 1, "y")], "doc_id long, text string, n_tokens int, part string").repartition(3)


def test_counts_are_the_librarys(docs):
    lib = tokenizer(vocabulary_path("byte_bpe_50k.json"))
    got = token_counts(docs).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_blocks_don_t_change_counts(docs):
    whole = sorted(map(str, token_counts(docs).collect()))
    assert whole == sorted(map(str, token_counts(docs, block=20).collect())) == sorted(map(str, token_counts(docs.repartition(1), block=1).collect()))


def test_bags_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        numbers = rng.permutation(1 << 17)[:n].tolist()
        counts = rng.integers(1, 1 << 20, n).tolist()
        got = unpacked_bag(packed_bag(numbers, counts, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())
        assert dict(zip(*map(np.ndarray.tolist, got))) == dict(zip(numbers, counts))


def test_long_texts(spark):
    lib = tokenizer(vocabulary_path("byte_bpe_50k.json"))
    texts = ["word " * 200_000, "x" * 20_000, "- " * 100_000, "a<|endoftext|>" * 20_000, "\n" * 100_000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    packs = pack(df).groupBy("doc_id").agg({"length": "sum"}).collect()
    lib = tokenizer(vocabulary_path("word_bpe_49k.json"))
    assert {r[0]: r[1] for r in packs} == {i: 1 + len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_vocabularies_of_another_kind_are_refused(docs):
    with pytest.raises(ValueError):
        token_counts(docs, "word_bpe_49k.json")
    with pytest.raises(ValueError):
        pack(docs, vocabulary="byte_bpe_50k.json")


def test_pack_loses_no_id(docs):
    lib = tokenizer(vocabulary_path("word_bpe_49k.json"))
    pieces = pack(docs, length=64).collect()
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    place = 0
    for s, o, n in at:  # gapless
        assert s * 64 + o == place and o + n <= 64
        place += n
    whole: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        whole.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    ids = {}
    for r in docs.collect():
        x = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        ids.setdefault((r.doc_id, len(x)), []).append(x)
    assert whole.keys() == ids.keys()
    for k, ps in whole.items():
        x = ids[k][0]
        assert sum(p.length for p in ps) == len(x) * len(ids[k])
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes())


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none).count() == 0 and token_counts(none).count() == 0


def test_slices():
    assert list(slices([1, 2, 3], [5, 5, 5], 9)) == [(0, 1), (1, 2), (2, 3)]
    assert list(slices([], [])) == []
