"""BPE against the tokenizers library, round trips, and unigram counts."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from chronoloom.llm import bpe, token_count  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")


def samples():
    rnd = random.Random(4)
    out = [None, "", " ", "a" * 9000, "<|endoftext|> x<|endoftext|>", "don't  stop\n\n now " * 400, "漢字 かな " * 300, "x \t y" * 500, "é" * 2000, "123 4,5" * 600]
    return out + ["".join(rnd.choice(" ab'<|é \n.1") for _ in range(rnd.randint(0, 5000))) for _ in range(20)]


def test_encoding_equals_the_library(spark):
    texts = samples() + ["twice"] * 3
    df = spark.createDataFrame([(i % 30, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in bpe.encode_documents(df, PATH).collect())
    lib = tokenizers.Tokenizer.from_file(PATH)
    want = sorted((i is None, i or 0, lib.encode(t or "", add_special_tokens=False).ids) for i, t, _ in df.collect())
    assert got == want


def test_round_trip(spark):
    texts = samples()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    want = {r.doc_id: (list(r.ids), got[r.doc_id]) for r in bpe.encode_documents(df, PATH).collect()}
    assert {r.doc_id: (list(r.ids), r.text) for r in bpe.round_trip(df, PATH).collect()} == want


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [50256, 64]), (4, [-1, 64, 10**6]), (5, [None, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(df, PATH).collect()} == {1: "", 2: "", 3: "<|endoftext|>a", 4: "a", 5: "a"}


def test_chunks_are_shared_and_joins_repaired():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    passage = " ".join(word() for _ in range(2000))
    texts = [f"{word()}{passage}{word()}".encode() for _ in range(4)]
    cache = bpe._cache(PATH)
    cache.clear()
    ids, at = bpe.encode_texts(texts, PATH)
    held = len(cache)
    bpe.encode_texts([passage.encode()], PATH)
    assert len(cache) <= held + 2  # only its two ends are new
    lib = tokenizers.Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [lib.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def test_joins_are_encoded_again_until_both_sides_agree(monkeypatch):
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(4000)).encode()
    edges, some, anchors = bpe.chunks(text, bpe.np.array([0, len(text)]))
    assert some.sum() > 10 and not some.all() and any(text[e - 1] != 32 != text[e] for e in edges[1:-1].tolist())  # cuts part words
    lib = tokenizers.Tokenizer.from_file(PATH)
    alone = [i for a, b in zip(edges.tolist(), edges.tolist()[1:]) for i in lib.encode(text[a:b].decode(), add_special_tokens=False).ids]
    want = lib.encode(text.decode(), add_special_tokens=False).ids
    assert alone != want  # so the joins need repair
    cache = bpe._cache(PATH)
    cache.clear()
    ids, at = bpe.encode_texts([text], PATH)
    assert ids.tolist() == want and at.tolist() == [0, len(want)]
    assert len(cache) == some.sum() + some.sum() - 1  # each chunk with boundaries and each join between two of them, once
    ids, at = bpe.encode_texts([b"", text], PATH)
    assert ids.tolist() == want and at.tolist() == [0, 0, len(want)] and len(cache) == 2 * some.sum() - 1  # nothing is encoded twice
    x = lambda *i: bpe.np.array(i, "int32")
    assert bpe._between(x(1, 2, 3), x(1), x(3)).tolist() == [2] and bpe._between(x(1, 3), x(1), x(3)).tolist() == []
    assert all(bpe._between(x(*w), x(1, 2), x(3)) is None for w in ([1, 2], [1, 4, 3], [1, 2, 4], []))
    monkeypatch.setattr(bpe, "_between", lambda *_: None)  # no agreement: the window grows to the whole text
    assert bpe.encode_texts([text], PATH)[0].tolist() == want


def test_passages_without_blanks_are_shared():
    rnd = random.Random(2)
    part = lambda: "".join(chr(rnd.choice([rnd.randint(0x5000, 0x8FFF), rnd.randint(0x3041, 0x307F)])) for _ in range(rnd.randint(3, 20)))
    passage = "".join(part() + rnd.choice("、。，！？") for _ in range(600))
    texts = [(part() + passage + part() + "。龠。x、ー、 。").encode() for _ in range(4)]
    cache = bpe._cache(PATH)
    cache.clear()
    ids, at = bpe.encode_texts(texts, PATH)
    assert sum(map(len, cache)) < 2 * len(texts[0])
    lib = tokenizers.Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [lib.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def unigram(vocabulary, byte_fallback):
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram(list(vocabulary), 0, byte_fallback=byte_fallback))
    lib.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lib


def test_token_counts_equal_the_library(spark):
    texts = samples()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    lib = unigram(token_count.load_vocabulary(PIECES), True)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, PIECES).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknown_characters(fallback):
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -1.5)]
    if fallback:
        vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
    lib, counter = unigram(vocabulary, fallback), token_count.Counter(vocabulary, fallback)
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("abé漢 ") for _ in range(rnd.randint(0, 12)))
        assert token_count.count_text(text, counter) == len(lib.encode(text, add_special_tokens=False).ids), text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none, PATH).count() == 0 and token_count.count_tokens(none, PIECES).count() == 0
