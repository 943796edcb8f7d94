import zlib
from collections import Counter, defaultdict

import numpy as np

from framekiln.llm import packing


def by_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids + [0], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_ids_equal_the_tokenizer():
    texts = ["", " ", "  two  blanks ", "a\n\n b\t c", "it's we're 'll <|endoftext|> x", "été あい \U0001f600 a b", " lead", "tail ", "x\x1cy \x85z", "1 234  5"]
    ids_of = packing.WordIds(*packing.tokenizer_files())
    for _ in range(2):
        assert [ids_of(t) + b"\0\0\0\0" for t in texts] == [i.tobytes() for i in by_tokenizers(texts)]


def check(rows, want, size):
    """Each id in one piece with its checksum; each sequence gapless and within ``size``."""
    sequences, pieces = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    expected = Counter()
    for id_, ids in want:
        for a in range(0, len(ids), size):
            expected[id_, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes()), len(ids)] += 1
    assert pieces == expected
    return sequences


def test_odd_documents(odd_docs, odd_rows):
    want = list(zip([i for i, _ in odd_rows], by_tokenizers([t for _, t in odd_rows])))
    check(packing.pack_documents(odd_docs).collect(), want, 1024)
    check(packing.pack_documents(odd_docs, *packing.tokenizer_files(), size=64).collect(), want, 64)


def test_no_documents(no_docs):
    assert packing.pack_documents(no_docs).collect() == []


def test_shortest_pack_first_places_every_length():
    rng = np.random.default_rng(1)
    for size in (8, 100, 1024):
        lengths = Counter(rng.integers(1, size + 1, 5000).tolist()) + Counter({1: 3000})
        patterns = packing.shortest_pack_first(dict(lengths), size)
        placed = Counter()
        for count, pattern in patterns:
            assert sum(a * b for a, b in pattern.items()) <= size
            for length, repeats in pattern.items():
                placed[length] += count * repeats
        assert placed == lengths
        total = sum(k * v for k, v in lengths.items())
        assert sum(c for c, _ in patterns) * size < total * 1.02 + 2 * size
        assert len(patterns) <= 2 * size


def test_added_tokens_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext| >", "<|ENDOFTEXT|> a<|endoftext|>  b ", "no token here"]
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoded[0].ids == [64, 220, 50256, 275]
    want = [(i, np.array(e.ids + [0], "<u4")) for i, e in enumerate(encoded)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack_documents(docs).collect(), want, 1024)
    check(packing.pack_documents(docs, *packing.tokenizer_files(), size=3).collect(), want, 3)
