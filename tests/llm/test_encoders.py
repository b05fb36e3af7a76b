"""Encoders against the tokenizers library on odd texts, and blocks of every width."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
PIECES = ["a", "Word", "don't", "'s", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "é", "ß", "漢字", "😀", "12", "3.5", ",", ".", "|", "<", "<|", "|>", "<|endoftext|>", "-", "İ", "ǅ", "x" * 40]


@pytest.mark.parametrize("vocabulary,keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_texts_as_the_library_encodes_them(monkeypatch, vocabulary, keep_space):
    from tokenizers import Tokenizer

    from spanloom.llm import encoders

    monkeypatch.setattr(encoders, "MAX_KEPT", 500)  # generations change
    monkeypatch.setattr(encoders, "AT_ONCE", 64)
    draw = random.Random(3)
    texts = ["", *("".join(draw.choice(PIECES) for _ in range(draw.randrange(30))) for _ in range(3000))]
    encoder, library = encoders.Encoder(vocabulary, keep_space), Tokenizer.from_file(P.path(vocabulary))
    for k in range(0, len(texts), 250):
        for text, raw in zip(texts[k : k + 250], encoder.encode(texts[k : k + 250]), strict=True):
            assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_need_no_mark_between_them():
    from spanloom.llm.encoders import Encoder

    encoder = Encoder("byte_bpe_50k.json", True)
    words = [f"{s}{x}" for s in (" ", "\n\n ", " ", "\xa0") for x in ("one", "漢字", "😀", "3.5", "don't", "zqxj" * 9)]
    assert encoder._encode_words(words) == []
    assert [encoder.kept.ids_of(np.array([encoder.kept.place[x]]))[0].tolist() for x in words] == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in words]


def test_a_batch_is_not_in_memory_as_stretches_at_once():
    import tracemalloc

    from spanloom.llm.encoders import Encoder

    encoder = Encoder("word_bpe_49k.json", False)
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(2000)}" for _ in range(600)) for _ in range(1000)]
    encoder.encode(texts[:50])
    tracemalloc.start()
    ids = encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32e6, most  # 3 MB of texts in small words: 600,000 stretches
    assert [ids[i] for i in (0, 499, 999)] == [x for i in (0, 499, 999) for x in encoder.encode([texts[i]])]
    assert encoder.encode([]) == []


@pytest.mark.parametrize("width", range(33))
def test_blocks_of_every_width(width):
    from spanloom.llm.pfor import BLOCK, pack_blocks, unpack_block

    draw = np.random.default_rng(width)
    ids = draw.integers(0, 1 << width, 2 * BLOCK + 7, dtype=np.uint64).astype("<u4")
    ids[::97] = draw.integers(0, 1 << 32, len(ids[::97]), dtype=np.uint64)  # exceptions
    assert np.concatenate([unpack_block(x)[0] for x in pack_blocks(ids)]).tolist() == ids.tolist()
