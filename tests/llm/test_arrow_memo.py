"""The tokenizer's memo cuts at line feeds and before punctuation, looks each stretch up once, and workers give memory back."""

import struct

from quillspark.llm import arrow, byte_bpe


def ids(coder, text):
    found = coder.tokenizer.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(found)}I", *found)


def test_parts_that_are_known_are_not_encoded_again():
    coder = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    coder.encode(["one two\nThree %%% x"])
    asked = []
    library = coder._library
    coder._library = lambda texts: asked.extend(texts) or library(texts)
    texts = ["one two%%%\nThree two", None, "", "two"]
    got = coder.encode(texts)
    assert got == [ids(coder, t or "") for t in texts]
    assert sorted(asked) == ["%%%", "two"]  # not " two\nThree", " two%%%"


def test_what_was_met_last_stays():
    coder = byte_bpe.Encoder(byte_bpe.default_vocabulary(), limit=100)
    for start in range(0, 600, 15):
        texts = [f"often x{i} seldom{i}\ny{i}!" for i in range(start, start + 15)]
        assert coder.encode(texts) == [ids(coder, t) for t in texts]
        assert len(coder.stretches) == len(coder.ids) == len(coder.used) <= 100
    assert "often" in coder.stretches.to_pylist() and "!" in coder.stretches.to_pylist()


def test_special_tokens_and_long_stretches():
    coder = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    texts = ["a<|endoftext|>.\nb", "x|>! <|endoftext|>", "\n", " ", "it's\n's 't", "é" * 90 + ".", "Ⅷ. ²! 漢。,", "a\nb\n", "\nA"] * 2
    assert coder.encode(texts) == [ids(coder, t) for t in texts]
    assert all(len(x.encode()) <= 64 for x in coder.stretches.to_pylist())


def test_tasks_give_memory_back_at_both_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(arrow, "release", lambda memos: seen.append(("release", memos)))
    monkeypatch.setattr(arrow, "trim", lambda: seen.append("trim"))
    assert list(arrow.lean(lambda rows: (seen.append(r) or r for r in rows), memos=False)(iter([1, 2]))) == [1, 2]
    assert seen == [("release", False), 1, 2, "trim"]
