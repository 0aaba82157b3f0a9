"""Words that a worker has coded aren't coded again, and give the same."""

import pyarrow as pa

import public_tokenizers
from folioscope.llm import bpe


def test_kept_words_give_the_same(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [["the lighthouse unwordlike qzxv", "", "aaaa" * 30], ["qzxv the unwordlike harbourish 報告"], ["harbourish qzxv " + "aaaa" * 30, "newword"], ["", ""]]
    for kept in (200_000, 5, 0):
        monkeypatch.setattr(bpe, "KEPT", kept)
        one, asked = bpe.Coder(path, public_tokenizers.PATTERN), []
        learn = one.learn
        monkeypatch.setattr(one, "learn", lambda words, learn=learn, asked=asked: (asked.extend(words), learn(words))[1])
        for batch in texts:
            fresh = bpe.Coder(path, public_tokenizers.PATTERN)
            batch = pa.array(batch, pa.large_string())
            assert [x.tolist() for x in one.code(batch)] == [x.tolist() for x in fresh.code(batch)]
        assert len(one.known) <= kept
        assert asked.count(b" qzxv") == (1 if kept == 200_000 else asked.count(b" qzxv")) and asked.count(b"a" * 120) + asked.count(b" " + b"a" * 120) == 2
