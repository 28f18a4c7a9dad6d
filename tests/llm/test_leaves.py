"""How often the encoder is called for one text."""

import public_tokenizers

from gridloom.llm import bpe


def test_long_texts_take_few_calls():
    encode = bpe.encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).encode_ordinary
    text = " ".join(f"word{i} of, été {i % 7}\n" for i in range(6_000))[:100_000]
    calls = []

    def noted(part):
        calls.append(len(part))
        return encode(part)

    assert bpe.encode_tree(text, noted).tolist() == encode(text)
    assert len(calls) <= 125 and sum(calls) < 1.05 * len(text)
    calls.clear()
    assert bpe.encode_tree(text[:4_000], noted).tolist() == encode(text[:4_000]) and calls == [4_000]
