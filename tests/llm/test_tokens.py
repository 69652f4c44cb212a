"""The memo gives the ids of an untouched tokenizer."""

import random
import struct

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tessera.llm.tokens import Encoder, public_path

VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
PIECES = [*"aZ9 .!s#", "\t", "\n", "\r", *map(chr, (0x1C, 0x85, 0xA0, 0xDF, 0xE9, 0x130, 0x301, 0x3000)), "the", " the", "  ", "\n\n", "'s", "<|endoftext|>"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)


def library(name):
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(public_path(name))

    def ids(text):
        found = untouched.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    return ids


@pytest.mark.parametrize(("name", "spaced"), VOCABULARIES)
def test_same_ids(name, spaced):
    ours, theirs = Encoder(public_path(name), spaced), library(name)

    @settings(max_examples=400, deadline=None)
    @example("\n\n the")
    @example("a\n\n the\n\nend")
    @example("one<|endoftext|> two")
    @given(TEXTS)
    def check(text):
        assert ours.of(text) == theirs(text)
        assert ours.of(text) == theirs(text)

    check()
    assert ours.of(None) == ours.of("") == b""


@pytest.mark.parametrize(("name", "spaced"), VOCABULARIES)
def test_same_ids_of_many(name, spaced):
    """Words, marks, spaces, line ends and added tokens in 4000 texts, taken together."""
    rng = random.Random(4)
    words = ["the", "L'été", "naïve", "x1y2", "3.14", "can't", "#tag", "你好", "Über-", "(a)", "<|endoftext|>", "<|", "İ", "e\u0301", "don’t", "a_b", "--"]
    spaces = [" "] * 12 + ["\n", "\n\n", "  ", "\n ", " \n", "\t", "\r\n", "", "\n\n\n", "\u00a0"]
    texts = ["".join(rng.choice(spaces) + rng.choice(words) for _ in range(rng.randint(0, 12))) + rng.choice(["", "", " ", "\n", "\n\n"]) for _ in range(4000)]
    theirs = library(name)
    assert Encoder(public_path(name), spaced).ids(texts) == [theirs(t) for t in texts]


def test_stems_are_merged_once():
    """A word with marks after it, and the word met again, take the ids that its letters have; different texts get their own ids."""
    name, spaced = VOCABULARIES[0]
    ours, theirs, asked = Encoder(public_path(name), spaced), library(name), []
    merges = ours.merges
    ours.merges = lambda piece: asked.append(piece) or merges(piece)
    texts = ["so alphonding, alphonding. 'alphonding", "", None, "so alphonding alphonding!\nalphonding (ñalphonding", "\nso", "so  two"]
    assert ours.ids(texts) == [theirs(t or "") for t in texts]
    assert asked.count("Ġalphonding") == 1
