"""Both encoders against the tokenizers library over generated strings."""

import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest

from transect.llm.encoders import _MARKS, UnitEncoder, load

SPACES = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ", " ", " ", " ", "　", "﻿", "  ", "\n\n", " \n", "\r\n"]
UNITS = ["hello", "a", "World", "it's", "we'LL", "'", "x,", "(y)", "10", "3.5", "é", "é", "ΣΑΣ", "straße", "日本語", "ниже", "½", "<|endoftext|>", "<|startoftext|>x", "<|", "|>", "...", "a\"b", "\U0001f600", "̸=", "Ǆ", "HANGİSİ", "İ", "\u0958", "\u0915\u093c", "\u09dc", "\u0a5e", "\u0b5c", "\u0f43", "\ufb2a", "\ufb4e", "का", "ব", "שלום", "İ?", "\u0958!", "\u09dd)", "\ufb31\""]
HARD = ["hello world\t", "hello\r", " a\tb", "a\xa0b c\n", "a  b", " a", "a ", "a \nb", "a\n b", "\n\n", "\t\n", "\x1c", "", "a\x85b", "a b　", "﻿a b"]


def strings(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        gaps = SPACES if rng.random() < 0.6 else SPACES[:5]
        out = [rng.choice(gaps)] if rng.random() < 0.3 else []
        for _ in range(rng.randint(1, 6)):
            out += [rng.choice(UNITS), rng.choice(gaps)]
        yield "".join(out if rng.random() < 0.3 else out[:-1])


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_any_white_space(name, byte_level):
    path = public_tokenizers.path(name)
    texts = HARD + list(strings(100_000, 5))
    encoder, library = UnitEncoder(path, byte_level), load(path)
    wrong = []
    for a in range(0, len(texts), 10_000):
        part = texts[a : a + 10_000]
        want = [np.array(e.ids, np.uint32).tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        wrong += [t for t, w in zip(part, want, strict=True) if encoder.encode(t) != w]
    assert not wrong, (len(wrong), wrong[:10])


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_character_before_every_mark(name, byte_level):
    """All code points, alone and after a letter, before a mark that is cut off a word; those that a normalizer changes before each of them."""
    path = public_tokenizers.path(name)
    encoder, library = UnitEncoder(path, byte_level), load(path)
    every = [chr(c) for c in range(0x21, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not (0x30000 <= c < 0xE0000 or c >= 0xE0200)]
    wrong = []
    changed = [c for c in every if unicodedata.normalize("NFC", c).lower() != c]
    for mark in _MARKS:
        chars = every if mark == "?" else changed
        texts = ["".join(f"{a}{mark} x{a}{mark} " for a in chars[k : k + 200]).strip() for k in range(0, len(chars), 200)]
        want = [np.array(e.ids, np.uint32).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        wrong += [(mark, t[:20]) for t, w in zip(texts, want, strict=True) if encoder.encode(t) != w]
    assert not wrong, (len(wrong), wrong[:10])
