"""Splitting text into the words of the public byte-pair tokenizers, exactly as the tokenizers library does.

Both vocabularies merge inside words only, so a text's ids are the ids of its words in order. Words are found by the
tokenizer's own pattern with the ``regex`` library where every character lies in ranges on which that library and the
tokenizers library agree (a test compares them code point by code point); any other text is split by the tokenizers
library itself.
"""

from __future__ import annotations

import re

import regex

#: Characters on which both libraries agree about letters, numbers and white space.
AGREED = regex.compile(r"[\u0000-\u0557\u058d-\u088e\u2000-\u206f\u3000-\ua7cd]*")
#: As above, and NFC and lower-casing change nothing but simple case.
PLAIN = regex.compile(r"[\u0000-\u012f\u0131-\u02ff\u2010-\u2027]*")
#: White space to str.split, but not to the tokenizers.
CONTROLS = re.compile("[\x1c-\x1f]")
#: The patterns of the two tokenizers (fixed values).
BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer without truncation and padding."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t




def _fast(slow: regex.Pattern) -> re.Pattern:
    """``slow`` for the re module, with its classes spelt out over the characters of ``AGREED``."""
    def ranges(name: str) -> str:
        found = regex.findall(rf"{name}+", "".join(c for c in map(chr, range(0xA7CE)) if AGREED.fullmatch(c)))
        spans: list[list[int]] = []
        for c in map(ord, "".join(found)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in spans)

    letters, numbers, spaces = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    text = slow.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    text = text.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    return re.compile(text)


FAST_BYTE_WORDS, FAST_LOWER_WORDS = _fast(BYTE_WORDS), _fast(LOWER_WORDS)


class Numbering(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Splitter:
    """``split(text)`` gives the words; special tokens of the vocabulary are words of their own."""

    def __init__(self, tokenizer):
        self.pre, self.norm = tokenizer.pre_tokenizer, tokenizer.normalizer
        special = sorted((a.content for a in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.mark = "<|"
        self.is_special = set(special)
        self.fast, self.words = (AGREED, FAST_BYTE_WORDS) if self.norm is None else (PLAIN, FAST_LOWER_WORDS)

    def chunks(self, text: str) -> list[str] | None:
        """The parts of a text between white space, lower-cased, where words never reach across it; None if the text needs
        the tokenizer's own rules."""
        if self.norm is None or self.mark in text or not (text.isascii() or self.fast.fullmatch(text)) or CONTROLS.search(text):
            return None
        return text.lower().split()

    def split(self, text: str) -> list[str]:
        if self.special and self.mark in text:
            out: list[str] = []
            for part in self.special.split(text):
                if part in self.is_special:
                    out.append(part)
                elif part:
                    out += self._part(part)
            return out
        return self._part(text)

    def _part(self, text: str) -> list[str]:
        if text.isascii() or self.fast.fullmatch(text):
            return self.words.findall(text if self.norm is None else text.lower())
        if self.norm is None:
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        low = self.norm.normalize_str(text)
        return [low[a:b] for _, (a, b) in self.pre.pre_tokenize_str(low)]


#: The characters that stand for bytes in byte-level vocabularies, by byte (fixed values, by their rule).
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: chr(b) for b in sorted(_KEPT)} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _KEPT)}


_MODELS: dict[int, tuple] = {}


def _model(tokenizer) -> tuple:
    """The tokenizer's word model and its special tokens."""
    key = id(tokenizer)
    if key not in _MODELS:
        special = {a.content: i for i, a in tokenizer.get_added_tokens_decoder().items()}
        _MODELS[key] = (tokenizer.model.tokenize, special, tokenizer)  # the last keeps the id taken
    return _MODELS[key][:2]


def encode_words(tokenizer, words: list[str]) -> list[list[int]]:
    """The ids of words that are not split any further, or are special tokens."""
    tokenize, special = _model(tokenizer)
    out = []
    for w in words:
        if w in special:
            out.append([special[w]])
            continue
        if not (w.isascii() and w.isprintable()) or " " in w:
            w = w.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_CHARS)
        out.append([t.id for t in tokenize(w)])
    return out
