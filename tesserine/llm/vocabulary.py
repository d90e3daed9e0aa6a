"""What comes before byte-pair merging in vocabularies with an end-of-word mark: special strings, normal form and split pattern."""

from __future__ import annotations

import json
import unicodedata

import regex

# FIXED VALUES: white space of the vocabulary's split pattern, and its alternatives. They must be as the library has them.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """A tokenizer file. ``by_word``: white space is dropped and never joined with anything, so runs between ASCII white space are encoded by themselves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model, norm = spec["model"], spec["normalizer"] or {}
        kinds = [n["type"] for n in norm.get("normalizers", ())]
        self.by_word = self.model["type"] == "BPE" and bool(self.model.get("end_of_word_suffix")) and not self.model.get("unk_token") and kinds == ["NFC", "Replace", "Lowercase"]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings that are merged each by itself."""
        text = text.lower() if text.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return self.split.findall(text)
