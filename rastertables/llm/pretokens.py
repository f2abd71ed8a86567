"""Chunks of a text that byte-level split patterns never cross, and a bounded memory of what workers computed for them."""
from __future__ import annotations

import re

#: Characters with the Unicode property White_Space, as a character class (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of non-white characters with the space before it, or white space up to the one that belongs to the next run.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
ENTRIES, CHARS = 350_000, 32


def explicit_pattern(pattern: str) -> str:
    """The split pattern with \\s and \\S written out, so that every regex engine sees the same white space."""
    return pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")


class Remembered(dict):
    """What a worker has computed for short keys, up to a fixed number of entries; beyond that it computes anew."""

    def __init__(self, compute, entries: int = ENTRIES, chars: int = CHARS):
        super().__init__()
        self.compute, self.entries, self.chars = compute, entries, chars

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.entries and len(key) <= self.chars:
            self[key] = value
        return value


def per_chunk(text: str, bare: dict, spaced: dict) -> list:
    """The values of a text's chunks in order. `bare` is asked by whole chunk, `spaced` by the chunk without its leading
    space. Texts whose white space is single spaces and newlines between words are cut by plain splits, others by CHUNK."""
    if " ".join(text.split()) != text.replace("\n", " "):
        return list(map(bare.__getitem__, CHUNK.findall(text)))
    out, newline = [], bare["\n"]
    for line in text.split("\n"):
        words = line.split(" ")
        out.append(bare[words[0]])
        out += map(spaced.__getitem__, words[1:])
        out.append(newline)
    out.pop()
    return out
