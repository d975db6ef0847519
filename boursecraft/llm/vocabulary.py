"""Byte-level BPE vocabulary files: their tables, and how they cut text into pieces.

The tables are broadcast: their size is that of the vocabulary file, a few megabytes, whatever
the data. Each worker keeps the broadcast's ``memo`` of words it has already worked out, up to
``MEMO_ENTRIES``; it only saves time and is dropped when full.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

MEMO_ENTRIES = 400_000

#: The published pre-tokenizer of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space besides the four characters that pieces are cut at.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PIECE = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next letters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def load(path: str) -> dict:
    """Plain tables of a byte-level BPE file: token bytes by id, ids, merges, special strings.

    ``merges`` gives for the bytes of a merged token the length of its left part and its rank.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merged = bytes(letters[c] for c in left + right)
        merges.setdefault(merged, (len(left), rank))
    return {"ids": ids, "merges": merges, "special": special, "memo": {}}


def pieces(text: str) -> list[str]:
    """Cut before white space that follows something else: no token of the library spans such a cut.

    Other than the four usual characters, white space would join a run; such a text is one piece.
    """
    if RARE_SPACE.search(text):
        return [text]
    return _PIECE.findall(text)


def ordinary(text: str, special: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Stretches of ordinary text (id -1) and the special strings between them, leftmost longest first."""
    if not special:
        yield text, -1
        return
    at = 0
    for hit in re.finditer("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text):
        if hit.start() > at:
            yield text[at : hit.start()], -1
        yield hit[0], special[hit[0]]
        at = hit.end()
    if at < len(text):
        yield text[at:], -1
