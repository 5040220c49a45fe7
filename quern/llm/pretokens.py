"""Cutting texts for byte-level BPE where no token can cross.

The byte-level pattern looks only ahead, so cutting a text at a place where one of its matches ends
leaves all matches as they are. A single space before a non-space is such a place. A text is
therefore split at its spaces, and the pieces, which repeat, are encoded once for each memo.
"""

from __future__ import annotations

import functools
import json
import re

#: Fixed values of the byte-level pre-tokenizer: its pattern, with the Unicode White_Space characters spelt out.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+"

#: A space between two other spaces: the run of spaces it is in is cut elsewhere.
_INSIDE = re.compile(r"\s \s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next above 255."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Each id's bytes; an added token's are its text."""
    of = {c: b for b, c in enumerate(byte_letters())}
    j = description(path)
    vocab = j["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in j["added_tokens"])]))
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    for a in j["added_tokens"]:
        out[a["id"]] = a["content"].encode()
    return out


def pieces(text: str) -> list[str] | None:
    """``text`` split at its spaces, or None if the space runs in it make that inexact."""
    return None if uneven(text) else text.split(" ")


def uneven(text: str) -> bool:
    """Whether the space runs in ``text`` make it inexact to split it at its spaces."""
    return "  " in text or text.endswith(" ") or _INSIDE.search(text) is not None


def slices(texts: list, most: int = 6_000_000):
    """(from, to) over ``texts`` so that each slice holds about ``most`` characters at most."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= most:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
