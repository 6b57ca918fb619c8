"""Token identifiers of whole texts from a public vocabulary file, in bounded memory."""

from __future__ import annotations

import base64
import re

#: Texts longer than this are encoded in parts that meet where a token must begin.
PART_CHARS = 1 << 18
EOD = 2
#: Added tokens of byte_bpe_50k.json: their strings have identifiers of their own wherever they stand in a text. Fixed values.
ADDED = {"<|endoftext|>": 50256}

_ENC: dict = {}
#: A space before a letter, digit or mark of ASCII: the vocabulary's pattern starts a new token there, whatever stands before.
_SAFE = re.compile(r" (?=[!-~])")


def encoder(path: str):
    """The byte-level vocabulary of a .tiktoken rank file; one per process."""
    if path not in _ENC:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENC[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENC[path]


def default_path() -> str:
    """Ranks of the vocabulary of byte_bpe_50k.json; with ADDED the two give equal identifiers, and this form is about four
    times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of about `size` characters; encoding them one by one gives the identifiers of the whole."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(text: str, path: str, added: dict[str, int] | None = None) -> list[int]:
    """Identifiers of a text. added: strings that become one identifier each, and part the text around them; without it
    they are ordinary text."""
    enc = encoder(path)
    if added and any(x in text for x in added):
        out: list[int] = []
        for x in re.split("(" + "|".join(map(re.escape, added)) + ")", text):
            out += [added[x]] if x in added else encode(x, path)
        return out
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]
