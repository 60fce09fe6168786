"""Texts to token ids through the tokenizers library, a segment at a time.

A tokenizer treats the pieces its pre-tokenizer cuts one by one, so a text may be
cut at any place where it always cuts, and every distinct segment be encoded
once, at its first request; the rest are look-ups.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterable

from series_rank.llm.caches import family, only

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks

CACHE_SEGMENTS = 300_000  # of a generation; there are two
SEPARATE_SEGMENTS = 500_000  # the same where an encoder has one cache in place of two
# White space other than the space and the line feed, and U+0000, the mark used below.
_UNUSUAL = re.compile(
    r"[\x00\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
)
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unusual(text: str) -> bool:
    """Whether a text holds white space other than single spaces and line feeds between visible characters."""
    return bool(
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or text[0] in " \n" or text[-1] in " \n" or _UNUSUAL.search(text)
    )


class Known(dict):
    """Ids (little-endian, unsigned, 32 bits) by segment, made by the library at the first request.

    Two generations bound the memory and keep what is frequent. Letters of the
    Latin blocks, with marks ".," behind them, are always cut apart by the
    pre-tokenizers here, so words go to the library's model without their marks;
    anything else takes the tokenizer's whole way.
    """

    def __init__(self, tokenizer, prefix: str = "", most: int = CACHE_SEGMENTS) -> None:
        super().__init__()
        self.most = most
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer, self.model, self.prefix = tokenizer, tokenizer.model, prefix
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.as_chars = {b: c for c, b in byte_alphabet().items()}
        self.lead = prefix.translate(self.as_chars)
        self.older: dict = {}
        self.tails: dict[str, bytes] = {}

    def renew(self) -> None:
        if len(self) > self.most:
            self.older, self.tails = dict(self), {}
            self.clear()

    def __missing__(self, segment: str | bytes) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            ids = self.fresh(segment if isinstance(segment, str) else segment.decode())
        self[segment] = ids
        return ids

    def fresh(self, segment: str) -> bytes:
        word = segment.rstrip(".,")
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
            return self.whole(segment)
        ids = self.get(word) or self.older.get(word)
        if ids is None:
            plain = word if word.isascii() and word.islower() else self.normalize(word)
            if not plain.isalpha():
                return self.whole(segment)
            chars = self.lead + (plain if plain.isascii() else plain.encode().decode("latin-1").translate(self.as_chars))
            ids = as_bytes([t.id for t in self.model.tokenize(chars)])
        if len(word) < len(segment):
            self[word] = ids
            tail = segment[len(word) :]
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail, "")
            ids += self.tails[tail]
        return ids

    def whole(self, segment: str, prefix: str | None = None) -> bytes:
        text = (self.prefix if prefix is None else prefix) + segment
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


class SpacedEncoder:
    """For byte-level patterns, where a single space joins the word behind it and
    a lone line feed stands alone: both are always cuts. Runs stay whole."""

    def __init__(self, tokenizer) -> None:
        self.bare, self.spaced = Known(tokenizer), Known(tokenizer, " ")
        self.feed = self.bare.whole("\n")

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        self.bare.renew()
        self.spaced.renew()
        return [self.one(t) if t else b"" for t in texts]

    def one(self, text: str) -> bytes:
        if unusual(text):
            return b"".join(self.bare.whole(s) for s in _CUT.split(text) if s)
        spaced, lines = self.spaced.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.bare[words[0]] + b"".join(map(spaced, words[1:])))
        return self.feed.join(lines)


class SeparateEncoder:
    """For tokenizers that drop white space and case: words between ASCII white space, ASCII letters in lower case."""

    def __init__(self, tokenizer) -> None:
        self.known = Known(tokenizer, most=SEPARATE_SEGMENTS)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        self.known.renew()
        known = self.known.__getitem__
        return [b"".join(map(known, t.encode().lower().split())) if t else b"" for t in texts]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others by the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers BPE that merges as the ranks say.

    The neighbours joined first are those whose join has the least rank, so every
    way to cut a token into two tokens is a merge, in the order of the ranks.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    as_char = {b: c for c, b in byte_alphabet().items()}
    word = {t: "".join(map(as_char.__getitem__, t)) for t in ranks}
    merges = [
        (word[t[:k]], word[t[k:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(t))
        if t[:k] in ranks and t[k:] in ranks
    ]
    out = Tokenizer(models.BPE({word[t]: r for t, r in ranks.items()}, merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return out


_ENCODERS: dict = {}
family("tokens", _ENCODERS.clear)


def encoder(path: str, pattern: str | None = None, drops_space: bool = False) -> SpacedEncoder | SeparateEncoder:
    """The encoder of a file (a rank file needs its pattern), built once in a worker."""
    only("tokens")
    key = (path, pattern, drops_space)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        made = tokenizer_from_ranks(ranks_of(path), pattern) if pattern else Tokenizer.from_file(path)
        _ENCODERS[key] = SeparateEncoder(made) if drops_space else SpacedEncoder(made)
    return _ENCODERS[key]


def slices(values: list, most: int = 512) -> Iterable[list]:
    """Runs of a batch, so that the cut form of only some texts is held at a time."""
    for at in range(0, len(values), most):
        yield values[at : at + most]
