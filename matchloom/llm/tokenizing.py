"""Token ids of a Hugging Face BPE file, worked out once for each distinct chunk between white space, and in it for each
distinct pre-token.

A text of ASCII and Latin-1 letters, whose classes are certain, is cut into pre-tokens by the tokenizer's
own pattern. In other texts this holds for the chunks between white space, across which the tokenizer never
joins characters; a chunk with any other character is one pre-token here and encoded by the library.
Ids of chunks and pre-tokens come from one bounded cache, as do the numbers of pre-tokens' ids from another. Texts that hold one of the special strings are encoded
whole by the library, and so are all texts where the file's normalizer and pre-tokenizer are others than those
that this module knows."""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode

_ASCII = bytes([*range(9, 14), *range(32, 127)])
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch
_PIECES = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+"
).findall
#: What a file must say of how it normalizes texts and cuts them, for the cutting here to be its own.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Pre-tokens that an encoder keeps, some 150 bytes each.
CACHE = 400_000
#: Longer pre-tokens are encoded but not kept.
LONGEST_KEPT = 64
#: A byte's character in the vocabulary of a byte-level BPE: printable ones stand for themselves.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTE_LEVEL = "".join(chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256))


def _is_plain(text: bytes) -> bool:
    return not (rest := text.translate(None, _ASCII)) or _LATIN(rest) is not None


def pretokens(text: bytes) -> list[bytes]:
    """Pre-tokens of a text with A-Z in lower case; see above."""
    low = text.lower()
    if _is_plain(low):
        return _PIECES(low)
    out = []
    for chunk in low.split():
        if _is_plain(chunk):
            out += _PIECES(chunk)
        else:
            out.append(chunk)
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str | None = None) -> str:
    """The tokenizer file's text, which is small and goes to the executors in a broadcast."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def is_known(tokenizer_json: str) -> bool:
    """Whether the file cuts texts as pretokens does."""
    own = json.loads(tokenizer_json)
    return own.get("normalizer") == _NORMALIZER and own.get("pre_tokenizer") == _PRE_TOKENIZER and own.get("model", {}).get("type") == "BPE"


class _Cache(dict):
    """Bounded: when it holds half its limit, what it has becomes the older half and is asked before a value is
    made again, so that what is met often stays."""

    def __init__(self, make, limit: int, seed: dict | None = None):
        super().__init__(seed or {})
        self.make, self.seed, self.older = make, seed or {}, {}
        self.half = max(1, limit // 2) + len(self.seed)

    def __missing__(self, key: bytes):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
                self.update(self.seed)
            self[key] = value
        return value


class ChunkEncoder:
    """Gives each text's ids as little-endian unsigned 32-bit bytes, or their number.

    seed: numbers of tokens of pre-tokens that are looked up first (counting only)."""

    def __init__(self, tokenizer_json: str, cache: int = CACHE, seed: dict[bytes, int] | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.plain = Tokenizer.from_str(tokenizer_json)
        self.plain.encode_special_tokens = True
        self.model = self.plain.model
        self.known = is_known(tokenizer_json)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.ids_of = _Cache(self._chunk, cache)
        self.count_of = _Cache(lambda c: len(self._encoded(c)) >> 2, cache, seed)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _encoded(self, pretoken: bytes) -> bytes:
        if pretoken.isalpha():  # of bytes: ASCII letters alone
            return self._packed([t.id for t in self.model.tokenize(pretoken.decode("ascii"))])
        text = pretoken.decode("utf-8", "replace")
        if not _is_plain(pretoken):
            return self._packed(self.plain.encode(text, add_special_tokens=False).ids)
        low = charmap_decode(text.lower().encode(), "strict", _BYTE_LEVEL)[0]
        return self._packed([t.id for t in self.model.tokenize(low)])

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids of a chunk without white space, A-Z in lower case; those of its pre-tokens come from the cache."""
        if chunk.isalpha():
            return self._encoded(chunk)
        if chunk[-1] < 128 and chunk[:-1].isalpha():  # a word and a mark or a digit: no contraction
            return self.ids_of[chunk[:-1]] + self.ids_of[chunk[-1:]]
        if len(parts := pretokens(chunk)) == 1:
            return self._encoded(chunk)
        return b"".join(map(self.ids_of.__getitem__, parts))

    def _is_whole(self, text: bytes) -> bool:
        """Whether the library has to see the text as it is."""
        return not self.known or any(s in text for s in self.special)

    def ids(self, text: bytes) -> bytes:
        if self._is_whole(text):
            return self._packed(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return b"".join(map(self.ids_of.__getitem__, text.lower().split()))

    def count(self, text: bytes) -> int:
        if self._is_whole(text):
            return len(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return sum(map(self.count_of.__getitem__, pretokens(text)))


def id_bytes(tokenizer_json: str) -> int:
    """Bytes that hold any of the file's ids: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 1 << 16 else 4


_own: dict[tuple, ChunkEncoder] = {}


def worker_encoder(tokenizer_json: str, cache: int = CACHE, name: str = "", seed: dict[bytes, int] | None = None) -> ChunkEncoder:
    """This Python process's encoder, with what it has cached in earlier tasks; the last one asked for is kept.

    name tells one seed from another."""
    key = (hash(tokenizer_json), cache, name)
    if key not in _own:
        _own.clear()
        _own[key] = ChunkEncoder(tokenizer_json, cache, seed)
    return _own[key]
