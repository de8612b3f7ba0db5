"""Per-process tokenizers with a bounded cache from a piece of text to its ids."""

from __future__ import annotations

import array
import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that one worker process keeps; about 200 bytes each.
CACHE_ENTRIES = 600_000

_loaded: dict = {}


def tokenizer(path: str):
    """The library's tokenizer for a file, loaded once per process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    """Where this machine keeps the vocabulary file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter by which byte-level tokenizers write each byte: itself where it shows, else one after 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = _byte_letters()
#: Letters that are one lower-case letter each, in one way of writing, with a mark or without.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch


class WordIds(dict):
    """word -> packed ids, for tokenizers that drop white space.

    Such a tokenizer never joins text across ASCII white space, so the ids of
    a text are the ids of its words one after another, and a word needs
    encoding once. Of two generations of words the older one goes when the
    younger is full, so that words in use stay.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.lib, self.entries, self.old = tokenizer(path), entries // 2, {}
        made = json.loads(self.lib.to_str())
        cuts = [c["type"] for c in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        lowers = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        if cuts != ["Split", "ByteLevel"] or lowers != ["NFC", "Replace", "Lowercase"] or made["post_processor"]:
            raise ValueError(f"{path} is not a lower-casing vocabulary that drops white space")
        self.code = "H" if self.lib.get_vocab_size() <= 1 << 16 else "I"
        self.pieces = self.lib.model.tokenize
        self.marks = {m: self.packed(self.lib.encode(m, add_special_tokens=False).ids) if m else b"" for m in ("", ".", ",")}

    def packed(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            if simple := _SIMPLE(text):
                # the tokenizer lowers a run of letters and parts marks from it
                letters, mark = simple[1].lower(), simple[2]
                if not letters.isascii():
                    letters = "".join(map(_LETTERS.__getitem__, letters.encode()))
                ids = self.packed([t.id for t in self.pieces(letters)]) + self.marks[mark]
            else:
                ids = self.packed(self.lib.encode(text, add_special_tokens=False).ids)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, texts: list[str]) -> list[bytes]:
        """For each text the packed ids."""
        get = self.__getitem__
        return [b"".join(map(get, t.encode().split())) for t in texts]


#: Unicode White_Space, as the byte-level pattern's \s has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts only where the byte-level pattern also begins a new piece.
_CUTS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")


def pre_tokens(text: str) -> list[str]:
    """Runs without white space, each with the one space before it; other white space apart.

    A byte-level tokenizer with the usual pattern encodes each of these by itself.
    """
    return _CUTS.findall(text)


_counters: dict = {}


class PreTokens:
    """Cuts texts where a byte-level tokenizer with the usual pattern begins a piece that it encodes by itself."""

    def __init__(self, path: str):
        lib = tokenizer(path)
        made = json.loads(lib.to_str())
        cut = made["pre_tokenizer"] or {}
        if made["normalizer"] or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError(f"{path} is not a byte-level vocabulary with the usual pattern")
        special = sorted((t.content for t in lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None

    def of(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, without its special strings, and how many of those it has."""
        if self.cut is None or not self.cut.search(text):
            return pre_tokens(text), 0
        parts = self.cut.split(text)
        return [p for part in parts for p in pre_tokens(part)], len(parts) - 1


def kept(kind, path: str):
    """One instance per process, so that its cache serves later tasks too."""
    if (kind, path) not in _counters:
        _counters[kind, path] = kind(path)
    return _counters[kind, path]


def slices(items: list, sizes: list[int], most: int = 8_000_000):
    """Index ranges whose sizes add up to about `most`, one item at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)
