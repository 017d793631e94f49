"""Token ids as little-endian bytes, with a bounded cache of words.

The word BPE used here never lets a token cross ASCII white space, so a text's
ids are the ids of its white-space-separated units laid end to end.  Units
repeat far more often than texts do: each distinct unit is encoded once and its
ids are kept as bytes, which makes a text one ``b"".join`` of dictionary hits.
``tests/llm/test_packing.py`` holds the result against the plain tokenizer.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np

#: Letters (or bytes of non-ASCII characters), then maybe ASCII punctuation other than the apostrophe.
_WORD = re.compile(rb"^([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)$")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest follow U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitEncoder:
    """Encodes texts to bytes of unsigned 32-bit little-endian ids.

    ``cache_units`` bounds the cache; when it is full it is emptied.
    """

    def __init__(self, path: str, cache_units: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_units = cache_units
        self.cache: dict[bytes, bytes] = {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        ids = self.tokenizer.encode("\x00", add_special_tokens=False).ids
        probe = self.tokenizer.encode("a \x00 b", add_special_tokens=False).ids
        plain = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in "ab"]
        # Only a tokenizer that splits at white space and folds ASCII case may use units.
        self.by_unit = (
            len(ids) == 1
            and probe == plain[0] + ids + plain[1]
            and self.tokenizer.encode("A\n\tB", add_special_tokens=False).ids == plain[0] + plain[1]
            and all(
                [x.id for x in self.model.tokenize(b.encode().decode("latin-1").translate(self.letters))]
                == self.tokenizer.encode(b, add_special_tokens=False).ids
                for b in ("letters", "größe", "été")
            )
        )
        self.separator = ids[0] if self.by_unit else -1

    def plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode_units(self, units: list[bytes]) -> None:
        for at in range(0, len(units), 200):
            some = units[at : at + 200]
            text = b" \x00 ".join(some).decode("utf-8")
            ids = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.separator)
            starts, ends = [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)]
            raw = ids.tobytes()
            for unit, a, b in zip(some, starts, ends, strict=True):
                self.cache[unit] = raw[4 * a : 4 * b]

    def _word(self, word: bytes) -> bytes | None:
        """Ids of a word that is one pre-token and unchanged by normalizing; None for others."""
        if word.isalpha():
            text = word.decode("ascii")
        else:
            text = word.decode("utf-8")
            if not text.isalpha() or text.lower() != text or not unicodedata.is_normalized("NFC", text):
                return None
            text = word.decode("latin-1").translate(self.letters)
        return _packed([x.id for x in self.model.tokenize(text)])

    def _learn(self, missing: set[bytes]) -> None:
        cache, direct, joined = self.cache, set(), []
        for unit in missing:
            m = _WORD.match(unit)
            head = m and (cache.get(m[1]) or self._word(m[1]))
            if not head:
                direct.add(unit)
            elif m[2]:
                cache[m[1]] = head
                joined.append((unit, head, m[2]))
                if m[2] not in cache:
                    direct.add(m[2])
            else:
                cache[unit] = head
        self._encode_units(sorted(direct))
        for unit, head, tail in joined:
            cache[unit] = head + cache[tail]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """One bytes object per text."""
        if not self.by_unit:
            return [self.plain(x) for x in texts]
        if len(self.cache) > self.cache_units:
            self.cache.clear()
        out: list[bytes] = []
        block: list[list[bytes] | str] = []
        size = 0
        for text in texts:
            if "<|" in text or "\x00" in text:  # a special token's string or the separator
                block.append(text)
            else:
                block.append(text.encode("utf-8", "replace").lower().split())
                size += len(text)
            if size > 500_000:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, block: list[list[bytes] | str]) -> list[bytes]:
        cache = self.cache
        missing = set().union(*(x for x in block if not isinstance(x, str))).difference(cache)
        if missing:
            self._learn(missing)
        get = cache.__getitem__
        return [self.plain(x) if isinstance(x, str) else b"".join(map(get, x)) for x in block]
