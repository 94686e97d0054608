"""Token ids of whole texts through the tokenizers library, with each distinct word encoded once.

For vocabularies that lower-case and whose pre-tokenizer drops white space (no token ever
spans it), a text's ids are the ids of its words, one after the other. ASCII white space is
therefore the safe boundary at which a text of any length is cut; other white space stays
inside a word and is left to the library. Words met before come from a bounded cache; the
others of a batch go to the library together. Words of plain letters and safe punctuation are
cut further, at the same places as the library's, so their forms share what is cached. Whether a vocabulary is of this kind is read
from its own file; texts go to the library whole, in batches, if it is not.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Collection

import numpy as np
import pyarrow as pa

#: Letters (checked against the table of plain ones), then ASCII punctuation that starts neither a contraction nor a special token.
_CORE = re.compile(r"([^\W\d_]+)([!-&(-/:;=?@\[-`{}~]*)")
_MARKS = b".,!?;:"
_PLAIN_LETTERS = range(0x41, 0x250)
#: Kinds of bytes: white space to cut at, letters, the punctuation of _CORE, all others, first bytes of two that may be a plain letter.
_SPACES, _LETTER, _MARK, _OTHER, _LEAD = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b"\x20\t\n\v\f\r")] = _SPACES
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KINDS[[c for c in range(128) if _CORE.fullmatch("a" + chr(c)) and not chr(c).isalpha()]] = _MARK
_KINDS[0xC2:0xCA] = _LEAD
#: Words that go to the library as one text, between spaces.
_TOGETHER = 1000

#: The normalizer and pre-tokenizer, as tokenizer files state them, that words may be encoded one by one for.
FITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def fits(tokenizer) -> bool:
    """Whether a tokenizer's texts can be encoded word by word: its form is FITTING and its added tokens are like <|name|>."""
    form = json.loads(tokenizer.to_str())
    added = all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in form.get("added_tokens", []))
    return added and form["model"]["type"] == "BPE" and all(form.get(k) == v for k, v in FITTING.items())


class WordEncoder:
    """Encodes by words; value turns a word's ids into what is kept for it, and + joins two of these.

    values, if given, does the same for the ids of many words, of which each ends where ends says.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], max_words: int = 200_000, values: Callable[[list[int], list[int]], list] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.value, self.max_words = value, max_words
        self.values = values or (lambda ids, ends: [value(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)])
        # two generations: what the newer one lacks is taken over from the older, so words met once fall out
        self.words: dict[bytes, object] = {}
        self.older: dict[bytes, object] = {}
        self.by_words = fits(self.tokenizer)
        if not self.by_words:
            return
        # what the library's own normalizer and byte mapping make of each single letter that stays letters
        octets = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        normal = self.tokenizer.normalizer.normalize_str
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = self.model.end_of_word_suffix, self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.plain = {c: octets.pre_tokenize_str(normal(chr(c)))[0][0] for c in _PLAIN_LETTERS if chr(c).isalpha() and normal(chr(c)).isalpha()}
        self.is_plain = np.zeros(1 << 11, bool)
        self.is_plain[list(self.plain)] = True

    def _alone(self, words: list[bytes]) -> list:
        """The values of words of letters, given in the vocabulary's own characters."""
        out: list = []
        cut = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for some, e in zip(cut, self.bare.encode_batch_fast([b" ".join(c).decode() for c in cut], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            # a word's last symbol alone can have the suffix: as many of them as words are one each
            if len(ends) == len(some) and ends[-1] == len(ids):
                out += self.values(ids, ends)
            else:
                out += [self.value(x.ids) for x in self.bare.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
        return out

    def _learn(self, missing: set[bytes]) -> None:
        """Put every word of the set into the cache."""
        words, value, plain = self.words, self.value, self.plain
        alone: dict[bytes, bytes] = {}
        split: list[tuple[bytes, bytes, bytes]] = []
        rest: list[bytes] = []
        for raw in missing:
            # most words are ASCII letters, at most with one mark behind them
            if raw.isalpha():
                alone[raw] = raw.lower()
                continue
            if raw[-1] in _MARKS and raw[:-1].isalpha():
                low, tail = raw[:-1].lower(), raw[-1:]
                if low not in words:
                    alone[low] = low
                if tail not in words and tail not in missing:
                    rest.append(tail)
                split.append((raw, low, tail))
                continue
            m = _CORE.fullmatch(raw.decode("utf-8", "replace"))
            if m and (m[1].isascii() or plain.keys() >= set(map(ord, m[1]))):
                core = m[1].translate(plain).encode()
                if m[2]:
                    # the core is filed as a word in the form it is looked up by: lower case does not change its ids
                    low, tail = m[1].lower().encode(), m[2].encode()
                    if low not in words:
                        alone[low] = core
                    if tail not in words and tail not in missing:
                        rest.append(tail)
                    split.append((raw, low, tail))
                else:
                    alone[raw] = core
            else:
                rest.append(raw)
        words.update(zip(alone, self._alone(list(alone.values())), strict=True))
        rest = list(dict.fromkeys(rest))
        for raw, e in zip(rest, self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in rest], add_special_tokens=False), strict=True):
            words[raw] = value(e.ids)
        for raw, low, tail in split:
            words[raw] = words[low] + words[tail]

    def texts(self, texts: list[bytes], join: Callable) -> list:
        """join(values of a text's words) for each UTF-8 text. Cut texts into slices of bounded size first."""
        if not self.by_words:
            whole = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [join([self.value(e.ids)]) for e in whole]
        cut = [t.split() for t in texts]
        held = set().union(*cut)
        self._load(held, held.difference(self.words))
        get = self.words.__getitem__
        return [join(map(get, ws)) for ws in cut]

    def _load(self, held: Collection[bytes], missing: set[bytes]) -> None:
        """Put those of the distinct words held that are missing into the cache, and all where it starts anew."""
        if len(self.words) + len(missing) > self.max_words:
            self.words, self.older = {}, self.words
            missing = set(held)
        if missing:
            known = self.older.keys() & missing
            self.words.update(zip(known, map(self.older.__getitem__, known), strict=True))
            self._learn(missing - known)

    def _hold(self, held: Collection[bytes]) -> list:
        """The values of these distinct words, all of which are in the cache afterwards."""
        values = list(map(self.words.get, held))
        self._load(held, {w for w, v in zip(held, values, strict=True) if v is None})
        return [self.words[w] if v is None else v for w, v in zip(held, values, strict=True)]

    def packed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each UTF-8 text has, and all ids in order; value has to give ids as 32-bit integers."""
        if not self.by_words:
            out = self.texts(texts, b"".join)
            return np.fromiter((len(x) // 4 for x in out), np.int64, len(out)), np.frombuffer(b"".join(out), np.int32)
        first, words = self._cut(texts)
        encoded = words.dictionary_encode()
        values = self._hold(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        places, which = np.cumsum(sizes) - sizes, encoded.indices.to_numpy()
        n = sizes[which]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        at = np.arange(before[-1]) + np.repeat(places[which] - before[:-1], n)
        return np.diff(before[first]), np.frombuffer(b"".join(values), np.int32)[at]

    def _cut(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """The number of words before each text and in all, and the words that the texts' ids are joined from.

        A word of plain letters and safe punctuation alone is cut into runs of one kind, where
        the pre-tokenizer cuts it, and its A-Z are lower-cased; any other stays as it is.
        """
        joined = b" ".join([*texts, b""])
        data, low = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8)
        kinds = _KINDS[data]
        lead = np.flatnonzero(kinds == _LEAD)
        after = data[lead + 1]
        plain = ((after & 0xC0) == 0x80) & self.is_plain[(data[lead] & 0x1F).astype(np.int64) << 6 | (after & 0x3F)]
        kinds[lead] = np.where(plain, _LETTER, _OTHER)
        kinds[lead[plain] + 1] = _LETTER
        start = np.flatnonzero(np.concatenate((np.ones(1, bool), kinds[1:] != kinds[:-1])))
        kind = kinds[start]
        if (kind == _OTHER).any():
            space = kind == _SPACES
            word = np.cumsum(space)
            whole = np.zeros(word[-1] + 1, bool)
            whole[word[kind == _OTHER]] = True
            whole = whole[word] & ~space
            inner = whole & ~np.concatenate((np.ones(1, bool), space[:-1]))
            low = np.where(np.repeat(whole, np.diff(start, append=len(data))), data, low)
            start, kind = start[~inner], kind[~inner]
        word = kind != _SPACES
        sizes = np.diff(start, append=len(data))[word]
        offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(low[kinds != _SPACES])])
        return np.searchsorted(start[word], begin), words

    def pieces(self, text: bytes, most: int) -> list[bytes]:
        """text cut where its ids can be cut, into pieces of about most bytes: not at all where words don't stand for themselves."""
        return pieces(text, most) if self.by_words else [text]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, most: int) -> list[bytes]:
    """text cut at ASCII white space into pieces of about most bytes; one word is never cut."""
    if len(text) <= most:
        return [text]
    out, i = [], 0
    while i < len(text):
        m = _SPACE.search(text, i + most)
        j = m.start() if m else len(text)
        out.append(text[i:j])
        i = j
    return out
