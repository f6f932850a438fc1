"""Encoding with the tokenizers library, word by word.

The vocabulary's rules (checked when it is loaded) drop white space and merge
only inside the pieces between, so a text's ids are those of its white-space
separated words, one after another.  Each worker therefore encodes a word once
and remembers its ids.  It holds two generations of at most ``MEMO_WORDS``
words: when one is full, the older is forgotten, and words still in use move on.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

MEMO_WORDS = 700_000
LONGEST = 200
_loaded: dict[str, "WordEncoder"] = {}


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.splits_words = _drops_space(rules)
        self.marks = {x["content"][:1] for x in rules["added_tokens"]}
        suffix = rules["model"].get("end_of_word_suffix") or "</w>"
        self.ends = np.zeros(self.vocab_size, dtype=bool)
        self.ends[[i for word, i in rules["model"]["vocab"].items() if word.endswith(suffix)]] = True
        self.kind = np.uint16 if self.vocab_size <= 1 << 16 else np.uint32
        self.width = np.dtype(self.kind).itemsize
        self.limit = MEMO_WORDS
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind).tobytes()

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, in one call: each is one piece, of which the last token alone carries the end mark."""
        out: list[bytes] = []
        for k in range(0, len(words), 8192):
            part = words[k : k + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(cut) != len(part):  # a letter that lower case turns into more than letters
                out += map(self._plain, part)
                continue
            raw = ids.tobytes()
            out += map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut))
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Encode words; letters with one point or comma are the letters' ids and the mark's."""
        stems: dict[bytes, str] = {}
        joined: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            text = w.decode("utf-8", "surrogatepass")
            if text.isalpha():
                stems[w] = text
            elif text[-1] in ".," and _stays_letters(text[:-1]):
                joined.append((w, w[:-1], w[-1:]))
                if w[:-1] not in self.now:
                    stems[w[:-1]] = text[:-1]
            else:
                self.now[w] = self._plain(text)
        self.now.update(zip(stems, self._letters(list(stems.values()))))
        for mark in b".", b",":
            if mark not in self.now:
                self.now[mark] = self._plain(mark.decode())
        now = self.now
        now.update([(w, now[stem] + now[mark]) for w, stem, mark in joined])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian integers of type ``kind``."""
        if not self.splits_words:
            return [self._plain(t.decode("utf-8", "surrogatepass")) for t in texts]
        # lower case is one of the vocabulary's rules; special strings have none, and texts with capitals in them are no special strings
        split = [t.lower().split() if self._folds(t) else t.split() for t in texts]
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        new = set().union(*split).difference(self.now)
        known = [w for w in new if w in self.before]
        self.now.update(zip(known, map(self.before.__getitem__, known)))
        new.difference_update(known)
        long = [w for w in new if len(w) > LONGEST]
        if new:
            self._learn(new)
        get = self.now.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in long:
            del self.now[w]
        return out

    def _folds(self, text: bytes) -> bool:
        """Whether A-Z may be folded beforehand: not where that could make a special string."""
        return not any(m.encode() in text for m in self.marks)


def _stays_letters(text: str) -> bool:
    """Whether normal form and lower case leave letters only, by any version of Unicode: Latin, Greek and Cyrillic without letters that decompose."""
    return text.isalpha() and max(text) <= "\u04ff" and text.lower().isalpha()


def _drops_space(rules: dict) -> bool:
    """Whether white space ends every piece and leaves no token."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    norms = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    word_only = drops and r"[^\s" in steps[0]["pattern"].get("Regex", "") and all(not x.get("add_prefix_space") for x in steps[1:])
    return bool(word_only) and set(norms) <= {"NFC", "Replace", "Lowercase"} and not rules.get("post_processor")


def load(path: str) -> WordEncoder:
    """The worker's encoder for ``path``; one thread, as tasks are the threads."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
