"""Ids of the public word vocabulary, through a cache of words.

The vocabulary's pre-tokeniser never joins characters across white space, so a
text's ids are its words' ids in a row, and each distinct word is tokenised
once. New words go to the tokeniser many in a text. Words of letters alone (and a
closing stop, which is a token of its own) are told apart by the tokens that end
a run of letters; other words get a mark between them that is one token, and
words that hold the mark go alone.
"""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.common import worker_slot

#: Characters that close a word of letters and are a token of their own.
STOPS = ",.;:!?"
MARKS = "\U0001f937\U0001f643\U0001f914\U0001f525♥"


class CachedWords:
    """Documents, given as words, to the bytes of their ids; each distinct word once, until the cache is full and starts anew."""

    cache: dict[bytes, bytes]
    limit: int

    def learn(self, words) -> None:
        """Adds new words to the cache."""
        raise NotImplementedError

    def __call__(self, docs: list[list[bytes]]) -> list[bytes]:
        """The ids of each document, given as words."""
        return [b"".join(parts) for parts in self.by_word(docs)]

    def by_word(self, docs: list[list[bytes]]) -> list[list[bytes]]:
        """The ids of each word of each document."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        self.learn(set().union(*docs).difference(self.cache))
        get = self.cache.__getitem__
        return [list(map(get, words)) for words in docs]


class Subwords(CachedWords):
    """Ids of the word vocabulary, little-endian of type ``kind``."""

    def __init__(self, path: str, kind: str = "<u4", cache_words: int = 350_000, in_a_text: int = 2000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism here
        from tokenizers import Tokenizer

        self.model, self.kind, self.limit, self.many = Tokenizer.from_file(path), kind, cache_words, in_a_text
        self.size = self.model.get_vocab_size()
        self.cache: dict[bytes, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.is_end = np.zeros(self.size, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.stops = {c: np.array(i, self.kind).tobytes() for c in STOPS if len(i := self.ids(c)) == 1}
        self.mark, self.mark_id = next(((m, i[0]) for m in MARKS if len(i := self.ids(m)) == 1), (None, None))

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def learn(self, words) -> None:
        rest, cores, closed = [], {}, []
        for w in words:
            text = w.decode("utf-8", "replace")
            if text.isalpha():
                cores[w] = text
            elif text[-1] in self.stops and text[:-1].isalpha():
                closed.append(w)
                if w[:-1] not in self.cache:
                    cores[w[:-1]] = text[:-1]
            else:
                rest.append(w)
        names = list(cores)
        for k, ids in zip(range(0, len(names), self.many), self._encoded(list(cores.values()), " ")[1], strict=True):
            group = names[k : k + self.many]
            cut = np.flatnonzero(self.is_end[ids]) + 1
            if len(cut) == len(group):
                self.cache.update(zip(group, self._parts(ids, [0, *cut[:-1]], cut), strict=True))
            else:  # normalising has split a run of letters
                rest += group
        for w in closed:
            if (core := self.cache.get(w[:-1])) is None:
                rest.append(w)
            else:
                self.cache[w] = core + self.stops[chr(w[-1])]
        alone = [w for w in rest if self.mark is None or self.mark.encode() in w]
        marked = [w for w in rest if self.mark is not None and self.mark.encode() not in w]
        for group, ids in zip(*self._encoded([w.decode("utf-8", "replace") for w in marked], f" {self.mark} "), strict=True):
            cut = np.flatnonzero(ids == self.mark_id)
            for text, part in zip(group, self._parts(ids, [0, *(cut + 1)], [*cut, len(ids)]), strict=True):
                self.cache[text.encode()] = part
        for w in [*alone, *(w for w in marked if w not in self.cache)]:
            self.cache[w] = np.array(self.ids(w.decode("utf-8", "replace")), self.kind).tobytes()

    def _encoded(self, words: list[str], between: str) -> tuple[list[list[str]], list[np.ndarray]]:
        groups = [words[k : k + self.many] for k in range(0, len(words), self.many)]
        found = self.model.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
        return groups, [np.array(e.ids, self.kind) for e in found]

    @staticmethod
    def _parts(ids: np.ndarray, start, stop) -> list[bytes]:
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[a * width : b * width] for a, b in zip(np.asarray(start).tolist(), np.asarray(stop).tolist(), strict=True)]


class BytePairs(CachedWords):
    """Ids of a byte-level rank vocabulary (16 bits); every word is taken with a space before it.

    Where a word begins is seen from the tokens that begin with a space."""

    def __init__(self, path: str, cache_words: int = 350_000, in_a_text: int = 2000) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:  # a file of the installed package, on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit, self.many, self.cache = cache_words, in_a_text, {}
        self.size = max(ranks.values()) + 2  # and one for the end of a text
        self.is_start = np.zeros(self.size, bool)
        self.is_start[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def learn(self, words) -> None:
        words = list(words)
        for k in range(0, len(words), self.many):
            group = words[k : k + self.many]
            ids = np.array(self.model.encode_ordinary(" " + b" ".join(group).decode("utf-8", "replace")), "<u2")
            at = np.flatnonzero(self.is_start[ids])
            if len(at) == len(group):
                raw = ids.tobytes()
                self.cache.update(zip(group, [raw[a:b] for a, b in zip((2 * at).tolist(), [*(2 * at[1:]).tolist(), len(raw)], strict=True)], strict=True))
            else:  # a word holds white space of another kind
                for w in group:
                    self.cache[w] = np.array(self.model.encode_ordinary(" " + w.decode("utf-8", "replace")), "<u2").tobytes()


def byte_pairs(path: str) -> BytePairs:
    return worker_slot(("byte pairs", path), lambda: BytePairs(path))


def subwords(path: str, kind: str = "<u4") -> Subwords:
    """One for each worker, so that its cache outlives a task."""
    return worker_slot(("subwords", path, kind), lambda: Subwords(path, kind))


def words_of(text: bytes | None) -> list[bytes]:
    """Words whose ids in a row are the text's.

    A-Z is folded first, as the vocabulary does, unless a combining mark (U+0300 to
    U+037F) might compose with such a letter, or the text may name a special token.
    """
    if not text:
        return []
    return text.split() if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower().split()
