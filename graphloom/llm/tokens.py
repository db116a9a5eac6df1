"""Token ids of whole texts with the lower-casing word vocabulary, quickly.

That tokenizer drops white space, and no merge, normal form or special token of it spans a space or line feed: a text's ids are those of
its space-separated pieces in order. Pieces repeat much, so each worker keeps the ids of those it has met, and encodes only new ones.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words in each of a worker's two generations, the longest that it remembers, and the characters handled at once.
REMEMBERED, LONGEST, AT_ONCE = 250_000, 64, 4 << 20
#: A plain piece: Latin letters that str.lower() and the tokenizer lower alike, one by one, then a run of marks (no quote, bar or bracket
#: that a contraction or special token could begin with). The tokenizer takes the letters as one word, the marks as another.
PLAIN = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]+)(?P<marks>[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)$"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """Two generations: when the younger is full it becomes the older, and what is met again moves back."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def recall(self, key: str) -> bytes | None:
        found = self.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self[key] = found
        return found

    def age(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


class WordIds:
    """Ids of string arrays. Spaces part the texts; the distinct pieces are looked up or encoded, and their ids gathered.

    Plain pieces are a word and marks. Words are encoded many at once, and end at the ids whose token carries the word end.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.others = Memory(remembered), Memory(remembered // 8)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        assert len(cuts) == len(words)
        raw, start, out = ids.tobytes(), 0, []
        for end in cuts.tolist():
            out.append(raw[start:end])
            start = end
        return out

    def _known(self, memory: Memory, encode: Callable[[list[str]], list[bytes]], texts: list[str]) -> list[bytes]:
        """Ids of distinct texts, remembered or encoded now."""
        memory.age()
        found = list(map(memory.get, texts))
        older = [t for t, x in zip(texts, found, strict=True) if x is None]
        if older:
            missing = [t for t in older if memory.recall(t) is None]
            fresh = dict(zip(missing, encode(missing), strict=True)) if missing else {}
            memory.update((t, x) for t, x in fresh.items() if len(t) <= LONGEST)
            found = [x if x is not None else fresh[t] if t in fresh else memory[t] for t, x in zip(texts, found, strict=True)]
        return found

    def _dictionary(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces one after the other, and where each one's begin and the last one's end."""
        parts = pc.extract_regex(pieces, PLAIN)
        plain = parts.is_valid()
        rest = self._known(self.others, self._encode, pieces.filter(pc.invert(plain)).to_pylist())
        matched = parts.filter(plain)
        words, marks = pc.utf8_lower(matched.field("word")).dictionary_encode(), matched.field("marks").dictionary_encode()
        known = [*self._known(self.words, self._encode_words, words.dictionary.to_pylist()), *self._known(self.others, self._encode, marks.dictionary.to_pylist()), *rest, b""]
        pair = np.full((len(pieces), 2), len(known) - 1, np.int64)
        at, n = plain.to_numpy(zero_copy_only=False), len(words.dictionary)
        pair[at, 0], pair[at, 1] = words.indices.to_numpy(), marks.indices.to_numpy() + n
        pair[~at, 0] = np.arange(len(rest)) + n + len(marks.dictionary)
        ids, ends = gathered(known, pair.ravel())
        return ids, ends[::2]

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) one after the other, and where each text's begin and the last one's end. end_id closes each text."""
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        values, begins = self._dictionary(coded.dictionary)
        piece, cuts = coded.indices.to_numpy(), split.offsets.to_numpy()
        cuts = cuts - cuts[0]
        if end_id is not None:
            values, begins = np.append(values, np.uint32(end_id)), np.append(begins, begins[-1] + 1)
            piece = np.insert(piece, cuts[1:], len(begins) - 2)
            cuts = cuts + np.arange(len(cuts))
        ids, ends = taken(values, begins, piece)
        return ids, ends[cuts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit bytes."""
        ids, at = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def taken(values: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[begins[k] : begins[k + 1]] for each k in which, one after the other, and where each begins and the last ends."""
    size = np.diff(begins)[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    small = np.int32 if max(ends[-1], begins[-1]) < 1 << 31 else np.int64
    place = np.repeat((begins[which] - ends[:-1]).astype(small), size)
    place += np.arange(ends[-1], dtype=small)
    return values[place], ends


def gathered(known: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) >> 2)])
    return taken(np.frombuffer(b"".join(known), "<u4"), begins, which)


_loaded: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One for each worker, file and size of memory."""
    if (path, remembered) not in _loaded:
        _loaded[path, remembered] = WordIds(path, remembered)
    return _loaded[path, remembered]


def in_parts(texts: pa.Array, size: int = AT_ONCE):
    """Slices (start, end) of a string array of about so many bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, end
        start = end
