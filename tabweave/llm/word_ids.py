"""Ids of a tokenizer that drops white space, by a bounded store of words already encoded.

The tokenizer's rule never joins characters over a blank, tab, line feed or
carriage return, so a text's ids are its words' ids in a row. Words repeat far
more often than texts do; only a word not met before goes through the merges.

A text is lower-cased before it is split, which lets more words repeat, only if the tokenizer would make
the same of it: with Latin letters alone (but for the dotted capital I, whose small form is two characters)
and without the beginning of a special token, which the tokenizer looks for in the text as it stands.

Many texts are split at once, as arrays of bytes, and Arrow tells equal words. So a word is looked up once for all its
places among them. New words of small Latin letters, which the tokenizer's rules leave as they are, go to its merges alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_NOT_FOLDED = re.compile("[İɐ-\U0010ffff]")
#: How the tokenizer's special tokens begin.
_SPECIAL = "<|"
#: Letters up to here (Latin, Greek, Cyrillic) are letters for the tokenizer and for Python alike.
_SURE = "԰"
#: Behind a word of letters the tokenizer takes a run of these apart before any merge.
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Letters that the tokenizer's rules leave as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: The characters in which the tokenizer's merges are written, by byte; those that aren't printable come behind all others. A blank stays.
_SHOWN = np.array([b in range(33, 127) or b in range(161, 173) or b >= 174 for b in range(256)])
_WRITTEN = np.where(_SHOWN, np.arange(256), 255 + np.cumsum(~_SHOWN)).astype("<u2")
_WRITTEN[ord(" ")] = ord(" ")
#: Bytes: letters and digits, marks that mostly stand at a word's end, those of them that end a sentence, blanks, line feeds, others.
_OTHER, _ALNUM, _MARK, _STOP, _BLANK, _LINE = range(6)
_CLASS = bytes(
    _ALNUM if chr(b).isalnum() and b < 128 else _STOP if b in b".!?" else _MARK if b in b",;:" else _LINE if b == 10 else _BLANK if b in b" \t\r" else _OTHER for b in range(256)
)
#: What the letters from À to ÿ begin with in UTF-8, and the second bytes of the two signs among them.
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)
#: Bytes of texts that are encoded together.
CHUNK = 1 << 22
#: Words whose ids are copied at a time.
RUN = 1 << 18
#: So many words and bytes are remembered at most by default.
MOST_WORDS, MOST_BYTES = 800_000, 192 << 20
#: New words that are encoded together: the tokenizer holds some hundred bytes for each of their characters meanwhile.
PIECE = 1 << 11
#: What an entry takes beside its characters and ids, and a character.
_ENTRY, _CHAR = 200, 2


def _pieces(words: list[str]) -> Iterator[list[str]]:
    return (words[i : i + PIECE] for i in range(0, len(words), PIECE))


class WordIds:
    """Encodes words with a tokenizers file and remembers up to `most` of them, in about `most_bytes` of memory.

    Two generations are kept: when the young one is full it becomes the old one,
    and words met again move over. Beyond the bound only the words of one chunk of texts are held.
    """

    def __init__(self, path: str, most: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_bytes = Tokenizer.from_file(path), max(1, most // 2), most_bytes // 2
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() >= (1 << 16) - 1 else "<u2")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = piece.endswith("</w>")
        self.plain = self._plain()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young ones

    def _plain(self):
        """The merges alone, over words that are already written in their characters; None where the rules aren't those known."""
        from tokenizers import Tokenizer

        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        split, level = [*(rules["pre_tokenizer"] or {}).get("pretokenizers", []), {}, {}][:2]
        if steps != ["NFC", "Replace", "Lowercase"] or "|[\\p{L}]+|" not in split.get("pattern", {}).get("Regex", "") or level.get("type") != "ByteLevel" or level["add_prefix_space"] or rules["post_processor"]:
            return None
        return Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, letters: list[str], others: list[str]) -> None:
        plain = [w for w in letters if w.isascii() and w.islower() or _PLAIN.fullmatch(w)] if self.plain else []
        for words in _pieces(plain):
            text = " ".join(words)
            text = text if text.isascii() else _WRITTEN[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
            others = self._apart(words, np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)) + others
        if len(plain) < len(letters):
            for words in _pieces(list(set(letters).difference(plain))):
                others = self._apart(words, self._ids([" ".join(words)])[0]) + others
        for words in _pieces(others):
            self.young.update(zip(words, (x.tobytes() for x in self._ids(words)), strict=True))

    def _apart(self, words: list[str], ids: np.ndarray) -> list[str]:
        """Keeps the words' ids, encoded as one text, which is cheaper: with as many word ends as words, each word has one. Else gives the words back."""
        width, start = self.kind.itemsize, 0
        ends = (np.flatnonzero(self.word_end[ids]) + 1) * width
        if len(ends) != len(words):
            return words
        flat, put = ids.tobytes(), self.young
        for word, end in zip(words, ends.tolist(), strict=True):
            put[word], start = flat[start:end], end
        return []

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each of the words, which are distinct; all of them become young."""
        if len(self.young) > self.most or self.held > self.most_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        new = {words[i] for i in missing}
        self.held += _ENTRY * len(new) + 2 * _CHAR * sum(map(len, new))  # ids take less than their characters
        if known := new.intersection(old):
            young.update(zip(known, map(old.__getitem__, known), strict=True))
            new -= known
        letters = list(filter(str.isalpha, new))
        whole: list[tuple[str, str, str]] = []
        more: set[str] = set()
        others: set[str] = set()
        for word in new.difference(letters):
            core = word.rstrip(_PUNCTUATION)
            if core == word or not core.isalpha() or core[-1] >= _SURE or core[-1] == "İ":
                others.add(word)
                continue
            tail = word[len(core) :]
            whole.append((word, core, tail))
            if core not in young and core not in new:
                more.add(core)
            if tail not in young and tail not in new:
                others.add(tail)
        self._encode(letters + list(more), list(others))
        for word, core, tail in whole:
            young[word] = young[core] + young[tail]
        for i in missing:
            found[i] = young[words[i]]
        return found

    def _chunks(self, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
        held, size = [], 0
        for text in texts:
            text = text or ""
            held.append((text if _SPECIAL in text or not text.isascii() and _NOT_FOLDED.search(text) else text.lower()).encode())
            size += len(held[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def _chunk(self, texts: list[bytes], bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all the texts in a row, where each text's end, and where sentences, lines and texts end, ascending.

        Words are bytes between blanks; a mark behind a letter or digit and before a blank is a word of its own, as it is for
        the tokenizer. Arrow tells equal words, so each is looked up once, and its ids are copied to all its places.
        """
        joined = b" ".join(texts) + b" "
        data, is_a = np.frombuffer(joined, np.uint8), np.frombuffer(bytearray(joined).translate(_CLASS), np.uint8)
        accented = np.flatnonzero(data == _LATIN) + 1
        is_a[accented[~np.isin(data[accented], _SIGNS)]] = _ALNUM
        kept = is_a < _BLANK
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        marks = np.flatnonzero((is_a[1:-1] >> 1 == _MARK >> 1) & (is_a[:-2] == _ALNUM) & ~kept[2:]) + 1
        first[marks] = True
        starts = np.flatnonzero(first)
        places = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[kept])).dictionary_encode()
        del first, places
        codes, known = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._learn(known)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        flat, at = np.frombuffer(b"".join(found), self.kind), np.cumsum(sizes) - sizes
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=before[1:])
        ids = np.empty(before[-1], self.kind)
        for i in range(0, len(codes), RUN):
            run, ends = codes[i : i + RUN], before[i : i + RUN + 1]
            ids[ends[0] : ends[-1]] = flat[np.repeat(at[run] - ends[:-1], np.diff(ends)) + np.arange(ends[0], ends[-1])]
        text_ends = np.cumsum([len(x) + 1 for x in texts])
        bounds = before[np.searchsorted(starts, text_ends)]
        if not bounded:
            return ids, bounds, bounds
        stops = is_a == _LINE
        stops[1:] |= (is_a[:-1] == _STOP) & ~kept[1:]
        ends = np.sort(np.concatenate([before[np.searchsorted(starts, np.flatnonzero(stops))], bounds]), kind="stable")
        return ids, bounds, ends[np.diff(ends, prepend=-1) > 0]

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian integers of the store's width."""
        for chunk in self._chunks(texts):
            ids, bounds, _ = self._chunk(chunk, False)
            flat, start = ids.tobytes(), 0
            for end in (bounds * self.kind.itemsize).tolist():
                yield flat[start:end]
                start = end

    def bounded(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids, and the places in them that end a sentence or a line, ascending."""
        for chunk in self._chunks(texts):
            ids, bounds, ends = self._chunk(chunk, True)
            start, a = 0, int(np.searchsorted(ends, 0, "right"))
            for end, z in zip(bounds.tolist(), np.searchsorted(ends, bounds, "right").tolist(), strict=True):
                yield ids[start:end], ends[a:z] - start
                start, a = end, z


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One store for each tokenizer file in each worker process."""
    return WordIds(path)
