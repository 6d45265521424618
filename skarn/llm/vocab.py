"""Whole texts to token ids with a public word-level BPE vocabulary, a batch of texts at a time.

The library spends its time on short, repeated words. Numpy therefore cuts the texts of a batch into
words by the kinds of their characters, Arrow codes the words as a dictionary, its words are merged
in a few calls, and numpy lays the ids of all words end to end; no step goes word by word in Python.
Words are cut the way the vocabulary's own pattern cuts them, for Latin text only: a text with any
other character, or with the start of a special token's string, goes through the library whole. The
merges are those of ``tiktoken``, which takes ids for ranks, as they are given in the order of the
merges; a character that no text cut here has stands for the end of a word. It merges any two tokens
that make up an entry, the library only those of its list: both give the same for entries that the
library gives for their own bytes, so others are left out. The ids are the library's in all cases
(``tests/llm/test_tokens.py``).
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Different words, and bytes of them, that one call merges; bounds memory, not the result.
REMEMBERED_WORDS, REMEMBERED_PARTS = 120_000, 300_000
#: Characters of text coded at a time.
PORTION = 3_000_000

#: A character of one byte that no text cut here has; after a word it stands for the word's end.
MARK = 1

#: Contractions that the vocabulary's pattern takes as words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters of texts that are cut here: Latin letters, digits, signs and plain white space.
_LATIN = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c <= 0xA0 and c not in (0xAD, 0x130)]
_ONE_BYTE = b" \t\n\r" + bytes(ord(c) for c in _LATIN if ord(c) < 256)
_OTHER = re.compile("[^ \t\n\r" + "".join(map(re.escape, _LATIN)) + "]")

_BLANK = re.compile("[ \t\n\r]")


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PORTION`` characters that begin at white space, so no word is cut."""
    at = 0
    while len(text) - at > PORTION and (blank := _BLANK.search(text, at + PORTION)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


#: Kinds of lower-case characters: white space, letter, digit, sign.
SPACE, LETTER, DIGIT, SIGN = range(4)


def _kinds() -> np.ndarray:
    """The kind of each UTF-16 unit of the texts cut here, lower-cased."""
    kinds = np.full(1 << 16, SPACE, np.uint8)
    for c in {x for c in _LATIN for x in c.lower()}:
        kinds[ord(c)] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], SIGN)
    return kinds


def _plain(text: str) -> bool:
    """Whether this module may cut the text itself."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _ONE_BYTE)
    except UnicodeEncodeError:
        return _OTHER.search(text) is None


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary -> the byte."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _merger(vocabulary: dict[str, int], words, end_of_word: str):
    """``tiktoken`` over words that end with ``MARK``, laid end to end, and whether each id ends a word."""
    import tiktoken

    letter, ranks, whole, mark = _byte_letters(), {}, [], bytes([MARK])
    for entry, i in vocabulary.items():
        ends = entry.endswith(end_of_word)
        body = entry.removesuffix(end_of_word)
        if not all(c in letter for c in body):
            continue
        data = bytes(letter[c] for c in body)
        if mark in data:
            continue
        if len(data) > 1 and ends:
            try:
                whole.append((data.decode(), data + mark, i))
                continue
            except UnicodeDecodeError:
                pass
        ranks[data + mark if ends else data] = i
    # Entries that end a word and that the library gives for their own letters.
    for (_, data, i), found in zip(whole, words.encode_batch_fast([w for w, _, _ in whole], add_special_tokens=False)):
        if found.ids == [i]:
            ranks[data] = i
    ranks.setdefault(mark, max(vocabulary.values()) + 1)
    ends = np.zeros(max(ranks.values()) + 1, bool)
    ends[[i for data, i in ranks.items() if data.endswith(mark)]] = True
    pattern = f"[^{chr(MARK)}]*{chr(MARK)}"
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ends


def _begins(units: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a word begins at each unit: ``CONTRACTIONS``, runs of letters, digits one by one, runs of signs."""
    begins = np.ones(len(units), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    begins &= kind != SPACE
    # An apostrophe inside a run of signs begins none; behind a contraction, which ends in a letter, it may.
    ticks = np.flatnonzero(begins & (units == ord("'")))
    if len(ticks):
        after = np.concatenate([units, np.zeros(2, units.dtype)])
        for letters in (c[1:] for c in CONTRACTIONS):
            found = ticks
            for k, x in enumerate(letters, 1):
                found = found[after[found + k] == ord(x)]
            begins[found + 1] = False
            ends = found + 1 + len(letters)
            ends = ends[ends < len(units)]
            begins[ends] = kind[ends] != SPACE
    return begins


class Encoder:
    """Ids of texts under one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, end_of_word: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # The same vocabulary over lower-case words that are cut already.
        words = Tokenizer(self.library.model)
        words.normalizer = normalizers.Sequence([])
        cut = pre_tokenizers.Split(" ", "removed")
        words.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.ends_word = _merger(self.library.get_vocab(with_added_tokens=False), words, end_of_word)
        self.kinds = _kinds()

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text by the library alone."""
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _merged(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end in UTF-8 and end at ``ends``, and where the ids of each word end."""
        call = np.arange(len(ends)) // REMEMBERED_WORDS + ends // REMEMBERED_PARTS
        bounds = [0, *ends[np.flatnonzero(np.diff(call))].tolist(), int(ends[-1])]
        found = [
            self.words.encode_to_numpy(data[a:z].tobytes().decode(), disallowed_special=())
            for a, z in zip(bounds, bounds[1:])
        ]
        ids = np.concatenate(found)
        return ids.astype(self.kind), np.flatnonzero(self.ends_word[ids]) + 1

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]
        # A unit of UTF-16 is a character here; a blank stands behind each text.
        units = np.frombuffer(" ".join([*low, ""]).encode("utf-16-le"), "<u2")
        kind = self.kinds[units]
        begins = _begins(units, kind)
        first = np.flatnonzero(begins)
        if not len(first):
            return [np.zeros(0, self.kind)] * len(texts)
        words_upto = np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in low]))
        inside = kind != SPACE
        letters = units[inside]
        marked = np.insert(letters, np.append(np.flatnonzero(begins[inside])[1:], len(letters)), MARK)
        data = np.frombuffer(marked.tobytes().decode("utf-16-le").encode(), np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(data == MARK) + 1])
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        _, offsets, data = coded.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int64)[1 : len(coded.dictionary) + 1]
        ids, ends = self._merged(np.frombuffer(data, np.uint8), offsets)
        length = np.diff(ends, prepend=0)
        of_word = length[which]
        upto = np.concatenate([[0], np.cumsum(of_word)])
        place = np.arange(upto[-1])
        place += np.repeat((ends - length)[which] - upto[:-1], of_word)
        out, bounds = ids[place], upto[words_upto]
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; of a null or empty text: none."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        waiting: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not _plain(text):
                out[i] = self.whole(text)
                continue
            if len(text) > PORTION:
                out[i] = np.concatenate([self._cut([p])[0] for p in _pieces(text)])
                continue
            waiting.append(i)
            size += len(text)
            if size >= PORTION:
                for k, ids in zip(waiting, self._cut([texts[k] for k in waiting])):
                    out[k] = ids
                waiting, size = [], 0
        if waiting:
            for k, ids in zip(waiting, self._cut([texts[k] for k in waiting])):
                out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once.

    Tasks get this function by value, with globals of their own, so what lasts from task to task is
    kept in a module of the worker's interpreter.
    """
    kept = sys.modules.setdefault("skarn_llm_worker", types.ModuleType("skarn_llm_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
