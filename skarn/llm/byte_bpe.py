"""Whole texts to the ids of a byte-level BPE vocabulary and back, with the results of ``tiktoken``.

A text is cut by the vocabulary's pattern; each match is encoded for itself, without special tokens.

Encoding does not replay merges. A list of tokens is what the merges give if and only if every two
neighbours are what the merges give for those two, so a match is encoded by a search over tokens
from left to right:

1. All vocabulary entries inside the match are found by one pass of an Aho-Corasick automaton. It
   knows strings only, so each byte stands as the Latin-1 character of that number. What is kept is
   the longest entry that begins at each byte.
2. The longest entry is tried first. If it cannot stand next to the token before it, its longest
   proper prefix in the vocabulary is tried, and so on. With no prefix left the place is marked
   dead, and the token before it gives way to its own next prefix.
3. Whether two tokens can be neighbours is remembered. It follows from the merges that made them:
   undone one by one, the youngest first, they show which two tokens met at the border at any time,
   and whether merging those would have come first.

Every place dies once at most and tokens have a bounded length, so the time is linear in the text,
also in one match of a megabyte. Matches are words for the most part; a worker remembers their ids.

A null text is empty and has no ids. Repeated rows, null keys and other columns pass through.
"""

from __future__ import annotations

import base64
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from skarn.llm.common import slices, table, written

#: Matches, and pairs of tokens, that a worker remembers before it starts afresh; bounds memory, not the result.
REMEMBERED_MATCHES, REMEMBERED_PAIRS = 300_000, 300_000
#: Longest match that is remembered, in characters.
LONGEST_REMEMBERED = 48
#: Fixed value: the library's tables and the pattern module's agree on all code points below this one.
FIRST_DOUBTFUL = 0x558


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries of a ``.tiktoken`` file: bytes -> rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _merged(entry: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges of a rank below ``rank`` leave of an entry."""
    parts = [entry[i : i + 1] for i in range(len(entry))]
    while len(parts) > 1:
        found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, i = min(found)
        if best >= rank:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class BytePairs:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = {i: entry for entry, i in ranks.items()}
        self.size = {i: len(entry) for entry, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        #: Places of tokens that a merge made: rank, left part, right part. A byte has rank -1.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        self.prefix: dict[int, int] = {}
        for entry, i in ranks.items():
            if len(entry) > 1:
                parts = _merged(entry, i, ranks)
                if len(parts) != 2:
                    continue  # merges never give this entry; only a match that equals it has its id
                self.made[i] = (i, ranks[parts[0]], ranks[parts[1]])
            else:
                self.made[i] = (-1, -1, -1)
            self.automaton.add_word(entry.decode("latin-1"), (i, len(entry) - 1))
        self.automaton.make_automaton()
        for i in self.made:
            entry = self.bytes_of[i]
            shorter = (ranks.get(entry[:k]) for k in range(len(entry) - 1, 0, -1))
            self.prefix[i] = next((s for s in shorter if s in self.made), -1)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.cuts: dict[str, object] = {}

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes together give these two tokens; remembered in ``pairs``."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self._border_holds(left, right)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        made, of, ranks = self.made, self.bytes_of, self.ranks
        last = 1 << 62
        left_ends = right_ends = last
        while True:
            joint = ranks.get(of[left] + of[right], last)
            # Of equal ranks the leftmost merge comes first: the left token's own, then the border's.
            if joint < left_ends and (joint < right_ends or joint == right_ends < last):
                return False
            (a, _, tail), (b, head, _) = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, left_ends = tail, a
            else:
                right, right_ends = head, b

    def _search(self, data: bytes) -> list[int]:
        length = len(data)
        longest, size = [0] * length, self.size
        for end, (token, back) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = token  # ends ascend: the last one is the longest
        dead = bytearray(length + 1)
        known, shorter = self.pairs.get, self.prefix
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + size[token]
            if not dead[end]:
                good = last < 0 or known(last << 32 | token)
                if good is None:
                    good = self.neighbours(last, token)
                if good:
                    out.append(token)
                    if end == length:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                out.pop()
                at -= size[last]
                token, last = shorter[last], out[-1] if out else -1

    def match_ids(self, match: str) -> list[int]:
        """Ids of one match of the pattern."""
        data = match.encode()
        whole = self.ranks.get(data)
        return self._search(data) if whole is None else [whole]

    def _matches(self, text: str) -> list[str]:
        """Matches of the pattern as the library finds them.

        The two sides may know different versions of Unicode. A letter or digit that is newer than
        Python's own tables is looked up in the library, by a vocabulary of that one character.
        """
        if text.isascii() or ord(max(text)) < FIRST_DOUBTFUL:
            return self.cut(text)
        import regex

        doubtful = [c for c in set(text) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
        unknown = "".join(sorted(c for c in doubtful if not _taken(self.pattern, c)))
        if not unknown:
            return self.cut(text)
        if unknown not in self.cuts:
            other = regex.escape(unknown, special_only=False)
            pattern = self.pattern
            for kind in (r"\p{L}", r"\p{N}"):
                pattern = pattern.replace(f" ?{kind}+", f" ?(?:(?![{other}]){kind})+")
            pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{other}])")
            self.cuts[unknown] = regex.compile(pattern).findall
        return self.cuts[unknown](text)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as 32-bit integers."""
        if not text:
            return np.zeros(0, "<i4")
        matches = self._matches(text)
        found = list(map(self.known.get, matches))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    match = matches[k]
                    ids = self.known.get(match)
                    if ids is None:
                        ids = array("i", self.match_ids(match)).tobytes()
                        if len(match) <= LONGEST_REMEMBERED:
                            if len(self.known) >= REMEMBERED_MATCHES:
                                self.known.clear()
                            self.known[match] = ids
                    found[k] = ids
        return np.frombuffer(b"".join(found), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; an id that the vocabulary lacks is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _taken(pattern: str, char: str) -> bool:
    """Whether the library takes a character for a letter or a digit."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {(p + char).encode(): 256 + k for k, p in enumerate("a1")}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return any(len(probe.encode_ordinary(p + char)) == 1 for p in "a1")


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The worker's encoder, made once (see ``vocab.encoder``)."""
    kept = sys.modules.setdefault("skarn_llm_worker", types.ModuleType("skarn_llm_worker")).__dict__
    key = f"byte pairs {path} {pattern}"
    if key not in kept:
        kept[key] = BytePairs(read_ranks(path), pattern)
    return kept[key]




def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` but ``text``, which gives way to ``out``, its ids; another column ``out`` is replaced."""
    rest = [c for c in docs.columns if c not in (text, out)]
    names = [f"c{k}" for k in range(len(rest))]
    rows = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(rest, names)], docs[f"`{text}`"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path, pattern)
        for b in slices(batches, 256):
            ids = [coder.encode(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], lists], [*names, "ids"])

    schema = StructType([*[StructField(n, rows.schema[n].dataType) for n in names], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema).toDF(*rest, out)


def decode_ids(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` and ``out``, the bytes behind the ids (null ids: null); a column ``out`` is replaced."""
    rest = [c for c in tokens.columns if c != out]
    names = [f"c{k}" for k in range(len(rest))]
    rows = tokens.select(*[tokens[f"`{c}`"].alias(n) for c, n in zip(rest, names)])
    at = names[rest.index(ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path, pattern)
        for b in slices(batches, 256):
            lists = b.column(at)
            flat, ends, known = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            texts = [coder.decode(flat[i:j]) if ok else None for i, j, ok in zip(ends, ends[1:], known)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*names, "out"])

    schema = StructType([*[StructField(n, rows.schema[n].dataType) for n in names], StructField("out", BinaryType())])
    return rows.mapInArrow(run, schema).toDF(*rest, out)


def op13_byte_bpe(spark, folder: str) -> DataFrame:
    """Contract of the query: ids of every text are written, then read and decoded."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = written(encode_texts(table(spark, folder, "documents").select("doc_id", "text"), path, pattern), "byte-tokens")
    rows = decode_ids(tokens, path, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
