"""Encoding of whole texts with a byte-level BPE vocabulary, by a walk over a trie of words.

For merges by rank, the last token of a prefix's encoding decides the rest:
token t ends the encoding of s exactly if t is a suffix of s and the encoding
of s without t ends in a token u such that u and t stay apart when their
bytes are encoded together. So one state a trie node, its last token, holds
the encoding of the whole prefix, and words that share a prefix share the
states along it.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat
from pathlib import Path

from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: Fixed: the pattern that parts a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a worker remembers, words handled at once, characters of a text whose words are listed as a whole, and joined tokens whose encoding a worker remembers.
REMEMBERED, AT_ONCE, LONG, PAIRS = 200_000, 200_000, 1_000_000, 400_000


class TrieEncoder:
    """Encodes words with the ranks of a vocabulary file (one base64 token and its rank a line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words, self.all_words = regex.compile(pattern).finditer, regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def merge(self, text: bytes) -> list[int]:
        """Encoding by plain merges, lowest rank first; for short byte strings."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their bytes stand together; left is -1 at the beginning of a word."""
        key = (left, right)
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merge((self.tokens[left] if left >= 0 else b"") + self.tokens[right]) == [x for x in key if x >= 0]
        return known

    def walk(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words. In byte order the words are a depth-first walk of their trie; ``last`` is the path to the node reached."""
        found: dict[str, tuple[int, ...]] = {}
        ranks, longest, apart = self.ranks, self.longest, self.apart
        path, last = b"", [-1]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(raw), len(path))
            while shared < most and raw[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for begin in range(max(0, end - longest), end):
                    token = ranks.get(raw[begin:end])
                    if token is not None and apart(last[begin], token):
                        last.append(token)
                        break
            path, at, ids = raw, len(raw), []
            while at:
                ids.append(last[at])
                at -= len(self.tokens[last[at]])
            found[word] = tuple(reversed(ids))
        return found

    def _forget(self) -> None:
        import numpy as np

        #: Number of each word met; where its ids begin among all ids, and how many it has.
        self._memo: dict[str, int] = {}
        self._ids, self._begin, self._count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, words: list[str]):
        """The number of each word; those not met are put into one trie and walked together."""
        import numpy as np

        if len(self._memo) > REMEMBERED:
            self._forget()
        numbers = np.fromiter(map(self._memo.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            found = self.walk({words[k] for k in unknown.tolist()})
            self._memo.update(zip(found, range(len(self._memo), len(self._memo) + len(found))))
            count = np.fromiter(map(len, found.values()), np.int64, len(found))
            self._begin = np.concatenate((self._begin, len(self._ids) + np.cumsum(count) - count))
            self._count = np.concatenate((self._count, count))
            self._ids = np.concatenate((self._ids, np.fromiter(chain.from_iterable(found.values()), np.int32, int(count.sum()))))
            numbers[unknown] = np.fromiter((self._memo[words[k]] for k in unknown.tolist()), np.int64, len(unknown))
        return numbers

    def _parts(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """The words of the texts, some AT_ONCE at a time: words, and the place of a text with its number of them; a long text comes in several parts."""
        words, owner, held = [], [], []
        for k, text in enumerate(texts):
            it = iter([self.all_words(text)] if len(text or "") <= LONG else ()) if text else iter(())
            if text and len(text) > LONG:
                found = (m.group() for m in self.words(text))
                it = iter(lambda: list(islice(found, AT_ONCE)), [])
            for part in it:
                words += part
                owner.append(k)
                held.append(len(part))
                if len(words) >= AT_ONCE:
                    yield words, owner, held
                    words, owner, held = [], [], []
        if words:
            yield words, owner, held

    def count_many(self, texts: list[str | None]):
        """The number of ids of each text."""
        import numpy as np

        out = np.zeros(len(texts), np.int64)
        for words, owner, held in self._parts(texts):
            numbers = self._numbers(words)
            sums = np.concatenate(([0], np.cumsum(self._count[numbers])))
            ends = np.cumsum(held)
            np.add.at(out, owner, sums[ends] - sums[ends - held])
        return out

    def encode_many(self, texts: list[str | None]):
        """All ids of the texts, one after the other, and the number of each text's."""
        import numpy as np

        out, parts = np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
        for words, owner, held in self._parts(texts):
            numbers = self._numbers(words)
            count = self._count[numbers]
            upto = np.cumsum(count)
            places = np.arange(int(upto[-1])) + np.repeat(self._begin[numbers] - (upto - count), count)
            parts.append(self._ids[places])
            sums, ends = np.concatenate(([0], upto)), np.cumsum(held)
            np.add.at(out, owner, sums[ends] - sums[ends - held])
        return np.concatenate(parts), out


@functools.lru_cache(maxsize=2)
def encoder(folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> TrieEncoder:
    """The encoder of a worker, read once from the folder of the vocabularies."""
    lines = (Path(folder) / f"{vocabulary}.tiktoken").read_bytes().splitlines()
    return TrieEncoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


def encode_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of each row, without special tokens.

    Empty and null texts both give an empty list; repeated rows and null ids
    are rows like any other; texts of any length are encoded whole, a bounded
    number of words at a time. Of the words of many texts those that a worker
    doesn't remember are walked as one trie; the ids of all are then gathered from
    arrays. The memory is bounded, and nothing is shuffled.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(folder, vocabulary)
        for batch in batches:
            for k in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(k, 512)
                values, counts = enc.encode_many(part.column(1).to_pylist())
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``n_tokens`` of each text; 0 for empty and null ones."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(folder, vocabulary)
        for batch in batches:
            for k in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(enc.count_many(part.column(0).to_pylist()))], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(text_col, *keep).mapInArrow(run, f"{kinds}, n_tokens bigint")
