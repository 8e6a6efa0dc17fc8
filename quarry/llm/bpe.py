"""BPE encoding and decoding: speculate and verify.

A word's tokens are proposed by greedy longest match. A row of tokens is what BPE gives if and only
if each adjacent pair is: undoing the later of the two tokens' last merges again and again, no merge
across their border may come before the merges that built the tokens. Proposals, the test of all
distinct adjacent pairs, and the exact merging of the words with a failing pair all run with numpy
over the new words of a chunk of text at once.

No match of the word pattern crosses white space, so a task keeps a bounded table of the encodings
of white-space delimited strings and only encodes what the table lacks.

Scale: no shuffle; a task works in chunks of a few MB of text, whole texts at a time.

Words of any length are proposed and tested that way; of those that fail, the long ones are merged with a heap in
n log n. Where this machine's Unicode tables are newer than those of the tokenizers library, a task asks the library once
which of their letters and numbers it doesn't know.

Defined results: null text is empty and has no ids; ids of rows may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of

#: Strings kept in a task's table, and code points of text in a chunk.
MAX_TABLE, CHUNK = 400_000, 2_000_000
#: Bytes of the words that are proposed and merged many at once; longer ones are walked through and merged alone.
SHORT = 64
_OUT = "id long, n_tokens long, ids binary, decoded string"
#: White space to str.split() but not to the pattern.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_NONE = np.iinfo(np.int64).max


def _newer(path: str, kinds: str) -> str:
    """Letters and numbers to this machine's pattern library but not to the tokenizers file's, whose
    Unicode tables may be older."""
    import regex
    from tokenizers import Tokenizer

    unassigned = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return "".join(c for c in regex.findall(f"[{kinds}]", unassigned) if len(split(f"!{c}")) == 1)


class WordBpe:
    """The word-end BPE of a tokenizers file: NFC, lower case, words by pattern, byte alphabet."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: White space inside or outside: any match is a word; `newer` code points count as neither letter nor number.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.newer = frozenset(_newer(path, r"\p{L}\p{N}"))
        new = "".join(sorted(self.newer)) or "\U0010ffff"
        self.old_words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{new}]]+|[\p{{N}}--[{new}]]|(?:[^\s\p{{L}}\p{{N}}]|[{new}])+", regex.V1)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in visible}
        chars |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in chars)}
        #: Ids of a byte, within a word and at its end.
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        self.strings = [""] * self.size
        for token, i in vocab.items():
            self.strings[i] = token
        #: For each token: the rank of its merge (-1: a byte) and what it was merged from.
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merges.setdefault((vocab[a], vocab[b]), (at, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = at, vocab[a], vocab[b]
        #: The same as a sorted table; one id more than there are stands for the space between words.
        self.radix = self.size + 1
        keys = np.array([a * self.radix + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], _NONE)
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], _NONE)
        self.pair_made = np.append(np.array([m for _, m in self.merges.values()], np.int64)[order], -1)
        self._build_trie()
        self.table: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.decoded: list[str] = []

    def _bytes_of(self) -> list[list[int]]:
        """Each token as ids of bytes."""
        out: list[list[int]] = [[i] for i in range(self.size)]
        for i in np.argsort(self.rank, kind="stable"):
            if self.rank[i] >= 0:
                out[i] = out[self.left[i]] + out[self.right[i]]
        return out

    def _build_trie(self) -> None:
        """A trie of the tokens that BPE makes of their own bytes; others must not be proposed."""
        sound = self.compatible(self.left, self.right, np.where(self.rank >= 0, 2 * self.rank, 0))
        spelled = self._bytes_of()
        ends: dict[tuple[int, int], int] = {}
        token_at = [-1]
        whole = {*self.inner.tolist(), *self.final.tolist()}
        for i in np.argsort(self.rank, kind="stable").tolist():
            if self.rank[i] >= 0 and sound[i] and self.left[i] in whole and self.right[i] in whole:
                whole.add(i)
        for i in whole:
            node = 0
            for u in spelled[i]:
                if (node, u) not in ends:
                    ends[node, u] = len(token_at)
                    token_at.append(-1)
                node = ends[node, u]
            token_at[node] = i
        keys = np.array([n * self.radix + u for n, u in ends], np.int64)
        order = np.argsort(keys)
        self.trie_keys = np.append(keys[order], _NONE)
        self.trie_next = np.append(np.array(list(ends.values()), np.int64)[order], 0)
        self.trie_token = np.array(token_at, np.int64)
        self.trie, self.trie_list = ends, token_at

    def _merge(self, ids: list[int]) -> list[int]:
        """BPE with a heap: the lowest rank first, leftmost first."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(x: int) -> None:
            if x >= 0 and after[x] < n and (got := self.merges.get((ids[x], ids[after[x]]))):
                heapq.heappush(heap, (got[0], x, got[1], ids[x], ids[after[x]]))

        for x in range(n):
            offer(x)
        while heap:
            _, x, made, a, b = heapq.heappop(heap)
            y = after[x]
            if ids[x] != a or y >= n or ids[y] != b:
                continue
            ids[x], ids[y], after[x] = made, -1, after[y]
            if after[x] < n:
                before[after[x]] = x
            offer(before[x])
            offer(x)
        return [t for t in ids if t >= 0]

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs in the merge table; its last row for pairs that don't merge."""
        keys = a * self.radix + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def _greedy(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Longest match from the left: the token at each place where one begins, -1 elsewhere."""
        made = np.full(len(units), -1, np.int64)
        begin, end = starts.copy(), ends
        at, node = begin.copy(), np.zeros(len(begin), np.int64)
        best, best_end = np.full(len(begin), -1, np.int64), begin.copy()
        while len(begin):
            inside = at < end
            keys = np.where(inside, node * self.radix + units[np.minimum(at, len(units) - 1)], _NONE - 1)
            place = np.searchsorted(self.trie_keys, keys)
            found = self.trie_keys[place] == keys
            node = np.where(found, self.trie_next[place], 0)
            token = np.where(found, self.trie_token[node], -1)
            at = at + found
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            stuck = ~found
            made[begin[stuck]] = best[stuck]
            begin, at = np.where(stuck, best_end, begin), np.where(stuck, best_end, at)
            go = begin < end
            begin, end, at, node, best, best_end = (x[go] for x in (begin, end, at, node, best, best_end))
        return made

    def _greedy_alone(self, units: np.ndarray, made: np.ndarray, begin: int, end: int) -> None:
        """The same for one long word."""
        step, token_at, own = self.trie.get, self.trie_list, units[begin:end].tolist()
        i, n = 0, len(own)
        while i < n:
            node, j, best, best_end = 0, i, -1, i
            while j < n and (node := step((node, own[j]))) is not None:
                j += 1
                if token_at[node] >= 0:
                    best, best_end = token_at[node], j
            made[begin + i] = best
            i = best_end

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does BPE of their joined text give this pair (or did it, up to `limit`)?

        Undo the later of the two sides' last merges, step by step. Before each step the two tokens
        at the border could have been merged; had that merge come before the one just undone (a
        left side's merge goes first at equal rank), BPE would have crossed the border."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NONE) if limit is None else limit
        while len(live):
            cross = self.pair_ranks[self._lookup(a, b)]
            crossed = cross < limit // 2 + limit % 2
            ok[live[crossed]] = False
            go = ~crossed & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            left = self.rank[a] > self.rank[b]
            # A merge over the border goes before one of equal rank on its right, not on its left.
            limit = np.where(left, 2 * self.rank[a], 2 * self.rank[b] + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def _exact(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """BPE of many words at once, one merge of each a step: the token at each place where one
        begins, -1 elsewhere. units: their bytes' ids, word after word."""
        n = len(units) + len(counts) + 1  # a space before the first word and after each
        space = np.zeros(n, bool)
        space[0] = True
        space[np.cumsum(counts + 1)] = True
        ids = np.full(n, self.size, np.int64)
        ids[~space] = units
        after, before = np.minimum(np.arange(1, n + 1), n - 1), np.arange(-1, n - 1)
        before[0] = 0

        def order(x: np.ndarray) -> np.ndarray:
            """Rank, then place, of the merge that begins at x."""
            rank = self.pair_ranks[self._lookup(ids[x], ids[after[x]])]
            return np.where(rank == _NONE, _NONE, (np.minimum(rank, 1 << 30) << 32) | x)

        first = order(np.arange(n))
        first[space] = _NONE
        words = np.cumsum(counts + 1) - counts  # where each begins
        live = np.arange(len(counts))
        while len(live):
            lowest = np.minimum.reduceat(first, words)[live] if len(live) > len(counts) // 8 else np.array([first[words[w] : words[w] + counts[w]].min() for w in live])
            live, lowest = live[lowest < _NONE], lowest[lowest < _NONE]
            x = lowest & 0xFFFFFFFF
            y = after[x]
            ids[x] = self.pair_made[self._lookup(ids[x], ids[y])]
            ids[y], first[y] = -1, _NONE
            after[x] = after[y]
            before[after[x]] = x
            first[x] = order(x)
            z = before[x]
            z = z[~space[z]]
            first[z] = order(z)
        return ids[~space]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, word after word, and how many each has."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(counts)
        starts = ends - counts
        raw = np.frombuffer(b"".join(words), np.uint8)
        units = self.inner[raw]
        units[ends - 1] = self.final[raw[ends - 1]]
        short = counts <= SHORT
        made = self._greedy(units, starts[short], ends[short])
        for w in np.flatnonzero(~short).tolist():
            self._greedy_alone(units, made, int(starts[w]), int(ends[w]))
        at = np.flatnonzero(made >= 0)
        word = np.repeat(np.arange(len(words)), counts)[at]
        same = word[1:] == word[:-1]
        keys, inverse = np.unique(made[at[:-1][same]] * self.radix + made[at[1:][same]], return_inverse=True)
        ok = self.compatible(keys // self.radix, keys % self.radix)[inverse]
        failed = np.zeros(len(words), bool)
        failed[word[1:][same][~ok]] = True
        for w in np.flatnonzero(failed & ~short).tolist():
            ids = self._merge(units[starts[w] : ends[w]].tolist())
            made[starts[w] : ends[w]] = -1
            made[starts[w] : starts[w] + len(ids)] = ids
        failed &= short
        if failed.any():
            of_failed = np.repeat(failed, counts)
            made[of_failed] = self._exact(units[of_failed], counts[failed])
        return made[made >= 0], np.add.reduceat(made >= 0, starts, dtype=np.int64)

    def _learn(self, strings: list[str]) -> None:
        """Encode what the table lacks."""
        plain = [s for s in strings if s[0] != "\n"]
        odd = [s for s in plain if "\x1f" in s or not (s.isascii() or self.newer.isdisjoint(s))]
        usual = list(set(plain).difference(odd))
        flat = self.words.findall(" \x1f ".join(usual))
        cuts = [-1, *[i for i, w in enumerate(flat) if w == "\x1f"], len(flat)]
        n_words = [b - a - 1 for a, b in zip(cuts, cuts[1:], strict=False)] if usual else []
        words = [w.encode() for w in flat if w != "\x1f"]
        for s in odd:
            found = self.old_words.findall(s)
            n_words.append(len(found))
            words += [w.encode() for w in found]
        if words:
            ids, counts = self._encode_words(words)
            ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(n_words))].tolist()
            raw, text = ids.astype("<u4").tobytes(), list(map(self.strings.__getitem__, ids.tolist()))
            self.table.update(zip(usual + odd, range(len(self.ids), len(self.ids) + len(plain)), strict=True))
            self.ids += [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
            self.decoded += [" ".join(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for s in set(strings).difference(plain):
            self.table[s] = len(self.ids)
            self.ids.append(np.array([self.special[s[1:]]], "<u4").tobytes())
            self.decoded.append(s[1:])

    def _strings(self, text: str) -> list[str]:
        """White-space delimited, normalised strings of a text, and its special strings after a \\n."""
        if self.special_split and any(s in text for s in self.special):
            return [s for part in self.special_split.split(text) for s in ([f"\n{part}"] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in _NOT_SPACE):
            return self.old_words.findall(text)
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids (little-endian, 4 bytes) and their decoding."""
        split = [self._strings(t) for t in texts]
        used = set().union(*split)
        new = used - self.table.keys()
        if len(self.table) + len(new) > MAX_TABLE:
            self.table, self.ids, self.decoded = {}, [], []
            new = used
        if new:
            self._learn(list(new))
        table, ids, decoded = self.table.__getitem__, self.ids.__getitem__, self.decoded.__getitem__
        for strings in split:
            at = list(map(table, strings))
            yield b"".join(map(ids, at)), " ".join(map(decoded, at))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            ends, low = np.cumsum(batch.column(2).to_numpy()), 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, CHUNK + (ends[low - 1] if low else 0), "right")))
                got = list(bpe.encode(batch.column(1)[low:high].to_pylist()))
                ids = [x[0] for x in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x[1] for x in got], pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"],
                )
                low = high

    return run


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit) and their decoding."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.length(text).cast("long").alias("size"))
    return rows.mapInArrow(_encoded(tokenizer_path), _OUT)
