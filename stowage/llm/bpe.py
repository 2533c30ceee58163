"""BPE encoding and decoding: speculate and verify.

Each distinct word of a batch is first cut greedily into the longest vocabulary tokens. A cut is the
exact BPE result iff every adjacent pair of its tokens is *compatible* (no merge across the boundary
would have come before the merges that built the two tokens) and every token is *reachable* (its own
merge is what BPE makes of it). Both tests are table walks over numpy arrays, for all pairs of the
batch at once. Only words with a failing test are merged exactly, with a heap.

Texts are lower-cased and split into words by Python's Unicode tables. A text with a code point that those
do not know is split by the tokenizers library itself, whose tables may be newer.

Defined results: a null text counts as empty (no ids, empty decoded text); repeated rows each get their
row; columns other than ``id_col`` and ``text_col`` are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.memory import release, small_batches

TOKENIZER = "word_bpe_49k.json"
#: Words kept in a worker's cache before it starts anew.
CACHE_WORDS = 80_000
#: Failing words up to so many bytes are merged together, a step at a time; longer ones by a heap each.
SHORT = 48
#: Words of more bytes are cut one by one, as a step over all words would be taken for each of their bytes.
LONG = 512
_NEVER = np.int64(1) << 40
# Unicode White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary lies on this machine; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _unknown() -> re.Pattern:
    """Any code point that Python's Unicode tables do not assign."""
    spans, last = [], -2
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if c != last + 1:
                spans.append([c, c])
            spans[-1][1] = last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def _latin_letters() -> str:
    return "".join(chr(c) for c in range(0x80, 0x250) if unicodedata.category(chr(c))[0] == "L")


def _latin_numbers() -> str:
    return "".join(chr(c) for c in range(0x80, 0x250) if unicodedata.category(chr(c))[0] == "N")


class WordBpe:
    """A word-end BPE vocabulary (lower case, white space dropped) with its compatibility tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = _byte_alphabet()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # when a token is made; -1: a base symbol
        keys, ranks, makes = [], [], []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys.append((x << 32) | y)
            ranks.append(k)
            makes.append(z)
            if self.left[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, k
        order = np.argsort(np.array(keys, np.int64))
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_rank = np.array(ranks, np.int64)[order]
        self.pair_makes = np.array(makes, np.int64)[order]
        self._plant(vocab)
        self.reachable = self._reachable()
        self.ids: dict[str, bytes] = {}
        for t, i in self.special.items():
            self.ids["\0" + t] = i.to_bytes(4, "little")
        letters, numbers = _latin_letters(), _latin_numbers()
        tails = "'s|'t|'re|'ve|'m|'ll|'d"
        self.ascii = re.compile(rf"{tails}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.latin = re.compile(rf"{tails}|[a-z{letters}]+|[0-9{numbers}]|[^{_SPACE}a-z0-9{letters}{numbers}]+")
        import regex

        self.any = regex.compile(rf"{tails}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.lib = None
        self.rules = {**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}

    def _plant(self, vocab: dict[str, int]) -> None:
        """The vocabulary as a trie over bytes; a word's last byte counts as itself plus 256."""
        byte = {c: b for b, c in enumerate(self.bytes)}
        edges: dict[int, int] = {}
        ends = {0: -1}
        for token, i in vocab.items():
            last = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            path = [byte[c] for c in (token[: -len(self.suffix)] if last else token)]
            path[-1] += 256 * last
            node = 0
            for x in path:
                node = edges.setdefault((node << 9) | x, len(edges) + 1)
            ends[node] = i
        self.edge_key = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_key.tolist()], np.int64)
        self.node_token = np.full(len(edges) + 1, -1, np.int64)
        self.node_token[list(ends)] = list(ends.values())
        self.base = np.array([vocab[c] for c in self.bytes] + [vocab[c + self.suffix] for c in self.bytes], np.int64)
        # the same tables for steps in plain Python, as numbers without objects
        self.edges, self.pairs = array("q", self.edge_key.tobytes()), array("q", self.pair_key.tobytes())

    # -- compatibility ---------------------------------------------------------------------------

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER)

    def compatible(self, first: np.ndarray, second: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether BPE of the joined strings keeps the boundary (before ``until``).

        Walks back in time: at each step the pair of neighbours at the boundary is looked up; a merge of
        them that comes before either would be used up breaks the boundary (of equal merges the left goes
        first). Then the later made of the two is undone, to its part at the boundary.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        end_a = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        end_b = end_a.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self._merge_rank(x, y)
            bad = (m < end_a[live]) & (m <= end_b[live]) & (m < _NEVER)
            if until is not None:  # the last merge itself joins the two halves
                bad &= m < until[live]
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_a = rx > ry
            la, lb = live[undo_a], live[~undo_a]
            end_a[la], a[la] = rx[undo_a], self.right[x[undo_a]]
            end_b[lb], b[lb] = ry[~undo_a], self.left[y[~undo_a]]
        return good

    def _reachable(self) -> np.ndarray:
        made = np.flatnonzero(self.rank >= 0)
        good = np.ones(len(self.rank), bool)
        good[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for z in made[np.argsort(self.rank[made])]:
            good[z] &= good[self.left[z]] and good[self.right[z]]
        return good

    # -- words -----------------------------------------------------------------------------------

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' bytes, the last of each plus 256, and where each word ends."""
        raw = [w.encode("utf-8", "replace") for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        return symbols, ends

    def speculate(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match first, from the left, in all words at once: tokens in order, and the word of each."""
        n = len(ends)
        word, at = np.arange(n), np.concatenate([[0], ends[:-1]])
        end, here = ends.copy(), at.copy()
        node, best, best_end = np.zeros(n, np.int64), np.full(n, -1), at.copy()
        tokens, owners = [], []
        while len(word):
            key = (node << 9) | symbols[np.minimum(here, end - 1)]
            e = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            on = (here < end) & (self.edge_key[e] == key)
            node, here = np.where(on, self.edge_to[e], 0), here + on
            token = np.where(on, self.node_token[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, here, best_end)
            off = np.flatnonzero(~on)
            tokens.append(best[off])
            owners.append(word[off])
            here[off], best[off] = best_end[off], -1
            if (best_end[off] == end[off]).any():
                keep = on | (best_end < end)
                word, end, node, here, best, best_end = (x[keep] for x in (word, end, node, here, best, best_end))
        flat, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def _cut_one(self, symbols: np.ndarray) -> list[int]:
        """As ``speculate``, for one long word."""
        edges, to_node, ends, word = self.edges, self.edge_to, self.node_token, symbols.tolist()
        out, at, n = [], 0, len(word)
        while at < n:
            node, here, best, to = 0, at, -1, at
            while here < n:
                key = (node << 9) | word[here]
                e = bisect_left(edges, key)
                if e == len(edges) or edges[e] != key:
                    break
                node, here = int(to_node[e]), here + 1
                if ends[node] >= 0:
                    best, to = int(ends[node]), here
            out.append(best)
            at = to
        return out

    def exact(self, symbols: list[int]) -> list[int]:
        """Merges one word in order of rank, leftmost first, by a heap over linked neighbours."""
        ids = self.base[symbols].tolist()
        n = len(ids)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                key = (ids[i] << 32) | ids[j]
                e = bisect_left(self.pairs, key)
                if e < len(self.pairs) and self.pairs[e] == key:
                    heapq.heappush(heap, (int(self.pair_rank[e]), i, j, ids[i], ids[j], int(self.pair_makes[e])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, x, y, z = heapq.heappop(heap)
            if dead[i] or dead[j] or after[i] != j or ids[i] != x or ids[j] != y:
                continue
            ids[i], dead[j], after[i] = z, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [ids[i] for i in range(n) if not dead[i]]

    def _exact_many(self, grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``exact``, one merge a step in every row; rows of symbols, padded. Ids by row, and their number."""
        ids = np.where(np.arange(grid.shape[1]) < lengths[:, None], self.base[grid], -1)
        out, count = ids.copy(), lengths.copy()
        ranks = np.full(ids.shape, _NEVER)
        ranks[:, :-1] = self._merge_rank(ids[:, :-1], ids[:, 1:])
        row, col = np.arange(len(ids)), np.arange(ids.shape[1])
        while len(row):
            j = ranks.argmin(1)
            k = np.arange(len(row))
            over = ranks[k, j] >= _NEVER
            out[row[over]], count[row[over]] = ids[over], lengths[over]
            ids, ranks, lengths, row, j = ids[~over], ranks[~over], lengths[~over] - 1, row[~over], j[~over]
            if not len(row):
                break
            k = np.arange(len(row))
            at = np.searchsorted(self.pair_key, (ids[k, j] << 32) | ids[k, j + 1])
            made = self.pair_makes[at]
            later = col > j[:, None]
            ids = np.where(later, np.roll(ids, -1, 1), ids)
            ranks = np.where(later, np.roll(ranks, -1, 1), ranks)
            ids[:, -1], ranks[:, -1] = -1, _NEVER
            ids[k, j] = made
            ranks[k, j] = self._merge_rank(made, np.take_along_axis(ids, np.minimum(j + 1, len(col) - 1)[:, None], 1)[:, 0])
            ranks[k[j == len(col) - 1], -1] = _NEVER
            left = k[j > 0]
            ranks[left, j[left] - 1] = self._merge_rank(ids[left, j[left] - 1], made[left])
        return out, count

    def _cut(self, symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and the word of each."""
        long = np.flatnonzero(lengths > LONG)
        if not len(long):
            return self.speculate(symbols, ends)
        short = np.flatnonzero(lengths <= LONG)
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(short):
            flat, owner = self.speculate(symbols[np.repeat(lengths <= LONG, lengths)], np.cumsum(lengths[short]))
            parts.append((flat, short[owner]))
        for w in long.tolist():
            tokens = np.array(self._cut_one(symbols[ends[w] - lengths[w] : ends[w]]), np.int64)
            parts.append((tokens, np.full(len(tokens), w)))
        flat, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def learn(self, words: set[str]) -> int:
        """Encodes words that the cache lacks; returns how many needed exact merging."""
        new = [w for w in words if w not in self.ids]
        if not new:
            return 0
        symbols, ends = self._symbols(new)
        lengths = np.diff(ends, prepend=0)
        flat, owner = self._cut(symbols, ends, lengths)
        failed = np.zeros(len(new), bool)
        failed[owner[~self.reachable[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        failed[owner[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        good = ~failed[owner]
        bad = np.flatnonzero(failed)
        bad = bad[np.argsort(lengths[bad], kind="stable")]
        short = bad[lengths[bad] <= SHORT]
        tokens, of = [flat[good]], [owner[good]]
        for at in range(0, len(short), 8192):
            rows = short[at : at + 8192]
            n = lengths[rows]
            spots = np.minimum((ends[rows] - n)[:, None] + np.arange(n.max() + 1), len(symbols) - 1)
            ids, count = self._exact_many(symbols[spots], n)
            kept = np.arange(ids.shape[1]) < count[:, None]
            tokens.append(ids[kept])
            of.append(np.repeat(rows, count))
        for w in bad[len(short) :]:
            ids = self.exact(symbols[ends[w] - lengths[w] : ends[w]])
            tokens.append(np.array(ids))
            of.append(np.full(len(ids), w))
        of_all = np.concatenate(of)
        order = np.argsort(of_all, kind="stable")
        ids = np.concatenate(tokens)[order].astype("<u4")
        stops = np.cumsum(np.bincount(of_all, minlength=len(new))).tolist()
        packed, at = ids.tobytes(), 0
        for w, to in zip(new, stops, strict=True):
            self.ids[w] = packed[4 * at : 4 * to]
            at = to
        return len(bad)

    # -- texts -----------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens stand out by a leading NUL."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += ["\0" + part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if max(text) >= "ɐ" and _unknown().search(text):
            return self._by_library(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.latin if max(text) < "ɐ" else self.any).findall(text)

    def _by_library(self, text: str) -> list[str]:
        if self.lib is None:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_str(json.dumps(self.rules))  # its rules alone
        text = self.lib.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        cut = [self.words(t or "") for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.ids = {k: v for k, v in self.ids.items() if k[:1] == "\0" and k[1:] in self.special}
        self.learn({w for c in cut for w in c})
        ids = self.ids.__getitem__
        for c in cut:
            yield b"".join(map(ids, c))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def model(path: str) -> WordBpe:
    return WordBpe(path)


def _slices(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in small parts, each with its texts: only a part is held as Python objects."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).to_pylist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col, n_tokens, ids`` of every text; ids as array<int>."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>"
    names = [id_col, "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path(tokenizer))
        for batch in batches:
            for part, texts in _slices(batch, 1):
                ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in bpe.encode(texts)]
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.list_(pa.int32()))], names)
        release()

    small_batches(docs)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again; then the columns in ``keep``."""
    kind = lambda c: f"`{c}` {docs.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(id_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", *map(kind, keep)])
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path(tokenizer))
        for batch in batches:
            for part, texts in _slices(batch, 1):
                rows = [(len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(bpe.decode(np.frombuffer(b, "<u4").tolist()).encode("utf-8", "replace")).hexdigest()) for b in bpe.encode(texts)]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, *part.columns[2:]], names)
        release()

    small_batches(docs)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col, text``: what each row's ids decode to, special tokens kept; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path(tokenizer))
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    schema = f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string"
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)
