"""Byte-level BPE encoding and decoding by speculation and verification.

A segmentation of a word is its BPE encoding exactly if all neighbouring tokens are compatible, that is, if no merge
across their border would have come before the merges that made them. So tokens are guessed first and checked afterwards:

1. Texts are cut into words by the pattern of byte-level tokenizers; every distinct word of a task is encoded once.
2. Greedy longest match proposes tokens: numpy walks the vocabulary's trie from all places of all new words at once.
3. All adjacent pairs are tested together. The test undoes the merges on both sides of the border, latest first, and
   looks up whether the two tokens then in contact merge earlier than either of them disappears.
4. Only words with an incompatible pair are merged exactly, by the ranks.

The check needs merges that come after the merges of their parts, and tokens that encode as themselves; a
vocabulary without the former sends all words to step 4, tokens without the latter are not proposed.
Runs inside the tasks that read the texts, without a shuffle; a text is worked through in pieces of ``PIECE`` characters
cut in front of white space, and known words are forgotten beyond ``KNOWN_WORDS``.

Defined results: null and empty texts have no tokens and decode as the empty text; rows are kept one to one, whatever
ids they have or repeat; an empty table gives no rows; only the columns asked for by ``keep`` are read, so other columns
may have any name. Strings of added tokens in a text become these tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapeworks.llm.shared import table
from tapeworks.llm.words import batch_of, slices

MODEL = os.environ.get("BPE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")
PIECE, HELD_WORDS, KNOWN_WORDS = 1 << 16, 1 << 18, 500_000
NEVER = np.int64(1) << np.int64(40)
# fixed value: the words of byte-level tokenizers
WORDS = r""" ?\p{L}+| ?\p{N}+|'(?:[sdmt]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# fixed value: printable bytes stand for themselves, the others for the characters from U+0100 on
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(others)}


def young_letters(pre_tokenizer) -> set[str]:
    """Letters and digits of the pattern's version of Unicode that are not yet such in the library's."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    maybe = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn"]
    # to the library such a character and the dots around it are one word
    spans = [span for _, span in pre_tokenizer.pre_tokenize_str("".join(f" .{c}." for c in maybe))]
    return {maybe[start // 4] for start, stop in spans if stop - start == 4}


def word_finder(young: set[str]) -> Callable[[str], list[str]]:
    """Cuts a text into words; texts with ``young`` letters take a slower pattern."""
    plain = regex.compile(WORDS).findall
    if not young:
        return plain
    own = "".join(sorted(young))
    letters, digits = (rf"[\p{{{kind}}}--[{own}]]" for kind in "LN")
    careful = WORDS.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\p{L}", letters).replace(r"\p{N}", digits)
    careful = regex.compile(careful.replace("@", rf"(?:[^\s\p{{L}}\p{{N}}]|[{own}])"), regex.V1).findall
    return lambda text: plain(text) if text.isascii() or young.isdisjoint(text) else careful(text)


def _spans(counts: np.ndarray) -> np.ndarray:
    """Offsets of consecutive lists."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of all lists, one after the other."""
    offsets = _spans(counts)
    return np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])


class Grown:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self._room, self._n = np.zeros(1024, np.int64), 0

    def __len__(self) -> int:
        return self._n

    def add(self, values: np.ndarray) -> None:
        if self._n + len(values) > len(self._room):
            room = np.zeros(2 * (self._n + len(values)), np.int64)
            room[: self._n] = self.values
            self._room = room
        self._room[self._n : self._n + len(values)] = values
        self._n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._room[: self._n]


class ByteBPE:
    """A vocabulary with its trie, its merges and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        odd = spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or model.get("dropout")
        odd = odd or not cut.get("use_regex", True) or model.get("ignore_merges") or model.get("continuing_subword_prefix")
        added = spec.get("added_tokens") or []
        if odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        as_byte = byte_characters()
        vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        raw = [b""] * self.size
        for text, i in vocab.items():
            raw[i] = bytes(as_byte[c] for c in text)
        self.of_byte = np.full(256, -1, np.int64)
        for i in vocab.values():
            if len(raw[i]) == 1:
                self.of_byte[raw[i][0]] = i
        if (self.of_byte < 0).any():
            raise ValueError(f"{path} lacks single bytes")
        self.added = {t["content"]: t["id"] for t in added}
        for text, i in self.added.items():
            raw[i] = text.encode()
        self._read_merges(model["merges"], vocab)
        self._build_trie({i: raw[i] for i in vocab.values() if self.sound[i]})
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_spans = _spans(np.array([len(r) for r in raw]))
        from tokenizers import Tokenizer

        self.words_of = word_finder(young_letters(Tokenizer.from_file(path).pre_tokenizer))
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_in = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.forget()

    def _read_merges(self, merges: list, vocab: dict[str, int]) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of, self.made_by = keys[order], rank[order], made[order]
        self.born = np.full(self.size, -1, np.int64)
        self.left, self.right = (np.arange(self.size) for _ in "lr")
        first = np.unique(made, return_index=True)[1]
        self.born[made[first]], self.left[made[first]], self.right[made[first]] = first, left[first], right[first]
        self.in_order = bool(((self.born[left] < rank) & (self.born[right] < rank)).all() and len(first) == len(made))
        # a token encodes as itself if nothing crosses its own last merge earlier, and both parts are sound
        self.sound = np.zeros(self.size, bool)
        self.sound[self.of_byte] = True
        whole = self._unbroken(left, right, rank)
        for i in range(len(pairs)):
            self.sound[made[i]] = whole[i] and self.sound[left[i]] and self.sound[right[i]]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``NEVER`` where there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NEVER)

    def _unbroken(self, left: np.ndarray, right: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of ``left, right`` comes before rank ``until``.

        Goes back in time: the token in contact that was made last is replaced by its part at the border. A merge of
        the two in contact is too early if its rank is below the end of both; of equal ranks the left one is done.
        """
        good, open_ = np.ones(len(left), bool), np.arange(len(left))
        a, b, ends_a, ends_b = left.copy(), right.copy(), until.copy(), until.copy()
        while len(open_):
            rank = self._ranks(a, b)
            early = (rank < ends_a) & (rank <= ends_b) & (rank < until[open_])
            good[open_[early]] = False
            born_a, born_b = self.born[a], self.born[b]
            more = ~early & ((born_a >= 0) | (born_b >= 0))
            open_, a, b, ends_a, ends_b = open_[more], a[more], b[more], ends_a[more], ends_b[more]
            born_a, born_b = born_a[more], born_b[more]
            first = born_a > born_b
            ends_a, a = np.where(first, born_a, ends_a), np.where(first, self.right[a], a)
            ends_b, b = np.where(first, ends_b, born_b), np.where(first, b, self.left[b])
        return good

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens may stand side by side in an encoding."""
        if not self.in_order:
            return np.zeros(len(left), bool)
        pairs, back = np.unique(left * self.size + right, return_inverse=True)
        return self._unbroken(pairs // self.size, pairs % self.size, np.full(len(pairs), NEVER))[back]

    def _build_trie(self, tokens: dict[int, bytes]) -> None:
        nodes, ends = {(0, 0): 0}, {}
        for i, raw in tokens.items():
            node = 0
            for byte in raw:
                node = nodes.setdefault((node, byte + 1), len(nodes))
            ends[node] = i
        keys = np.array([n * 257 + b for n, b in nodes], np.int64)
        order = np.argsort(keys)
        self.steps, self.step_to = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.token_at = np.full(len(nodes), -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def _longest(self, data: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest token at each place of ``data`` that ends at or before the place's ``stop``."""
        token, place = np.full(len(data), -1, np.int64), np.arange(len(data))
        node, depth = np.zeros(len(data), np.int64), 0
        while len(place):
            keys = node * 257 + data[place + depth] + 1
            at = np.minimum(np.searchsorted(self.steps, keys), len(self.steps) - 1)
            found = self.steps[at] == keys
            place, node = place[found], self.step_to[at[found]]
            ends = self.token_at[node]
            token[place[ends >= 0]] = ends[ends >= 0]
            depth += 1
            inside = place + depth < stop[place]
            place, node = place[inside], node[inside]
        return token

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of each word: tokens and offsets."""
        counts = np.array([len(w) for w in words], np.int64)
        spans = _spans(counts)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        token = self._longest(data, np.repeat(spans[1:], counts))
        step = (np.arange(len(data)) + np.diff(self.token_spans)[token]).tolist()
        # a place is used if the place before it that is used leads there
        used, at, n = bytearray(len(data)), 0, len(data)
        while at < n:
            used[at] = 1
            at = step[at]
        places = np.flatnonzero(np.frombuffer(used, np.uint8))
        return token[places], np.searchsorted(places, spans)

    def merge(self, word: bytes) -> list[int]:
        """The encoding of one word by its merges, lowest rank and leftmost first."""
        tokens = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges

        heap = []
        for i in range(n - 1):
            found = merges.get((tokens[i], tokens[i + 1]))
            if found:
                heap.append((found[0], i, tokens[i], tokens[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            k = after[i]
            if tokens[i] != a or k >= n or tokens[k] != b:
                continue
            tokens[i], tokens[k], after[i] = made, -1, after[k]
            if after[k] < n:
                before[after[k]] = i
            for at, to in ((before[i], i), (i, after[i])):
                if at >= 0 and to < n and (found := merges.get((tokens[at], tokens[to]))):
                    heapq.heappush(heap, (found[0], at, tokens[at], tokens[to], found[1]))
        return [t for t in tokens if t >= 0]

    @property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        if self._merges is None:
            pairs = zip((self.keys // self.size).tolist(), (self.keys % self.size).tolist(), strict=True)
            self._merges = dict(zip(pairs, zip(self.rank_of.tolist(), self.made_by.tolist(), strict=True), strict=True))
        return self._merges

    _merges = None

    def forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {}
        self.flat, self.spans = Grown(), Grown()
        self.spans.add(np.zeros(1, np.int64))
        self._remember([(content,) for content in self.added], np.array([*self.added.values()], np.int64),
                       np.ones(len(self.added), np.int64))

    def _remember(self, words: list, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.spans.add(len(self.flat) + np.cumsum(counts))
        self.flat.add(tokens)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        raws = [w.encode() for w in words]
        tokens, spans = self.propose(raws)
        owner = np.repeat(np.arange(len(words)), np.diff(spans))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failing = np.zeros(len(words), bool)
        failing[owner[inner[~self.compatible(tokens[inner], tokens[inner + 1])]]] = True
        good, bad = np.flatnonzero(~failing), np.flatnonzero(failing)
        self._remember([words[i] for i in good.tolist()], tokens[~failing[owner]], np.diff(spans)[good])
        exact = [self.merge(raws[i]) for i in bad.tolist()]
        flat = np.array([t for own in exact for t in own], np.int64)
        self._remember([words[i] for i in bad.tolist()], flat, np.array([len(own) for own in exact], np.int64))

    def _pieces(self, text: str) -> Iterator[list]:
        """The words of a text, piece by piece; an added token is a tuple of its string."""
        for i, part in enumerate(self.added_in.split(text) if self.added_in else [text]):
            if i % 2:
                yield [(part,)]
                continue
            at = 0
            while at < len(part):
                to = at + PIECE
                if to < len(part):
                    # no word goes on from another character into white space
                    border = _BORDER.search(part, to)
                    to = border.start() + 1 if border else len(part)
                yield self.words_of(part[at:to])
                at = to

    def _ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words one after the other, and how many each has."""
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.forget()
                new = set(words).difference(self.known)
            self.learn(list(new))
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = self.spans.values[rows]
        counts = self.spans.values[rows + 1] - starts
        return self.flat.values[_gather(starts, counts)], counts

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after the other, and their offsets."""
        found, held, ends, of_text = [], [], [], []
        totals = np.zeros(len(texts), np.int64)

        def flush() -> None:
            ids, counts = self._ids(held)
            found.append(ids)
            at = _spans(counts)[np.array([0, *ends])]
            np.add.at(totals, of_text, np.diff(at))
            held.clear(), ends.clear(), of_text.clear()

        for i, text in enumerate(texts):
            for words in self._pieces(text) if text else ():
                held += words
                ends.append(len(held))
                of_text.append(i)
                if len(held) > HELD_WORDS:
                    flush()
        if held:
            flush()
        return np.concatenate([np.zeros(0, np.int64), *found]), _spans(totals)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        starts, counts = self.token_spans[ids], self.token_spans[ids + 1] - self.token_spans[ids]
        return self.token_bytes[_gather(starts, counts)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_BORDER = regex.compile(r"\S(?=\s)")


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def map_tokens(
    docs: DataFrame, keep: list[str], schema: str, build: Callable[[np.ndarray, str], tuple], text: str = "text",
    model: str = MODEL,
) -> DataFrame:
    """Rows of ``keep`` beside the values of ``build(ids, decoded)`` for every text; ``schema`` names them."""
    out_schema = StructType([docs.schema[name] for name in keep] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(model)
        for batch in batches:
            for part in slices(batch, text):
                ids, spans = bpe.encode_many(part.column(text).to_pylist())
                own = [ids[a:b] for a, b in zip(spans[:-1], spans[1:], strict=True)]
                rows = [build(each, bpe.decode(each)) for each in own]
                yield batch_of([*(part.column(name) for name in keep), *zip(*rows, strict=True)], arrow)

    read = [*keep, *([text] if text not in keep else [])]
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, out_schema)


def encode_texts(docs: DataFrame, keep: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """``keep``, ``token_ids`` (array of int) and ``decoded``, the text that the ids give back."""
    return map_tokens(docs, keep, "token_ids array<int>, decoded string", lambda ids, s: (ids, s), text, model)


def decode_ids(tokens: DataFrame, ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``tokens`` with the column ``decoded``; null ids give null."""
    out_schema = StructType([*(f for f in tokens.schema.fields if f.name != "decoded"), *StructType.fromDDL("decoded string")])
    arrow, names = to_arrow_schema(out_schema), [f.name for f in out_schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(model)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            texts = [None if own is None else bpe.decode(np.array(own, np.int64)) for own in lists]
            yield batch_of([*(batch.column(name) for name in names), texts], arrow)

    return tokens.mapInArrow(run, out_schema)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text of every document."""

    def digests(ids: np.ndarray, decoded: str) -> tuple:
        of_ids = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
        return len(ids), of_ids, hashlib.sha256(decoded.encode()).hexdigest()

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_tokens(table(spark, sf_dir, "documents"), ["doc_id"], schema, digests)
