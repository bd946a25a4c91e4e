"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never runs the merges. An Aho-Corasick automaton over the vocabulary gives the longest token at every
position of a word; tokens are laid from the left, a token is taken only if the pair that it makes with the one before
is compatible (encoding both tokens' text together gives these two), else a shorter prefix is tried, else the last
token is taken back. Positions found impossible are marked, so each is left once and the work is linear. For merge
lists in which every token comes from one pair this is the merges' own result, pair by pair.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.store import per_batch, read_table, slices


@lru_cache(4)
def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PairTable:
    """Whether token b may follow token a; filled as pairs come up, emptied when it holds `most` pairs."""

    def __init__(self, merges: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]], rank: dict[int, int], most: int = 1 << 20):
        self.merges, self.parts, self.rank, self.most, self.known = merges, parts, rank, most, {}

    def fits(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[a, b] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Undoes the merges next to the border, the latest first; none of the states on the way may merge across it
        before the merge that was undone (on equal rank the left one comes first)."""
        limit = len(self.rank) + 1
        while True:
            across = self.merges.get((a, b))
            if across is not None and self.rank[across] < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]


class BacktrackingEncoder:
    """Encodes single words given as strings of symbols, one character a symbol.

    tokens: symbol string -> id; merges: (left id, right id) in order of rank.
    """

    def __init__(self, tokens: dict[str, int], merges: list[tuple[int, int]]):
        text = {i: s for s, i in tokens.items()}
        by_pair = {pair: tokens[text[pair[0]] + text[pair[1]]] for pair in merges}
        if len(set(by_pair.values())) != len(merges):
            raise ValueError("a token comes from two merges: this encoder is not exact for the vocabulary")
        self.ids = tokens
        rank = dict.fromkeys(text, -1) | {made: r for r, made in enumerate(by_pair.values())}
        self.pairs = PairTable(by_pair, {made: pair for pair, made in by_pair.items()}, rank)
        self.size = {i: len(s) for i, s in text.items()}
        self.shorter = {i: next((tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in tokens), None) for i, s in text.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in tokens.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def longest(self, word: str) -> list[int | None]:
        """The longest token at every position."""
        best: list[int | None] = [None] * len(word)
        size = self.size
        for end, token in self.automaton.iter(word):
            best[end + 1 - size[token]] = token  # ends grow: the last is the longest
        return best

    def encode(self, word: str) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None and self.pairs.rank[whole] < 0:
            return [whole]
        out = [token for _, token in self.automaton.iter_long(word)]
        known, fits = self.pairs.known.get, self.pairs.fits
        for i, pair in enumerate(zip(out, out[1:], strict=False)):
            ok = known(pair)
            if not (fits(*pair) if ok is None else ok):
                return self.step_back(word, out[: i + 1])
        if sum(map(self.size.__getitem__, out)) == len(word):
            return out  # the longest matches from the left need no step back
        return self.step_back(word, [])

    def step_back(self, word: str, out: list[int]) -> list[int]:
        """Goes on from tokens that fit."""
        best, size, shorter = self.longest(word), self.size, self.shorter
        known, fits = self.pairs.known.get, self.pairs.fits
        n, at = len(word), sum(map(size.__getitem__, out))
        possible = bytearray(b"\1") * (n + 1)
        token = best[at] if at < n else None
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                if possible[at + size[token]]:
                    ok = True if last is None else known((last, token))
                    if fits(last, token) if ok is None else ok:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = best[at] if at < n else None
            elif last is None:
                raise ValueError("a symbol is not in the vocabulary")
            else:
                possible[at] = 0
                out.pop()
                at -= size[last]
                token = shorter[last]
        return out


#: Fixed values of the word-level format: its special strings, word-end mark and word pattern.
SPECIAL = re.compile(r"(<\|(?:startoftext|endoftext)\|>)")
WORD_END = "</w>"
#: Texts of these characters only are normalised and split by the patterns below; all others by the library's own
#: normaliser and splitter. Both give the same words; the first is faster.
USUAL = re.compile("[\\x00-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
SPACES = re.compile("[\\t-\\r \\x85\\xa0]+")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
USUAL_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ {_LETTERS}{_NUMBERS}]+")


class _WordIds(dict):
    """word -> its ids as little-endian 32-bit integers; emptied when it holds `most` words."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordBpe:
    """The vocabulary file's encoding and decoding, as the tokenizers library does them without special tokens."""

    def __init__(self, path: str, words_kept: int = 200_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = spec["model"]
        if self.model["type"] != "BPE" or self.model["end_of_word_suffix"] != WORD_END:
            raise ValueError("not a word-level BPE vocabulary")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.word_ids = _WordIds(self._encode_word, words_kept)

    @cached_property
    def encoder(self) -> BacktrackingEncoder:
        # a byte that ends a word is a symbol of its own
        byte = {c: b for b, c in enumerate(byte_chars())}

        def symbols(token: str) -> str:
            codes = [byte[c] for c in token.removesuffix(WORD_END)]
            codes[-1] += 256 * token.endswith(WORD_END)
            return "".join(map(chr, codes))

        vocab = self.model["vocab"]
        merges = [(vocab[a], vocab[b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in self.model["merges"])]
        return BacktrackingEncoder({symbols(t): i for t, i in vocab.items()}, merges)

    @cached_property
    def id_bytes(self) -> list[bytes]:
        return [int(i).to_bytes(4, "little") for i in range(max(self.model["vocab"].values()) + 1)]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return offset_table({i: t for t, i in (self.model["vocab"] | self.special).items()}, b" ")

    def _encode_word(self, word: str) -> bytes:
        data = word.encode()
        ids = self.encoder.encode(data[:-1].decode("latin-1") + chr(256 + data[-1]))
        return b"".join(map(self.id_bytes.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        if USUAL.fullmatch(text):
            return USUAL_WORDS.findall(SPACES.sub(" ", text).lower())
        chars = {c: b for b, c in enumerate(byte_chars())}
        parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(chars[c] for c in part).decode() for part, _ in parts]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers; null counts as empty."""
        out = []
        for i, part in enumerate(SPECIAL.split(text or "")):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += map(self.word_ids.__getitem__, self.words(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings joined by a space, in UTF-8: this vocabulary file names no decoder."""
        return decode_by_offsets(ids, *self.table)[:-1]


def offset_table(tokens: dict[int, str], after: bytes) -> tuple[np.ndarray, np.ndarray]:
    """offsets[i]:offsets[i + 1] is the place of token i's text, with `after` behind it, in one block of bytes."""
    texts = [tokens[i].encode() + after if i in tokens else b"" for i in range(max(tokens) + 1)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return offsets, np.frombuffer(b"".join(texts), np.uint8)


def decode_by_offsets(ids: bytes, offsets: np.ndarray, blob: np.ndarray, at_once: int = 1 << 20) -> bytes:
    found = np.frombuffer(ids, "<u4").astype(np.int64)
    out = []
    for i in range(0, len(found), at_once):
        part = found[i : i + at_once]
        start = offsets[part]
        size = offsets[part + 1] - start
        before = np.cumsum(size) - size
        out.append(blob[np.repeat(start - before, size) + np.arange(size.sum())].tobytes())
    return b"".join(out)


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit) of every whole text; null texts count as empty. No shuffle.

    Rows without doc_id and repeated rows each keep their row; an empty table gives an empty one. Other columns of docs are
    ignored.
    """

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        bpe = word_bpe(path)
        for part in slices(batch, 1):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded (string) of every row; null ids decode to an empty string. Repeated rows each keep their row,
    an empty table gives an empty one, other columns are ignored."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        bpe = word_bpe(path)
        for part in slices(batch, 1):
            texts = [bpe.decode(i or b"") for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return per_batch(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole of documents."""
    path = path or default_path("word_bpe_49k.json")
    both = decode_documents(encode_documents(read_table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
