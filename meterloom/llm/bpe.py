"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .text_hash import small_slices

#: Encoded words that a task remembers; a speed-up only: full caches are emptied, and all when the task ends.
MEMORY = 1 << 17
#: Units of a final byte of a word lie this far above those of the other bytes.
_FINAL = 1 << 16


#: The word pattern that the shortcuts below stand for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for ASCII, and for Latin-1 where Unicode's classes never change.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^\sa-zA-Z0-9]+")
_LATIN = re.compile("[!-~\xa1-\xff]+")
_LETTERS, _NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if visible, else the next free from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in visible)
    other = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chr(b) if b in visible else other[b] for b in range(256)]


_BYTES = _byte_characters()
_LATIN_BYTES = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)}


def _same_splitting(spec: dict) -> bool:
    """Whether the file composes, folds white space, lower-cases and then splits words by ``_PATTERN``."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return (
        [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": _PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and (spec["normalizer"] or {}).get("normalizers") == [{"type": "NFC"}, blanks, {"type": "Lowercase"}]
    )


class PrefixEncoder:
    """The BPE model of a tokenizer file, without the merge loop.

    For each prefix of a word there is one token that ends the prefix's encoding. An automaton over
    all tokens (``ahocorasick``: suffix links from each token to the longest token that ends it)
    yields the tokens that end at each place; of these the one is taken that BPE would leave
    beside the last token of the prefix before it. Back-pointers from the end give the ids.

    Normalisation, word splitting and special tokens are the file's own and done by the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if not _same_splitting(spec):
            raise ValueError(f"{path}: splits words in another way")
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: needs plain BPE and plain added tokens")
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        #: (left, right) -> rank of the merge, and its token
        self.merge: dict[tuple[int, int], int] = {}
        #: token -> (rank, left, right) of the merge that makes it
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.merge.setdefault((a, b), rank)
            if t in self.made:
                raise ValueError(f"{path}: token {t} is made by two merges")
            if any(self.made.get(x, (-1,))[0] >= rank for x in (a, b)):
                raise ValueError(f"{path}: merge {rank} needs a token of a later merge")
            self.made[t] = (rank, a, b)
        never = set(self._never_left())
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            units = self._token_units(token)
            if i not in never and (len(units) == 1 or i in self.made):
                self.automaton.add_word(units, (i, len(units)))
        self.automaton.make_automaton()
        #: whether two tokens fit side by side
        self.pairs: dict[tuple[int, int], bool] = {}
        self.room = MEMORY
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def _units(self, word: str) -> str:
        """A pre-token as one character a byte, the last of its own kind if words have ends."""
        return word[:-1] + chr(ord(word[-1]) + _FINAL) if self.suffix and word else word

    def forget(self) -> None:
        """Gives the memory back; Python workers outlive their tasks."""
        for memory in (self.known, self.known_words, self.pairs):
            memory.clear()

    def _token_units(self, token: str) -> str:
        whole = self.suffix and token.endswith(self.suffix) and token != self.suffix
        return self._units(token[: -len(self.suffix)]) if whole else token

    def _never_left(self) -> list[int]:
        """Tokens that BPE does not make of their own bytes, so that no encoding has them."""
        never: set[int] = set()
        for token, (_, left, right) in self.made.items():
            if left in never or right in never or not self._fits(left, right, joined=True):
                never.add(token)
        return sorted(never)

    def _fits(self, left: int, right: int, joined: bool = False) -> bool:
        """Whether BPE leaves the two tokens side by side; ``joined``: until they are merged at last.

        Goes back through the tokens at the border, undoing the later of the two sides' merges each
        time. Two tokens that stood there together must not have a merge that came before both of those
        that took them away. Of merges of equal rank the one further left comes first.
        """
        left_gone = right_gone = len(self.merge)
        while True:
            rank = self.merge.get((left, right))
            if rank is not None and rank < left_gone and rank <= right_gone and not joined:
                return False
            joined = False
            left_made, right_made = self.made.get(left), self.made.get(right)
            if left_made is None and right_made is None:
                return True
            if right_made is None or (left_made is not None and left_made[0] > right_made[0]):
                left_gone, left = left_made[0], left_made[2]
            else:
                right_gone, right = right_made[0], right_made[1]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token (already in byte characters)."""
        units = self._units(word)
        tokens, lengths, pairs = [-1] * len(units), [0] * len(units), self.pairs
        for end, (token, length) in self.automaton.iter(units):
            if tokens[end] < 0:
                if length <= end:
                    pair = (tokens[end - length], token)
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) >= self.room:
                            pairs.clear()
                        good = pairs[pair] = pair[0] >= 0 and self._fits(*pair)
                    if not good:
                        continue
                tokens[end], lengths[end] = token, length
        ids, end = [], len(units) - 1
        while end >= 0:
            ids.append(tokens[end])
            end -= lengths[end]
        return ids[::-1]

    def _words(self, chunk: str) -> list[str]:
        """Pre-tokens of normalised text without blanks, in byte characters."""
        if chunk.isascii() and chunk.isprintable():
            return _ASCII_WORDS.findall(chunk)
        if _LATIN.fullmatch(chunk):
            return [w.translate(_LATIN_BYTES) for w in _LATIN_WORDS.findall(chunk)]
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of normalised text without blanks."""
        ids, known = [], self.known_words
        for word in self._words(chunk):
            got = known.get(word)
            if got is None:
                got = np.array(self.encode_word(word), "<u4").tobytes()
                if len(known) >= self.room:
                    known.clear()
                if len(word) <= 64:
                    known[word] = got
            ids.append(got)
        return b"".join(ids)

    def _between_blanks(self, text: str) -> list[str]:
        """The stretches between blanks of the normalised text.

        Latin-1 text is its own composed form and its lower case is of one character each; rarer
        characters, and those that Python alone takes for blanks, are left to the library.
        """
        try:
            if text.isascii() or (text.encode("latin-1") and "\x85" not in text and "\xa0" not in text):
                if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                    return text.lower().split()
        except UnicodeEncodeError:
            pass
        return self.library.normalizer.normalize_str(text).split(" ")

    def _plain(self, text: str, ids: list[bytes]) -> None:
        """Ids of text without special tokens. Words recur, so those between blanks are remembered."""
        known = self.known
        for chunk in self._between_blanks(text):
            got = known.get(chunk)
            if got is None:
                got = self._chunk(chunk)
                if len(known) >= self.room:
                    known.clear()
                if len(chunk) <= 64:
                    known[chunk] = got
            ids.append(got)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as unsigned 32-bit integers."""
        ids: list[bytes] = []
        begin = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > begin:
                self._plain(text[begin : m.start()], ids)
            ids.append(np.array([self.special[m[0]]], "<u4").tobytes())
            begin = m.end()
        if begin < len(text):
            self._plain(text[begin:] if begin else text, ids)
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids as the file's library gives it without a decoder: the tokens between blanks."""
        return " ".join(map(self.text_of.__getitem__, ids.tolist()))


class LibraryEncoder(PrefixEncoder):
    """The same text handling with the library's own BPE for each word, for writers that need no other method."""

    def __init__(self, path: str):
        super().__init__(path)
        self.room = 4 * MEMORY

    def encode_word(self, word: str) -> list[int]:
        return [token.id for token in self.library.model.tokenize(word)]


@lru_cache(2)
def library_words(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def library_encoder(path: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """What a segment writer calls for its encoder: texts to ids by the tokenizers library."""

    def start() -> Callable[[list[str]], list[np.ndarray]]:
        words = library_words(path)
        words.forget()
        return lambda texts: [words.encode(x) for x in texts]

    return start


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each Python worker and file."""
    return PrefixEncoder(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>, decoded string`` for each row, ids as the tokenizers library gives them.

    ``path`` is a tokenizer file that every machine has. Null and empty texts have no ids and decode
    to the empty text. Rows are taken one by one, so repeated rows, null keys and ties make no
    difference, and the work is narrow: no shuffle, one batch of bounded bytes in memory. Other columns are
    not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for part in small_slices(batch, "text"):
                found = [tokens.encode(x or "") for x in part.column("text").to_pylist()]
                flat = np.concatenate(found).view(np.int32)
                bounds = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("key"), ids, pa.array(map(tokens.decode, found), pa.string())], names=["key", "ids", "decoded"])
        tokens.forget()

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from one pass that keeps no ids or decoded texts.

    Edge cases as in :func:`encode_documents`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for x in batch.column("text"):
                ids = tokens.encode(x.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(tokens.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tokens.forget()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
