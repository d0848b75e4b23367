"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

Every vocabulary string is entered in an automaton with suffix links, which
reports for each prefix of a word all tokens that are suffixes of that prefix.
Of these exactly one can end the prefix's own BPE encoding: the one whose pair
with the last token of the shorter prefix is compatible, which means that the merge
rules, undone one by one, would never have joined across the pair's border.  The
last token of every prefix is stored; following them backwards gives the ids.

The tokenizer's file path is a parameter.  Words that repeat are encoded once per
worker, in a dictionary of bounded size.  Ids are held in 16 bits, so vocabularies of up to 65,536 entries are read; larger ones are an error.

Defined cases: null text counts as empty; an empty text has no ids; special strings
inside a text become their own ids, as the library does by default; repeated rows are
kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker keeps at most, and the longest it keeps.
CACHE_WORDS, CACHE_PIECES, CACHE_CHARS = 400_000, 300_000, 64
WORD_PATTERN = r"[\p{L}]+|'(?:s|t|re|ve|m|ll|d)|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts below U+0250, where the standard library's classes can be spelt out.
LATIN_PATTERN = r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+"
#: Marks the last symbol of a word inside the automaton's alphabet.
LAST = 0x10000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary (lower case, white space dropped) read from a tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.content = [""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.content[i] = token
        if len(self.content) > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.content[i] = token
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        #: How each merged token splits, and the rank at which its parts join.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if whole in self.made_at:
                raise ValueError("the vocabulary makes one token by two merges")
            self.parts[whole], self.rank[pair], self.made_at[whole] = pair, rank, rank
        self.bytes = byte_alphabet()
        self.table = {b: self.bytes[b] for b in range(256)}
        self.matches = ahocorasick.Automaton()
        for token, i in vocab.items():
            body = token.removesuffix(suffix)
            text = body if body == token else body[:-1] + chr(ord(body[-1]) + LAST)
            self.matches.add_word(text, (len(text), i))
        self.matches.make_automaton()
        self.words = regex.compile(WORD_PATTERN).findall
        self.latin_words = re.compile(LATIN_PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        #: Ids of the pieces met last, and of those met before them.
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd_space = re.compile("[\x1c-\x1f]").search
        self.library = None
        self.path = path

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two encoded tokens open.

        The border is crossed at the first rank at which tokens that touch it at that time have a merge.  So undo the
        later of the two tokens' last merges again and again, and see if the two that then touch would join before it."""
        made, parts, rank = self.made_at, self.parts, self.rank
        limit = 1 << 30  # the pair touches until this rank
        while True:
            if (joined := rank.get((left, right))) is not None and joined < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of two equal tokens the left one is made first
                limit, right = b + 1, parts[right][0]

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token as 16-bit numbers."""
        text = "".join(map(self.bytes.__getitem__, word.encode()))
        text = text[:-1] + chr(ord(text[-1]) + LAST)
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        known = pairs.get
        for end, (length, token) in self.matches.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if length < end:
                before = last[end - length]
                if before < 0:
                    continue
                key = before << 16 | token
                ok = known(key)
                if ok is None:
                    if len(pairs) >= CACHE_WORDS:
                        pairs.clear()
                    ok = pairs[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return array("H", ids).tobytes()

    def normal_words(self, text: str) -> list[str]:
        """The pre-tokens of the text after composing and lower-casing it character by character; no word holds white space."""
        if text.isascii():
            return self.latin_words(text.lower())
        if max(text) < "ɐ":
            return self.latin_words(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).normalizer
        return self.words(self.library.normalize_str(text))

    def _new_piece(self, piece: str) -> bytes:
        made = self.older.get(piece)
        if made is None:
            cache, ids = self.cache, []
            for word in self.normal_words(piece):
                found = cache.get(word)
                if found is None:
                    found = self.encode_word(word)
                    if len(word) <= CACHE_CHARS:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[word] = found
                ids.append(found)
            made = b"".join(ids)
        if len(piece) <= CACHE_CHARS:
            if len(self.pieces) >= CACHE_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = made
        return made

    def _plain(self, text: str) -> list[bytes]:
        """The ids of each piece between white space.

        No pre-token crosses white space.  The separators U+001C to U+001F are white space for split() alone."""
        pieces = text.split() if not self.odd_space(text) else [text]
        out = list(map(self.pieces.get, pieces))
        if None in out:
            for at, found in enumerate(out):
                if found is None:
                    out[at] = self.pieces.get(pieces[at]) or self._new_piece(pieces[at])
        return out

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        if "<" in text:
            for m in self.special_pattern.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(array("H", [self.special[m[0]]]).tobytes())
                at = m.end()
        out += self._plain(text[at:] if at else text)
        return memoryview(b"".join(out)).cast("H").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined by one space: the tokenizer file names no decoder."""
        return " ".join(map(self.content.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) per row, and with_ids the ids and the decoded text as well."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        numerals = [str(i) for i in range(len(bpe.content))].__getitem__
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                decoded = bpe.decode(ids)
                sums = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(numerals, ids)), decoded))
                rows.append((len(ids), *sums, *((ids, decoded) if with_ids else ())))
            cols = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
