"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie; their sorted order is its depth-first order. Along the
path the traversal keeps, for every prefix, the last token of that prefix's encoding, so prefixes
that words share are encoded once. The state of a prefix ``s[:i]`` is the one vocabulary token
``t = s[j:i]`` that may follow the state of ``s[:j]``: two tokens may be neighbours exactly if BPE
turns their joined symbols back into these two. Reading the states back from a word's end gives its
tokens.

Defined results: null and empty texts have no tokens; texts of any length are encoded whole; equal
texts get equal ids; the library's special tokens in a text become their own ids, as the library
does with ``add_special_tokens=False``; an empty table gives an empty table; only the id and text
columns are read, so other columns may have any name. Only tokenizer files whose words end at white
space are taken (see ``drops_spaces``); others raise ValueError before anything runs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import kept, map_rows

DEFAULT_FILE = "word_bpe_49k.json"
#: Bytes of words and encodings that a worker keeps, about.
CACHE_BYTES = 16 << 20
#: Entries of each of the trie's tables; a full one is begun anew.
TABLE_ENTRIES = 1_000_000


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    """A full path stays as it is; a bare name is looked up among the public tokenizer files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: The words of the tokenizer's splitter in lower-cased ASCII and Latin-1: contractions, runs of letters, single digits, runs of the rest.
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\x09-\\x0d a-z0-9]+")
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\x09-\\x0d \\x85\\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_BEYOND = re.compile("[^\\x00-\\xff]")
#: The normalizer and splitter that these patterns stand for (fixed values of the tokenizer's format).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def drops_spaces(spec: dict) -> bool:
    """True for a tokenizer file that lower-cases, drops white space and splits as _SPLITTER."""
    plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
    return plain and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLITTER


def fitting_spec(path: str) -> dict:
    """A tokenizer file's content; ValueError if it is of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not drops_spaces(spec) or spec["model"]["type"] != "BPE" or not spec["model"]["end_of_word_suffix"] or spec["decoder"]:
        raise ValueError(f"{path}: only BPE with word ends, white space dropped and no decoder")
    return spec


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def library(path: str):
    """The tokenizers library's object for a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """Words of a text as the tokenizer sees them; BPE never joins across words.

    Texts of Latin-1 characters, which normalizing only lower-cases, go through a pattern; others through the
    library's normalizer and splitter, so that character classes are the library's own.

    Neither looks across white space, so parts of a text between white space can be split on their own (``parts``).
    """

    def __init__(self, path: str):
        t = library(path)
        self.normalize, self.pieces = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str
        self.special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.sign = os.path.commonprefix(list(self.special))
        #: Whether white space cuts special tokens, so that texts must be split whole.
        self.whole = any(x.split() != [x] for x in self.special)
        self.odd = "|".join(["[^\\x00-\\xff]", *map(re.escape, self.special)])

    def __call__(self, text: str | None) -> list[str]:
        """Words after normalizing; special tokens whole."""
        if not text:
            return []
        if not self.special_re or self.sign not in text or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [*self._plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def parts(self, parts: pa.Array) -> pa.Array:
        """Lists of the words of texts without ASCII white space; they hold empty strings, too, which are none.

        Those without special tokens and characters beyond Latin-1 are split by Arrow, all at once.
        """
        low = pc.replace_substring(pc.replace_substring(pc.utf8_lower(parts), "\x85", " "), "\xa0", " ")
        words, odd = pc.replace_substring_regex(low, _LATIN.pattern, "\\0 "), pc.match_substring_regex(parts, self.odd)
        if pc.any(odd).as_py():
            words = pc.replace_with_mask(words, odd, pa.array([" ".join(self(p)) for p in parts.filter(odd).to_pylist()], parts.type))
        return pc.ascii_split_whitespace(words)

    def _plain(self, part: str) -> list[str]:
        if part.isascii():
            return _ASCII.findall(part.lower())
        if not _BEYOND.search(part):
            return _LATIN.findall(part.lower())
        low = self.normalize(part)
        return [low[a:b] for _, (a, b) in self.pieces(low)]


class TrieBPE:
    """Encoder and decoder for a byte-level BPE vocabulary with a word-end suffix.

    A word is a string of symbols: its bytes as characters 0..255, the last one moved to 256..511,
    as a symbol at a word's end differs from the same byte inside.
    """

    def __init__(self, path: str):
        spec = fitting_spec(path)
        model, self.alphabet = spec["model"], _byte_chars()
        self.suffix = model["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: t.encode() for t, i in (model["vocab"] | added).items()}
        self.special, self.split = added, Splitter(path)
        self.ids = {s: i for t, i in model["vocab"].items() if (s := self._symbols_of_token(t)) is not None}
        self.rank: dict[tuple[str, str], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self._symbols_of_token(a), self._symbols_of_token(b)] = k
        self._edges: dict[str, tuple | None] = {}
        self._follow: dict[int, bool] = {}
        self._build_suffixes()

    def _symbols_of_token(self, token: str) -> str | None:
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        if not body or any(c not in self.alphabet for c in body):
            return None
        s = "".join(chr(self.alphabet[c]) for c in body)
        return s[:-1] + chr(ord(s[-1]) + 256) if end else s

    def merge(self, s: str) -> list[str]:
        """Plain BPE of a symbol string: the best-ranked neighbours join first, from the left."""
        parts = list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def edges(self, token: str) -> tuple | None:
        """How a token's first and last parts grow while BPE makes it: two lists of (part, rank that made it).

        None for a token that BPE doesn't make of its own symbols; none such occurs in an encoding.
        """
        if token not in self._edges:
            parts: list[tuple] = [(c, -1, None, None) for c in token]
            while len(parts) > 1:
                ranks = [self.rank.get((x[0], y[0]), 1 << 30) for x, y in zip(parts, parts[1:], strict=False)]
                k = ranks.index(best := min(ranks))
                if best == 1 << 30:
                    break
                parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], best, parts[k], parts[k + 1])]

            def spine(side: int) -> list[tuple[str, int]]:
                out, x = [], parts[0]
                while x:
                    out.append(x[:2])
                    x = x[side]
                return out[::-1]

            self._edges[token] = (spine(2), spine(3)) if len(parts) == 1 and token in self.ids else None
        return self._edges[token]

    def may_follow(self, left: str, right: str) -> bool:
        """True if BPE of the joined symbols gives exactly these two tokens.

        Both grow towards their border in rank order; they stay apart unless the two parts that
        meet there can merge before either of them is used up by its own side.
        """
        a, b = self.edges(left), self.edges(right)
        good = a is not None and b is not None
        if good:
            ends, starts, i, j = a[1], b[0], 0, 0
            while good:
                next_a = ends[i + 1][1] if i + 1 < len(ends) else 1 << 30
                next_b = starts[j + 1][1] if j + 1 < len(starts) else 1 << 30
                meet = self.rank.get((ends[i][0], starts[j][0]), 1 << 30)
                if meet < next_a and (meet <= next_b and meet < 1 << 30):
                    good = False
                elif next_a == next_b == 1 << 30:
                    break
                elif next_a <= next_b:
                    i += 1
                else:
                    j += 1
        return good

    def _build_suffixes(self) -> None:
        """An automaton over the vocabulary: after each symbol, the longest vocabulary prefix that ends here."""
        self.state_of = {"": 0}
        self.prefixes = [""]
        for t in self.ids:
            for n in range(1, len(t) + 1):
                if t[:n] not in self.state_of:
                    self.state_of[t[:n]] = len(self.prefixes)
                    self.prefixes.append(t[:n])
        self._next: dict[int, int] = {}
        self._ending: dict[int, tuple[tuple[int, int, str], ...]] = {}
        self.symbols_of = {i: s for s, i in self.ids.items()}

    def step(self, state: int, symbol: str) -> int:
        s = self.prefixes[state] + symbol
        while s not in self.state_of:
            s = s[1:]
        self._next[state << 9 | ord(symbol)] = self.state_of[s]
        return self.state_of[s]

    def ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """Tokens that end in a state, longest first: (id, length)."""
        s = self.prefixes[state]
        self._ending[state] = tuple((self.ids[t], len(t)) for k in range(len(s)) if (t := s[k:]) in self.ids and self.edges(t))
        return self._ending[state]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct symbol strings, by one depth-first pass over their trie."""
        for kept in (self._follow, self._next, self._ending):
            if len(kept) > TABLE_ENTRIES:
                kept.clear()
        out, before = {}, ""
        last, back, states = [-1], [0], [0]
        follow, moves, endings = self._follow, self._next, self._ending
        for s in sorted(words):
            shared, most = 0, min(len(before), len(s))
            while shared < most and before[shared] == s[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], states[shared + 1 :]
            state, i = states[shared], shared
            for c in map(ord, s[shared:]):
                if (to := moves.get(state << 9 | c)) is None:
                    to = self.step(state, chr(c))
                state = to
                states.append(state)
                i += 1
                for t, n in endings.get(state) or self.ending(state):
                    if n == i:
                        break  # the token is the whole prefix
                    pair = last[i - n] << 20 | t
                    if (good := follow.get(pair)) is None:
                        good = follow[pair] = self.may_follow(self.symbols_of[last[i - n]], self.symbols_of[t])
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends the prefix {s[:i]!r}")
                last.append(t)
                back.append(n)
            found = []
            while i:
                found.append(last[i])
                i -= back[i]
            found.reverse()
            out[s] = pack(found)
            before = s
        return out

    def encode_pieces(self, pieces: list[str]) -> pa.Array:
        """Ids of distinct words, packed as little-endian unsigned 32-bit integers."""
        symbols = {}
        for p in pieces:
            if p not in self.special:
                s = p if p.isascii() else p.encode().decode("latin-1")
                symbols[p] = s[:-1] + chr(ord(s[-1]) + 256)
        coded = self.encode_words(list(symbols.values()))
        return pa.array([coded[symbols[p]] if p in symbols else pack([self.special[p]]) for p in pieces], pa.large_binary())

    def decode(self, ids: list[int]) -> bytes:
        """The library's decode for a tokenizer file without a decoder: token strings joined by spaces."""
        return b" ".join(map(self.text_of.__getitem__, ids))


@kept
@functools.lru_cache(2)
def encoder(path: str) -> TrieBPE:
    return TrieBPE(path)


class Kept:
    """Values by word as Arrow arrays of about ``most`` bytes; when they hold more, only those last asked for stay."""

    def __init__(self, make: Callable[[list[str]], pa.Array], most: int):
        self.make, self.most = make, most
        self.words, self.values = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())

    def of(self, words: pa.Array) -> pa.Array:
        """The values of distinct words, the empty string among them, making those that are missing."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        if (new := at < 0).any():
            at[new] = np.arange(len(self.words), len(self.words) + new.sum())
            names = words.filter(pa.array(new))
            self.words = pa.concat_arrays([self.words, names])
            self.values = pa.concat_arrays([self.values, self.make(names.to_numpy(zero_copy_only=False).tolist())])
        values = self.values.take(pa.array(at))
        if self.words.nbytes + self.values.nbytes > self.most:
            self.words, self.values = words, values
        return values


def _joined(values: pa.Array, places: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The values at the places between offsets that follow one another, as one value."""
    taken = values.take(places)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[offsets]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), taken.buffers()[2]])


class TextEncoder:
    """Packed ids of texts, from encodings of their words.

    Only the distinct parts (between white space) of the texts at hand are split into words, and Python sees only words
    that aren't kept; the rest is done on Arrow arrays.
    """

    def __init__(self, split: Splitter, encode: Callable[[list[str]], pa.Array], most: int = CACHE_BYTES):
        self.split, self.words = split, Kept(encode, most)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        if self.split.whole:
            lists = pa.array([["", *self.split(t)] for t in texts], pa.list_(pa.large_string()))
        else:
            lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        if not len(lists):
            return
        parts = lists.flatten().dictionary_encode()
        if self.split.whole:
            coded = self.words.of(parts.dictionary)
        else:
            split = self.split.parts(parts.dictionary)
            words = split.flatten().dictionary_encode()
            coded = _joined(self.words.of(words.dictionary), words.indices, split.offsets.to_numpy())
        yield from _joined(coded, parts.indices, lists.offsets.to_numpy()).to_pylist()


@kept
@functools.lru_cache(2)
def trie_encoder(path: str) -> TextEncoder:
    """One for each worker process: tasks that follow one another in it share the words."""
    bpe = encoder(path)
    return TextEncoder(bpe.split, bpe.encode_pieces)


def checked(path: str) -> str:
    """The tokenizer's path; raises on the driver if the file is of another kind."""
    path = tokenizer_path(path)
    fitting_spec(path)
    return path


def encode_documents(docs: DataFrame, path: str = DEFAULT_FILE) -> DataFrame:
    """(doc_id, text) -> doc_id, ids (packed little-endian uint32)."""
    path = checked(path)

    def each(batches):
        encode = trie_encoder(path)
        for ids, texts in batches:
            yield list(zip(ids, encode(texts), strict=True))

    return map_rows(docs, ["doc_id", "text"], "doc_id long, ids binary", each)


def encode_decode(docs: DataFrame, path: str = DEFAULT_FILE) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; the text is decoded from the ids."""
    path = checked(path)

    def each(batches):
        bpe, encode = encoder(path), trie_encoder(path)
        for ids, texts in batches:
            rows = []
            for i, packed in zip(ids, encode(texts), strict=True):
                decoded = bpe.decode(np.frombuffer(packed, "<u4").tolist())
                rows.append((i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield rows

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", each)
