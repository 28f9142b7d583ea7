"""Byte-pair encoding cut into fragments that can be encoded on their own.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never be merged, nor can
anything across them: a token that held both would hold them side by side. Such places are certain cuts, word ends
among them. Between two cuts the merges run as if the rest of the text did not exist, so every fragment is encoded
once, remembered, and the ids are put together in order.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passel.llm.tables import held, of_row, released

WORD_END = "</w>"
# Texts are encoded in slices of about so many characters, cut at white space.
SLICE_CHARS = 1 << 20
# Chunks that a worker remembers twice over, about.
REMEMBERED = 100_000
# Texts whose ids are held as Python numbers at once.
AT_ONCE = 1024
# Words up to this many bytes are merged together, longer ones each with a heap.
SHORT = 48

# How ids are held: little-endian, four bytes each.
ID = np.dtype("<u4")
# A pair of symbols, or a rank with the token that it makes, in one number.
BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 62

# Below U+0530 Python's character tables equal the library's; texts beyond take the library's own rules.
BEYOND = re.compile("[\x1c-\x1f\u0530-\U0010ffff]")
NUMBERS = "\\d\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
WORDS = re.compile(f"'(?:[stdm]|re|ve|ll)|[^\\W_{NUMBERS}]+|[{NUMBERS}]|(?:[^\\w\\s]|_)+")
SPACE = re.compile("[ \t\n\r]")
# Signs that often end a chunk and are words of their own.
MARKS = ".,;:!?"


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class FragmentEncoder:
    """The encoding of one vocabulary file, given as its JSON text."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.vocabulary: dict[str, int] = model["model"]["vocab"]
        self.end: str = model["model"].get("end_of_word_suffix") or ""
        # Symbols are token ids: those of a byte inside a word, and of a byte that ends one.
        letters = byte_letters()
        self.letters = {c: b for b, c in enumerate(letters)}
        self.symbols = np.array([self.vocabulary.get(c + e, 0) for e in ("", self.end) for c in letters])
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.vocabulary[left] << BITS | self.vocabulary[right]
            self.ranks[pair] = rank << BITS | self.vocabulary[left + right]
        self.pairs = np.array(sorted(self.ranks))
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()])
        self.joined = self._joined_pairs()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        # The library's rules for odd characters, without its vocabulary.
        rules = model | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        library = Tokenizer.from_str(json.dumps(rules))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        names = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        # The ids of chunks of late, as bytes, and of those before them: what is used again moves up, the rest is forgotten.
        self.known: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}

    def _joined_pairs(self) -> np.ndarray:
        """Whether two bytes, those that end a word counted from 256 on, stand side by side inside some token.

        Between all others a cut is certain.
        """
        joined = np.zeros((512, 512), bool)
        for token in self.vocabulary:
            ends = bool(self.end) and token.endswith(self.end)
            codes = [self.letters[c] for c in (token.removesuffix(self.end) if ends else token)]
            if ends and codes:
                codes[-1] += 256
            joined[codes[:-1], codes[1:]] = True
        return joined

    def _codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some words, those that end a word counted from 256 on, and where fragments begin."""
        codes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words]) - 1
        if self.end:
            codes[ends] += 256
        begins = np.concatenate([[True], ~self.joined[codes[:-1], codes[1:]]])
        begins[ends[:-1] + 1] = True
        return codes, begins

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged token of each pair of symbols, NONE where there is no merge."""
        wanted = left << BITS | right
        place = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[place] == wanted, self.pair_ranks[place], NONE)

    def _merged(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all fragments, and the fragment of each.

        In every round each fragment merges its pair of lowest rank, the first one of equals; fragments without
        a pair to merge are done.
        """
        fragment = np.cumsum(begins) - 1
        rank = np.full(len(symbols), NONE)
        inside = np.flatnonzero(~begins[1:])
        rank[inside] = self._rank_of(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            going = best != NONE
            if not going.all():
                done.append((symbols[~going], fragment[~going]))
                symbols, fragment, rank, best = symbols[going], fragment[going], rank[going], best[going]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == best)
            first = hits[np.concatenate([[True], fragment[hits[1:]] != fragment[hits[:-1]]])]
            symbols[first] = best[first] & MASK
            kept = np.ones(len(symbols), bool)
            kept[first + 1] = False
            symbols, fragment, rank = symbols[kept], fragment[kept], rank[kept]
            merged = first - np.arange(len(first))
            # Both pairs that the new token is in have another rank now.
            for left in (merged[merged > 0] - 1, merged):
                last = left + 1 >= len(symbols)
                right = np.where(last, left, left + 1)
                same = (fragment[left] == fragment[right]) & ~last
                ranks = np.full(len(left), NONE)
                ranks[same] = self._rank_of(symbols[left[same]], symbols[right[same]])
                if left is merged:
                    rank[left] = ranks
                else:
                    rank[left[same]] = ranks[same]
        tokens, fragment = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(fragment, kind="stable")
        return tokens[order], fragment[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of short words of letters, numbers or signs, each fragment on its own."""
        if not words:
            return []
        codes, begins = self._codes(words)
        tokens, fragment = self._merged(self.symbols[codes], begins)
        word_of = np.repeat(np.arange(len(words)), [len(w) for w in words])[np.flatnonzero(begins)]
        stops = np.cumsum(4 * np.bincount(word_of[fragment], minlength=len(words))).tolist()
        ids = tokens.astype(ID).tobytes()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def encode_long(self, word: bytes) -> bytes:
        """The ids of a word of any length, whose fragments are merged with a heap in n log n steps."""
        codes, begins = self._codes([word])
        symbols, cuts = self.symbols[codes].tolist(), [*np.flatnonzero(begins).tolist(), len(word)]
        return np.array([i for a, b in zip(cuts, cuts[1:]) for i in self._merged_by_heap(symbols[a:b])], ID).tobytes()

    def _merged_by_heap(self, parts: list[int]) -> list[int]:
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        rank = self.ranks.get
        heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << BITS | b))]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank(parts[i] << BITS | parts[j]) != r:
                continue
            parts[i], parts[j] = r & MASK, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank(parts[left] << BITS | parts[right])):
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p >= 0]

    def _learn(self, chunks: list[str | bytes]) -> list[str | bytes]:
        """Encode distinct chunks that are not known; gives those that are too long to be remembered."""
        known, older = self.known, self.older
        # A bytes chunk is a word as the library splits it; other chunks may hold several words.
        words, several, long = set(), {}, []
        for chunk in chunks:
            if (ids := older.get(chunk)) is not None:
                known[chunk] = ids
            elif isinstance(chunk, bytes) or chunk.isalpha():
                words.add(chunk)
            elif chunk[-1:] in MARKS and (head := chunk[:-1]).isalpha():
                several[chunk] = (head, chunk[-1])
                if head not in known:
                    words.add(head)
            else:
                several[chunk] = own = WORDS.findall(chunk)
                words.update(w for w in own if w not in known)
        words.update(m for m in MARKS if m not in known)
        short, data = [], []
        for word in words:
            own = word if isinstance(word, bytes) else word.encode()
            if len(own) <= SHORT:
                short.append(word)
                data.append(own)
            else:
                known[word] = self.encode_long(own)
                long.append(word)
        known.update(zip(short, self.encode_words(data)))
        for chunk, own in several.items():
            if chunk not in known:
                known[chunk] = known[own[0]] + known[own[1]] if len(own) == 2 else b"".join(map(known.__getitem__, own))
                if len(chunk) > SHORT:
                    long.append(chunk)
        return long

    def _prepared(self, text: str) -> str | list[bytes]:
        """A text without special tokens in lower case, its words between blanks; or its words, by the library's rules."""
        if BEYOND.search(text):
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes(map(self.letters.__getitem__, piece)) for piece, _ in pieces]
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # The final sigma is no case of its own here; two blanks are not ASCII.
            text = text.replace("\u03a3", "\u03c3").replace("\x85", " ").replace("\xa0", " ")
        return text.lower()

    def _ids(self, chunks: pa.Array, sizes: np.ndarray) -> list[bytes]:
        """The ids of runs of ``sizes`` chunks. Each distinct chunk is looked up once, and its ids are taken by number."""
        coded = chunks.dictionary_encode()
        distinct = _strings(coded.dictionary)
        found = [*map(self.known.get, distinct)]
        missing = _places_of_none(found)
        long = self._learn([distinct[i] for i in missing])
        for i in missing:
            found[i] = self.known[distinct[i]]
        for chunk in long:
            del self.known[chunk]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // ID.itemsize
        starts, ids = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(found), ID)
        number = coded.indices.to_numpy()
        taken = lengths[number]
        stops = np.cumsum(taken)
        at = np.repeat(starts[number] - stops + taken, taken)
        at += np.arange(len(at))
        cuts = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = ids[at]
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _sliced(self, text: str) -> Iterator[str | int]:
        """Slices of a text cut at white space, and the ids of the special tokens between them."""
        start = 0
        for found in self.special_pattern.finditer(text):
            yield from self._cut(text, start, found.start())
            yield self.special[found[0]]
            start = found.end()
        yield from self._cut(text, start, len(text))

    def _cut(self, text: str, start: int, end: int) -> Iterator[str]:
        while start < end:
            blank = SPACE.search(text, start + SLICE_CHARS, end)
            stop = blank.start() if blank else end
            yield text[start:stop]
            start = stop

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of some texts. They are encoded in groups of slices, so that many words are merged at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        # Texts with the words that the library splits are few; the two kinds are looked up apart.
        groups: dict[type, list[tuple[int, int, str | list[bytes]]]] = {str: [], list: []}
        size = 0

        def finish() -> None:
            found: list[tuple[int, int, bytes]] = []
            if plain := groups[str]:
                runs = pc.ascii_split_whitespace(pa.array([part for *_, part in plain], pa.string()))
                ids = self._ids(pc.list_flatten(runs), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                found += [(place, n, own) for (place, n, _), own in zip(plain, ids)]
            if split := groups[list]:
                ids = self._ids(pa.array([w for *_, part in split for w in part], pa.binary()), np.array([len(part) for *_, part in split]))
                found += [(place, n, own) for (place, n, _), own in zip(split, ids)]
            for _, n, own in sorted(found, key=lambda f: f[0]):
                out[n].append(own)
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}
            plain.clear()
            groups[list].clear()

        for n, text in enumerate(texts):
            for part in self._sliced(text):
                if isinstance(part, int):
                    finish()
                    out[n].append(np.array([part], ID).tobytes())
                    continue
                prepared = self._prepared(part)
                groups[type(prepared)].append((len(groups[str]) + len(groups[list]), n, prepared))
                size += len(part)
                if size >= SLICE_CHARS:
                    finish()
                    size = 0
        finish()
        return [np.frombuffer(b"".join(parts), ID) for parts in out]

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens behind the ids, as the library writes them for a vocabulary without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def _strings(chunks: pa.Array) -> list[str | bytes]:
    """The values of a column; strings, which hold no blank here, all at once by joining and splitting them."""
    if not len(chunks) or not pa.types.is_string(chunks.type):
        return chunks.to_pylist()
    whole = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


def _places_of_none(found: list) -> list[int]:
    places, i = [], -1
    try:
        while True:
            places.append(i := found.index(None, i + 1))
    except ValueError:
        return places


def encoder(spec: str) -> FragmentEncoder:
    """The encoder of a vocabulary, one for each worker process.

    The package's code comes anew with every task, so the encoder, with the words that it knows, is kept where all
    tasks of a worker find it.
    """
    kept = sys.modules.setdefault("_passel_encoders", ModuleType("_passel_encoders")).__dict__
    if spec not in kept:
        kept[spec] = FragmentEncoder(spec)
    return kept[spec]


def vocabulary(spark, path: str):
    """The vocabulary file as a broadcast value; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``ids``, the token ids of the whole text, and ``decoded``, the text read from them.

    Null and empty texts have no ids and decode to an empty text; input columns called like the new ones are replaced.
    """
    spec = vocabulary(docs.sparkSession, path)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encoded(texts: pa.Array) -> pa.Array:
        use, parts = encoder(spec.value), []
        names = pa.array(use.names)
        for start in range(0, max(1, len(texts)), AT_ONCE):
            ids = use.encode_batch([t.as_py() or "" for t in texts[start : start + AT_ONCE]])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, ID), *ids]).astype(np.int32))
            decoded = pc.binary_join(pa.ListArray.from_arrays(ends, names.take(flat)), " ")
            parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, flat), decoded], ["ids", "decoded"]))
        return pa.concat_arrays(parts)

    both = held(docs).withColumn("encoded", encoded(of_row(text_col)))
    return released(both, docs.columns, ids=F.col("encoded.ids"), decoded=F.col("encoded.decoded"))
