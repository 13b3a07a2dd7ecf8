"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary's whole words (the frequent words of the tokenizer's own corpus) and any further words a caller names are
compiled, with the ids of their exact merges as outputs, into a minimal acyclic automaton: equal suffixes share states, and
each arc carries how many words sort before it, so the walk of a word adds up to its place in the output table. The file
goes to every node once through the session's file server and is memory-mapped there, so the workers of a node share
its pages. Words that the automaton does not hold are merged exactly, pair by pair in the order of the ranks.

Normalisation (NFC, lower case), the split into words, the byte alphabet and the ids are those of the vocabulary file;
its special tokens are found in the raw text first. Letters, digits, white space and lower case are those of the published
tokenizers, whose tables are newer than Python's: the differences stand below and a test compares all code points.
Decoding joins the tokens of the ids with a space, as a vocabulary file without decoder asks for.

Cases: null texts are empty and have no ids; texts of any length go word by word, and a word of n letters takes time in
proportion to n log n; repeated rows give repeated rows. A worker's cache of merged words is emptied at CACHE_WORDS words
and holds no word above CACHE_LETTERS, which bounds its memory and changes no result.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import sys
import tempfile
import unicodedata
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import and_fields, text_batches

CACHE_WORDS, CACHE_LETTERS, ROWS = 250_000, 64, 512
END = "</w>"
NO_MERGE = 1 << 60
MAGIC = b"ACYC0001"
#: Words of more parts than this are merged with a heap.
LONG = 64

# What the tokenizers' Unicode tables have beyond Python 3.13's (Unicode 15.1), as first and last code point.
NEWER_LETTERS = """
1C89 1C8A, A7CB A7CD, A7DA A7DC, 105C0 105F3, 10D4A 10D65, 10D6F 10D85, 10EC2 10EC4, 11380 11389, 1138B 1138B, 1138E 1138E, 11390 113B5,
113B7 113B7, 113D1 113D1, 113D3 113D3, 11BC0 11BE0, 13460 143FA, 16100 1611D, 16D40 16D6C, 18CFF 18CFF, 1E5D0 1E5ED, 1E5F0 1E5F0
"""
NEWER_DIGITS = "10D40 10D49, 116D0 116E3, 11BF0 11BF9, 16130 16139, 16D70 16D79, 1CCF0 1CCF9, 1E5F1 1E5FA"
#: Capitals and the small letter of the first.
NEWER_CAPITALS = """
1C89 1C89 1C8A, A7CB A7CB 0264, A7CC A7CC A7CD, A7CE A7CE A7CF, A7D2 A7D2 A7D3, A7D4 A7D4 A7D5, A7DA A7DA A7DB, A7DC A7DC 019B, 10D50 10D65 10D70,
16EA0 16EB8 16EBB
"""
#: Marks that the tokenizers' composition doesn't know: they stand like letters, and what is on either side composes alone.
UNKNOWN_MARKS = """
07FD 07FD, 0898 089F, 08CA 08D3, 09FE 09FE, 0C3C 0C3C, 0D3B 0D3C, 0EBA 0EBA, 1715 1715, 1ABF 1ACE, 1DF6 1DFA, A82C A82C, 10D24 10D27, 10EAB 10EAC,
10EFD 10EFF, 10F46 10F50, 10F82 10F85, 11070 11070, 1133B 1133B, 1145E 1145E, 11839 1183A, 11930 11930, 1193D 1193E, 11943 11943, 119E0 119E0, 11A34
11A34, 11A47 11A47, 11A99 11A99, 11D42 11D42, 11D44 11D45, 11D97 11D97, 11F41 11F42, 16FF0 16FF1, 1E08F 1E08F, 1E130 1E136, 1E2AE 1E2AE, 1E2EC 1E2EF,
1E4EC 1E4EF
"""
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def hexes(listed: str) -> list[list[int]]:
    return [[int(x, 16) for x in entry.split()] for entry in listed.split(",")]


@cache
def char_class(major: str, below: int = sys.maxunicode + 1) -> str:
    """The inside of a bracket expression: all code points of a major category, L or N, below a bound."""
    inside = np.array([unicodedata.category(chr(c))[0] == major for c in range(below)])
    for a, z in hexes(NEWER_LETTERS if major == "L" else NEWER_DIGITS):
        inside[a : z + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in edges.reshape(-1, 2).tolist())


SMALL = {a + k: small + k for a, z, small in hexes(NEWER_CAPITALS) for k in range(z - a + 1)}


def any_of(ranges: list[list[int]], below: int) -> re.Pattern:
    inside = "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z, *_ in ranges if a < below)
    return re.compile(f"([{inside}])") if inside else re.compile("(?!)")


#: By the bytes that a string takes for each code point; the engine tries ranges from 0x10000 on one by one, so narrower texts are spared them.
BOUNDS = {1: 0x100, 2: 0x10000, 4: sys.maxunicode + 1}
UNKNOWN_MARK = {w: any_of(hexes(UNKNOWN_MARKS), bound) for w, bound in BOUNDS.items()}
NEWER_CAPITAL = {w: any_of(hexes(NEWER_CAPITALS), bound) for w, bound in BOUNDS.items()}


def width(text: str) -> int:
    """Bytes for each code point of a string, or more if it is short."""
    size, n = sys.getsizeof(text), len(text)
    return 4 if size >= 4 * n else 2 if size >= 2 * n else 1


def lower(text: str) -> str:
    """Small letters, letter by letter: a sigma at a word's end is an ordinary one."""
    w, text = width(text), text.replace("Σ", "σ").lower()
    return text.translate(SMALL) if w > 1 and NEWER_CAPITAL[w].search(text) else text


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


# ---- the automaton


class Builder:
    """Minimal acyclic automaton from words in byte order: states that end equally are one state."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.states: list[tuple[bool, tuple]] = []  # final, arcs (label, target)
        self.counts: list[int] = []
        self.path: list[list] = [[False, []]]
        self.last = b""

    def freeze(self, node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = self.register.get(key)
        if at is None:
            at = self.register[key] = len(self.states)
            self.states.append(key)
            self.counts.append(node[0] + sum(self.counts[t] for _, t in node[1]))
        return at

    def fold(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            node = self.path.pop()
            self.path[-1][1].append((self.last[len(self.path) - 1], self.freeze(node)))

    def add(self, word: bytes) -> None:
        if word <= self.last and self.last:
            raise ValueError("words must come sorted and without repeats")
        same = len(os.path.commonprefix([word, self.last]))
        self.fold(same)
        self.path += [[False, []] for _ in word[same:]]
        self.path[-1][0] = True
        self.last = word

    def finish(self) -> tuple[np.ndarray, ...]:
        self.fold(0)
        root = self.freeze(self.path[0])
        first, labels, targets, skips, final = [0], [], [], [], []
        for is_final, arcs in self.states:
            before = int(is_final)
            for label, target in arcs:
                labels.append(label)
                targets.append(target)
                skips.append(before)
                before += self.counts[target]
            final.append(is_final)
            first.append(len(labels))
        return np.array([root], "<u4"), np.array(first, "<u4"), np.array(final, "u1"), np.array(labels, "u1"), np.array(targets, "<u4"), np.array(skips, "<u4")


def compile_lexicon(words: dict[str, tuple[int, ...]]) -> bytes:
    """The automaton of the words, with their ids as output, as one file image."""
    builder, outputs, bounds = Builder(), [], [0]
    for word in sorted(words, key=lambda w: w.encode()):
        builder.add(word.encode())
        outputs += words[word]
        bounds.append(len(outputs))
    parts = [*builder.finish(), np.array(bounds, "<u4"), np.array(outputs, "<u4")]
    blobs = [p.tobytes() for p in parts]
    blobs = [b + b"\0" * (-len(b) % 4) for b in blobs]
    return MAGIC + struct.pack(f"<{len(parts)}Q", *(p.nbytes for p in parts)) + b"".join(blobs)


class Lexicon:
    """A compiled automaton read in place, from mapped memory."""

    def __init__(self, image):
        view = memoryview(image)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        sizes, at, parts, starts = struct.unpack_from("<8Q", view, 8), 72, [], []
        for size, kind in zip(sizes, "IIBBIIII", strict=True):
            parts.append(view[at : at + size].cast(kind))
            starts.append(at)
            at += size + -size % 4
        (self.root,), self.first, self.final, _, self.targets, self.skips, self.bounds, self.outputs = parts
        self.find, self.labels_at = image.find, starts[3]

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes):
        """The ids of a word, or None."""
        state, place, first, find, base = self.root, 0, self.first, self.find, self.labels_at
        for k in range(len(word)):
            arc = find(word[k : k + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            place += self.skips[arc]
            state = self.targets[arc]
        return self.outputs[self.bounds[place] : self.bounds[place + 1]] if self.final[state] else None


# ---- the vocabulary


def composed(text: str) -> str:
    w = width(text)
    if w > 1 and UNKNOWN_MARK[w].search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in UNKNOWN_MARK[w].split(text))
    return unicodedata.normalize("NFC", text)


class Vocabulary:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()], default=-1) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        of = lambda letters, digits: re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", SPACES))
        self.words = {w: of(char_class("L", bound), char_class("N", bound)) for w, bound in BOUNDS.items()}
        # In an ASCII text, letters are A to Z and digits 0 to 9.
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.alphabet = byte_alphabet()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact merges of one word: always the pair of the lowest rank, from the left."""
        parts = [self.alphabet[b] for b in word.encode()]
        parts[-1] += END
        if len(parts) > LONG:
            return self.merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(p, NO_MERGE) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NO_MERGE:
            k = ranks.index(best)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), NO_MERGE)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), NO_MERGE)
        return tuple(self.ids[p] for p in parts if p in self.ids)

    def merge_long(self, parts: list[str | None]) -> tuple[int, ...]:
        """The same merges over linked parts, with the pairs in a heap by rank and place."""
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            j = after[k]
            if parts[k] is None or j < 0 or rank((parts[k], parts[j])) != r:
                continue  # one of the two has merged meanwhile
            parts[k] += parts[j]
            parts[j], after[k] = None, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 <= b and (r := rank((parts[a], parts[b]))) is not None:
                    heappush(heap, (r, a))
        return tuple(self.ids[p] for p in parts if p is not None and p in self.ids)

    def whole_words(self) -> dict[str, tuple[int, ...]]:
        """The vocabulary's own words that the split leaves whole, with the ids of their merges."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        found = {}
        for token in self.ids:
            if not token.endswith(END) or len(token) == len(END):
                continue
            try:
                word = bytes(back[c] for c in token[: -len(END)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.words[4].findall(word) == [word]:
                found[word] = self.merge(word)
        return found

    def split(self, piece: str) -> list[str]:
        if piece.isascii():
            return self.ascii_words.findall(piece.lower())
        piece = lower(composed(piece))
        return self.words[width(piece)].findall(piece)


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = self.lexicon.get(word.encode())
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        packed = array("I", ids if ids is not None else self.vocabulary.merge(word)).tobytes()
        if len(word) <= CACHE_LETTERS:
            self.cache[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        v, get, out = self.vocabulary, self.cache.get, []
        for k, piece in enumerate(v.specials.split(text) if v.specials else [text]):
            if k % 2:
                out.append(array("I", [v.special[piece]]).tobytes())
            else:
                out += [get(w) or self.word(w) for w in v.split(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, array("I", ids)))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(vocabulary_path: str, lexicon_name: str) -> Coder:
    """This worker's coder; it lives as long as the worker, over many tasks."""
    key = (vocabulary_path, lexicon_name)
    if key not in _CODERS:
        _CODERS[key] = Coder(Vocabulary.read(vocabulary_path), Lexicon.mapped(SparkFiles.get(lexicon_name)))
    return _CODERS[key]


def ship_lexicon(spark, vocabulary_path: str, more_words: tuple[str, ...] = ()) -> str:
    """Compile the lexicon (a few MB at most, whatever the corpus) and hand it to the session's file server."""
    v = Vocabulary.read(vocabulary_path)
    image = compile_lexicon(v.whole_words() | {w: v.merge(w) for w in more_words if w})
    name = f"lexicon-{hashlib.sha256(image).hexdigest()[:16]}.bin"
    path = os.path.join(tempfile.gettempdir(), name)
    if not os.path.exists(path):
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(image)
        os.replace(f"{path}.{os.getpid()}", path)
    spark.sparkContext.addFile(os.path.realpath(path))
    return name


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", into: str = "ids", more_words: tuple[str, ...] = ()) -> DataFrame:
    """docs with the ids of text as packed little-endian unsigned 32-bit integers in column into. A narrow map."""
    name = ship_lexicon(docs.sparkSession, vocabulary_path, more_words)
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            c = coder(vocabulary_path, name)
            ids = pa.array([c.encode(t) if t else b"" for t in b.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*b.schema.names[:-1], into])

    keep = [c for c in docs.columns if c != into]
    given = docs.select(*keep, F.col(text).alias("__text"))
    return given.mapInArrow(run, and_fields(docs.select(*keep).schema, f"{into} binary"))


def digests(docs: DataFrame, vocabulary_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, number of ids, digest of the ids, digest of the text decoded from the ids, and the ids if wanted."""
    name = ship_lexicon(docs.sparkSession, vocabulary_path)
    text_batches(docs.sparkSession)
    given = docs.select("doc_id", F.col(text).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                c, rows = coder(vocabulary_path, name), []
                for t in b.column("text").to_pylist():
                    ids = c.encode(t) if t else b""
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), ids))
                n, a, d, i = zip(*rows, strict=True)
                cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(i, pa.binary())] * with_ids, names=names)

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
