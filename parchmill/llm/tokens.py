"""Word-wise use of the tokenizer libraries inside tasks.

A text is cut at ASCII white space into units whose encodings, joined, are the encoding of the text; each distinct
unit is encoded once by the library and remembered in the worker, within a bound. Texts where units might not add up
(other white space, special strings) go to the library whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
import unicodedata

import numpy as np

#: Units remembered in one Python worker at most; the memory is emptied beyond it.
MEMO = 300_000

#: A word with the space before it, or white space up to the last character before a word.
UNIT = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
#: Separators other than ASCII white space, and spaces of no width.
ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")


class Memo:
    """Encodings of distinct units, each made once in a worker; emptied when it holds too many."""

    def __init__(self, encode, value):
        self.known: dict[bytes, object] = {}
        self.encode, self.value = encode, value

    def of(self, units: set[bytes]) -> dict[bytes, object]:
        """A memory that has at least these units."""
        if len(self.known) > MEMO:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            self.known.update(zip(part, map(self.value, self.encode(part))))
        return self.known


@functools.cache
def library(path: str):
    """The tokenizers library on one vocabulary file, in one thread; one for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials(path: str) -> list[bytes]:
    return [t.content.encode() for t in library(path).get_added_tokens_decoder().values()]


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteRanks:
    """Byte-level BPE by a rank file: pieces of public_tokenizers.PATTERN, merged by the tiktoken library.

    Many units go through one call, parted by a zero byte that the pattern keeps to itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.ranks = ranks_of(path)
        self.zero = self.ranks[b"\0"]
        pattern = public_tokenizers.PATTERN
        self.whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.parted = tiktoken.Encoding("parted", pat_str="\0|" + pattern.replace(r"[^\s", "[^\0\\s"), mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, units: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(units)
        plain = []
        for i, u in enumerate(units):
            if b"\0" in u or u.isspace():
                out[i] = np.array(self.whole.encode_ordinary(u.decode()), dtype="<u4")
            else:
                plain.append(i)
        ids = np.array(self.parted.encode_ordinary("\0".join([units[i].decode() for i in plain])), dtype="<u4")
        cuts = np.nonzero(ids == self.zero)[0].tolist()
        for i, a, b in zip(plain, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)]):
            out[i] = ids[a:b]
        return out


@functools.cache
def unproven() -> re.Pattern:
    """Characters that Unicode 3.2 does not assign: the libraries know different versions of later ones."""
    known = np.array([unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs") for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(known, prepend=False, append=False)).reshape(-1, 2).tolist()
    return re.compile("[^%s]" % "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges))


def lowered(text: str) -> str:
    """Composed and in lower case as by the tokenizers library, which maps each character alone: no final sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))


class WordRanks:
    """A vocabulary whose words end in a suffix, merged by the tiktoken library.

    Words are lower-cased and cut by the file's own pattern; a line feed after each piece, which no word holds,
    stands for the suffix, so that ids in order of merging serve as ranks. Words with ``unproven`` characters go to
    the tokenizers library.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        self.cut = regex.compile("\n|" + spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])  # a line feed parts words
        byte_of = unicode_bytes()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            ended = token.endswith(suffix)
            body = bytes(byte_of[c] for c in (token[: -len(suffix)] if ended else token))
            ranks[body + b"\n" * ended] = i
        ranks[b"\n"] = max(ranks.values()) + 1
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(b"\n")]] = True
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.library = path

    def _strange(self, words: list[bytes]) -> list[int]:
        """Places of the words that go to the library; all are looked at together first."""
        special, joined = specials(self.library), b"\n".join(words)
        odd, marked, late = ODD.search(joined), [s for s in special if s in joined], not joined.isascii() and unproven().search(joined.decode())
        if not (odd or marked or late):
            return []
        return [i for i, w in enumerate(words) if odd and ODD.search(w) or any(s in w for s in marked) or late and not w.isascii() and unproven().search(w.decode())]

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        strange = set(self._strange(words))
        plain = [i for i in range(len(words)) if i not in strange] if strange else list(range(len(words)))
        out: list = [None] * len(words)
        if plain:
            parts = self.cut.findall(lowered(b"\n".join([words[i] for i in plain]).decode()))
            ids = np.array(self.encoding.encode_ordinary("\n".join([*parts, ""])), dtype="<u4")  # what stands between two pieces beside one line feed is no piece
            size = np.diff([-1, *(j for j, p in enumerate(parts) if p == "\n"), len(parts)]) - 1
            at = np.concatenate([[0], np.nonzero(self.ends[ids])[0] + 1])
            stops = at[np.cumsum(size)].tolist()
            for i, n, a, b in zip(plain, size.tolist(), [0, *stops], stops):
                if n:
                    out[i] = ids[a:b]
        for i, own in enumerate(out):
            if own is None:
                out[i] = np.array(library(self.library).encode(words[i].decode(), add_special_tokens=False).ids, dtype="<u4")
        return out


def unicode_bytes() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: Latin-1's visible characters for themselves, the others from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def version_digest(*paths: str) -> str:
    """Digest of the files that encode and of the libraries' versions."""
    from importlib.metadata import version

    out = hashlib.sha256(f"tokenizers {version('tokenizers')}|tiktoken {version('tiktoken')}|no special tokens added".encode())
    for path in paths:
        with open(path, "rb") as f:
            out.update(hashlib.sha256(f.read()).digest())
    return out.hexdigest()


def groups(texts: list[bytes], most: int = 4 << 20):
    """Consecutive texts of a few MB, so that the distinct units of one group stay bounded."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.cache
def byte_ranks(path: str) -> ByteRanks:
    return ByteRanks(path)


@functools.cache
def _memo(kind: str, path: str) -> Memo:
    if kind == "ids":
        return Memo(byte_ranks(path).encode, np.ndarray.tobytes)
    if kind == "counts":
        return Memo(byte_ranks(path).encode, len)
    return Memo(WordRanks(path).encode, np.ndarray.tobytes)


def counts(texts: list[bytes], path: str, ranks: str) -> list[int]:
    """Tokens of each text under a byte-level BPE file of the tokenizers library, whose vocabulary as ranks is in another."""
    out: list[int] = []
    special = specials(path)
    for group in groups(texts):
        cut = [None if ODD.search(t) or any(s in t for s in special) else UNIT.findall(t) for t in group]
        known = _memo("counts", ranks).of({u for c in cut if c for u in c})
        for t, c in zip(group, cut):
            out.append(len(library(path).encode(t.decode(), add_special_tokens=False).ids) if c is None else sum(map(known.__getitem__, c)))
    return out


def byte_ids(texts: list[bytes], ranks: str) -> list[bytes]:
    """Ids of each text under a rank file, as little-endian 32-bit integers."""
    out: list[bytes] = []
    for group in groups(texts):
        cut = [None if ODD.search(t) else UNIT.findall(t) for t in group]
        known = _memo("ids", ranks).of({u for c in cut if c for u in c})
        for t, c in zip(group, cut):
            out.append(np.array(byte_ranks(ranks).whole.encode_ordinary(t.decode()), dtype="<u4").tobytes() if c is None else b"".join(map(known.__getitem__, c)))
    return out


def word_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, under a file that drops white space and so treats each word alone."""
    out: list[bytes] = []
    for group in groups(texts):
        cut = [t.split() for t in group]
        known = _memo("words", path).of({u for c in cut for u in c})
        out += [b"".join(map(known.__getitem__, c)) for c in cut]
    return out
