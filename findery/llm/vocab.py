"""Tokenizer files on the executors: byte alphabet, word splitting and bounded word caches.

Texts are cut at white space into chunks whose tokens don't depend on their
neighbours, and what a chunk gives is kept in a cache of bounded size, so a
common word is tokenized once for each worker process.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that one generation of a word cache holds; two generations are kept.
CACHE_ENTRIES = 500_000
#: Bytes of texts that are tokenized together, as equal words among them are looked up once.
TEXT_BYTES = 8 << 20
#: Characters of the longest chunk that a cache keeps.
LONGEST = 256
#: White space to Python's ``str.split`` but not to the tokenizers' patterns.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII's common kinds, and white space other than the space and the line feed.
RARE_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_SPACES = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The word tokenizer's normalizer, and its splitting pattern.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Latin letters, then ASCII signs but the apostrophe: two pre-tokens of both kinds of vocabulary.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class WordCache(dict):
    """chunk -> value, at most two generations of ``entries`` each; chunks over ``LONGEST`` characters aren't kept."""

    def __init__(self, make: Callable[[str], object], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make = make
        self.entries = entries
        self.old: dict = {}

    def __missing__(self, chunk: str):
        if len(chunk) > LONGEST:
            return self.make(chunk)
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value


def special_pattern(spec: dict) -> re.Pattern | None:
    """Matches the strings that the tokenizer takes out of a text as special tokens."""
    strings = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, strings))) if strings else None


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def check_word_spec(spec: dict) -> None:
    """Raises unless the file has the normalizer and the pattern that this module reproduces."""
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if steps != WORD_NORMALIZERS or split != WORD_PATTERN:
        raise ValueError("not a word tokenizer of the known form")


def normalized(text: str) -> str:
    """NFC and lower case character by character, as the word tokenizer has them."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # str.lower() turns a final sigma into another letter than lower-casing each character does
    return text.replace("Σ", "σ").lower()


class IdCache(dict):
    """chunk -> ids as bytes, at most two generations of ``entries`` each; chunks over ``LONGEST`` characters aren't kept."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries = entries
        self.old: dict[str, bytes] = {}

    def of(self, chunks: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct chunks."""
        ids = list(map(self.get, chunks))
        lacked = [i for i, own in enumerate(ids) if own is None]
        if not lacked:
            return ids
        held = list(map(self.old.get, map(chunks.__getitem__, lacked)))
        new = [chunks[i] for i, own in zip(lacked, held, strict=True) if own is None]
        made = iter(make(new))
        for i, own in zip(lacked, held, strict=True):
            ids[i] = next(made) if own is None else own
        if len(self) + len(lacked) > self.entries:
            self.old = dict(self)
            self.clear()
        self.update((chunks[i], ids[i]) for i in lacked)
        for chunk in [chunk for chunk in new if len(chunk) > LONGEST]:
            del self[chunk]
        return ids


class LibraryEncoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    Chunks that aren't cached go to the library: plain words to its model, others
    in one string with marks between them that are tokens of their own. A text
    that holds a special string or white space that joins chunks goes as a whole.
    """

    ENTRIES = 300_000
    #: Runs of signs whose ids are kept.
    SIGNS = 10_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.spec = load_spec(path)
        self.special = special_pattern(self.spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = self.spec["normalizer"] is not None
        if self.lower:
            check_word_spec(self.spec)
        self.cache = IdCache(self.ENTRIES)
        self.signs: dict[str, bytes] = {}
        self.line_feed = b"" if self.lower else self.encode_one("\n")
        # white space alone divides the words of the one kind, a line feed is a token of the other
        self.mark = "\x01" if self.lower else "\n"
        self.mark_ids = np.frombuffer(self.encode_one(self.mark), dtype="<u4")
        self.space = byte_alphabet()[ord(" ")]
        self.alphabet = dict(enumerate(byte_alphabet()))

    def encode_one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk of a word vocabulary, or of what follows a space, a line feed or a text's begin."""
        if self.lower:
            return self.encode_plain(chunks, "")
        # a chunk after a line feed or at a text's begin isn't after a space
        fresh = [i for i, chunk in enumerate(chunks) if chunk[:1] < " " and chunk[:1] in ("\n", "\r")]
        begun = [chunks[i] for i in fresh]
        if fresh:
            chunks = chunks.copy()
            for i in fresh:
                chunks[i] = ""
        made = self.encode_plain(chunks, " ")
        for i, chunk, ids in zip(fresh, begun, self.encode_plain([chunk[1:] for chunk in begun], ""), strict=True):
            made[i] = self.line_feed + ids if chunk[0] == "\n" else ids
        return made

    def encode_plain(self, chunks: list[str], lead: str) -> list[bytes]:
        """The ids of each chunk, after a space with ``lead``; none for an empty one.

        Latin letters and the ASCII signs after them are a pre-token each, so the
        library's model gets them as they are; all other chunks go through the
        whole tokenizer.
        """
        tokenize, alphabet, match = self.tokenizer.model.tokenize, self.alphabet, PLAIN.fullmatch
        space = self.space if lead else ""
        known: dict[str, bytes] = {"": b""}
        signs_known = self.signs
        out: list[bytes | None] = []
        for chunk in chunks:
            if chunk.isalpha() and chunk.isascii():
                letters, signs = chunk, ""
            else:
                found = match(chunk)
                if found is None:
                    out.append(b"" if not chunk else None)
                    continue
                letters, signs = found.groups()
            ids = known.get(letters)
            if ids is None:
                part = letters if letters.isascii() else letters.encode().decode("latin-1").translate(alphabet)
                ids = known[letters] = array("I", [t.id for t in tokenize(space + part)]).tobytes()
            if signs:
                own = signs_known.get(signs)
                if own is None:
                    own = array("I", [t.id for t in tokenize(signs)]).tobytes()
                    if len(signs_known) < self.SIGNS:
                        signs_known[signs] = own
                ids += own
            out.append(ids)
        other = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(other, self.encode_marked([lead + chunks[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def encode_marked(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk by one call of the tokenizer; chunk by chunk where the marks don't divide them."""
        if not chunks:
            return []
        between = f" {self.mark} " if self.lower else self.mark
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
        marks = np.flatnonzero(ids == self.mark_ids[0])
        if len(self.mark_ids) != 1 or len(marks) != len(chunks) - 1:
            return [self.encode_one(chunk) for chunk in chunks]
        data = ids.tobytes()
        ends = (4 * marks).tolist()
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(data)], strict=True)]

    def prepared(self, text: str) -> str | None:
        """The text ready to be cut at spaces; None where only the library itself can split it."""
        if "<|" in text and self.special is not None:
            return None
        if self.lower:
            text = normalized(text)
            return None if "<|" in text or RARE_SPACES.search(text) else text
        if (
            not text
            or text[0] in " \n"
            or text[-1] in " \n"
            or "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or ODD_SPACES.search(text)
        ):
            return None
        return text

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        ready = [self.prepared(t) for t in texts]
        made = iter(self._joined([t for t in ready if t is not None]))
        return [self.encode_one(t) if own is None else next(made) for t, own in zip(texts, ready, strict=True)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of prepared texts: those of their distinct chunks, laid out in the order of the texts."""
        if self.lower:
            lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        else:
            # a chunk says whether it begins a line or the text
            marked = ["\r" + t.replace("\n", " \n") for t in texts]
            lists = pc.split_pattern(pa.array(marked, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        ids = self.cache.of(coded.dictionary.to_pylist(), self.encode_chunks)
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.array([len(own) // 4 for own in ids], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        places = np.repeat(starts[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])
        data = pool[places].tobytes()
        bounds = (4 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class HeapBpe:
    """Counts tokens by byte-pair merging with a heap over a linked list of symbols."""

    def __init__(self, path: str):
        spec = load_spec(path)
        check_word_spec(spec)
        self.special = special_pattern(spec)
        self.split = regex.compile(WORD_PATTERN)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        # pair of symbol ids -> rank of the merge; merged[rank] is the id it makes
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.parts = WordCache(self.count_part)
        self.cache = WordCache(self.count_chunk)

    def count_part(self, part: str) -> int:
        """Tokens of one pre-token: its bytes less the merges made, in order of rank, then of place."""
        from heapq import heapify, heappop, heappush

        raw = part.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n == 1:
            return 1
        ranks, merged = self.ranks, self.merged
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        get = ranks.get
        heap = [r << 32 | i for i in range(n - 1) if (r := get(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapify(heap)
        count = n
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            # a symbol that was merged away, or whose neighbour changed, has another rank by now
            if symbol[i] < 0 or j >= n or get(symbol[i] << 20 | symbol[j]) != rank:
                continue
            symbol[i] = merged[rank]
            symbol[j] = -1
            count -= 1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := get(symbol[i] << 20 | symbol[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(symbol[h] << 20 | symbol[i])) is not None:
                heappush(heap, r << 32 | h)
        return count

    def count_chunk(self, chunk: str) -> int:
        return sum(map(self.parts.__getitem__, self.split.findall(chunk)))

    def count_plain(self, text: str) -> int:
        text = normalized(text)
        if SEPARATORS.search(text):
            return sum(map(self.parts.__getitem__, self.split.findall(text)))
        return sum(map(self.cache.__getitem__, text.split()))

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one."""
        if "<|" not in text or self.special is None:
            return self.count_plain(text)
        found = len(self.special.findall(text))
        return found + sum(self.count_plain(piece) for piece in self.special.split(text))


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str):
    """One object of a kind and file for each worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def release() -> None:
    """Frees a worker's caches of words; operators that don't tokenize call it, since workers live on between jobs."""
    _LOADED.clear()
