"""Quality rules, lines first.

Every line with a word is held against punctuation, navigation and boilerplate
rules; lines that fail are removed, and a document is rejected if it fails the
base rules or loses more than ``MAX_LOSS`` of its characters in words.

A word is ``[^\\x20\\x09-\\x0D]+``. Base columns: ``n_words``, ``word_chars``
(code points in words), ``n_symbols`` (characters of ``[#*$%&|<>]``),
``n_dup_lines`` (lines with a word that equal an earlier line),
``n_repeat_words`` (words in windows of five words found twice or more).

Defined results: a null or empty text has no words, so the base rules reject
it; documents are judged one by one, so ties and repeated rows get equal
verdicts; texts of any length are judged whole; an empty table gives an empty
table; other columns pass through ``clean_documents`` and are ignored by ``assess``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.vocab import release

MIN_WORDS = 10
WINDOW_WORDS = 5
MAX_REPEAT_PERCENT = 20
#: Share of a document's characters in words that its failing lines may hold.
MAX_LOSS = 0.4
#: Rules of a line: shares of its words.
MAX_SYMBOLS, MAX_MARK_RUNS, MAX_SEPARATORS, MAX_SAME_WORD = 0.3, 0.3, 0.15, 0.3
MIN_SEPARATORS, SHOUT_WORDS, STUB_WORDS, REPEATED_LINES = 3, 5, 3, 3
#: What the rules look for.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SEPARATORS = {b"|", b">", b"<", b"/", "»".encode(), "›".encode(), "·".encode(), "•".encode(), b"::", b"-", b"*"}
LINE_ENDS = tuple(".!?…:;,\"')]}»”’。！？")
MARK_RUN = re.compile(r"[!?]{2,}|\.{4,}")
BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|licensed under|released under the|public license|licen[sc]e,? version|terms of (?:use|service)"
    r"|privacy policy|cookie (?:policy|notice|settings|preferences|consent)|(?:uses?|using|accept|allow) (?:all )?cookies"
    r"|subscribe|sign (?:in|up)|log ?in|click here|read more|share this|enable javascript"
    r"|powered by|lorem ipsum|skip to (?:main )?content|back to top|newsletter)\b|(?:\bcopyright )?©",
    re.IGNORECASE,
)
#: A boilerplate phrase marks a line of up to so many words; in longer ones it is prose about the matter.
BOILERPLATE_WORDS = 20
#: With one phrase only, so many words may stand beside it; with several, any number.
BESIDE_WORDS = 4


def is_boilerplate(line: str, n: int) -> bool:
    """Whether a line of ``n`` words holds several different phrases, or one and few words besides."""
    found = {m.lower() for m in BOILERPLATE.findall(line)}
    return len(found) > 1 or bool(found) and n - len(next(iter(found)).split()) <= BESIDE_WORDS


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words in windows that stand twice or more in the text. Hashes find candidates, the words decide."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    candidates = np.flatnonzero(np.isin(mixed, ordered[1:][same])).tolist()
    windows = [tuple(words[i : i + window]) for i in candidates]
    found = Counter(windows)
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    for i, w in zip(candidates, windows, strict=True):
        if found[w] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def line_failure(line: str, words: list[bytes], symbols: bool) -> str | None:
    """The rule that a line with words fails, or None. ``symbols``: whether the text has any symbol."""
    n = len(words)
    if symbols and sum(map(line.count, SYMBOLS)) > MAX_SYMBOLS * n:
        separators = sum(w in SEPARATORS for w in words)
        if separators >= MIN_SEPARATORS and separators > MAX_SEPARATORS * n:
            return "navigation"
        return "punctuation"
    if ("!!" in line or "??" in line or "...." in line) and len(MARK_RUN.findall(line)) > MAX_MARK_RUNS * n:
        return "punctuation"
    if n >= SHOUT_WORDS and line.isupper():
        return "punctuation"
    if n < STUB_WORDS and not line.rstrip(SPACES).endswith(LINE_ENDS):
        return "navigation"
    if n >= SHOUT_WORDS:
        if sum(w in SEPARATORS for w in words) > max(MIN_SEPARATORS - 1, MAX_SEPARATORS * n):
            return "navigation"
        if sum(a == b for a, b in zip(words, words[1:], strict=False)) > MAX_SAME_WORD * n:
            return "boilerplate"
    if n <= BOILERPLATE_WORDS and is_boilerplate(line, n):
        return "boilerplate"
    return None


def judge(text: str | None) -> dict:
    """All columns of one text, with ``clean_text``: its lines but those that fail."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at exactly the six spaces
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    times = Counter(lines)
    seen: set[str] = set()
    duplicates, lost, kept, failures = 0, 0, [], Counter()
    for line in lines:
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            if line in seen:
                duplicates += 1
            failure = line_failure(line, own, symbols > 0)
            if failure is None and line in seen and times[line] >= REPEATED_LINES:
                failure = "boilerplate"
            seen.add(line)
            if failure is not None:
                failures[failure] += 1
                lost += len(line) - sum(map(line.count, SPACES))
                continue
        kept.append(line)
    repeats = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= MAX_LOSS * word_chars,
        "lost_chars": lost,
        "punctuation_lines": failures["punctuation"],
        "navigation_lines": failures["navigation"],
        "boilerplate_lines": failures["boilerplate"],
        "clean_text": "\n".join(kept),
    }


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, lost_chars long, punctuation_lines long, navigation_lines long, boilerplate_lines long"
)


def assess(documents: DataFrame, with_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, the base columns, the verdict and what the rules found, a row for each document; no shuffle.

    ``with_text`` adds ``clean_text``.
    """
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + (["clean_text"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [judge(t) for t in part.column(1).to_pylist()]
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
                columns = [pa.array([f[c] for f in found], kinds.get(c, pa.int64())) for c in names]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    id_type = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, {_COLUMNS}" + (", clean_text string" if with_text else "")
    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents that stay, without the lines that failed; all columns as they were but ``text`` and ``n_chars``."""
    names = documents.columns
    at = names.index("text")
    length_at = names.index("n_chars") if "n_chars" in names else None
    length_type = documents.schema["n_chars"].dataType.simpleString() if length_at is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [judge(t) for t in part.column(at).to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) if f["kept"]], pa.int64())
                columns = [c.take(rows) for c in part.columns]
                columns[at] = pa.array([f["clean_text"] for f in found if f["kept"]], columns[at].type)
                if length_at is not None:
                    sizes = pa.array([len(f["clean_text"]) for f in found if f["kept"]], pa.int64())
                    columns[length_at] = sizes.cast(columns[length_at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    if length_type and length_type not in ("bigint", "int"):
        raise TypeError("n_chars must be a whole number")
    return documents.mapInArrow(run, documents.schema)
