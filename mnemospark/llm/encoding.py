"""Garbled text from a wrong character encoding, found and restored.

Text that was written in one encoding and read in another can be restored by encoding it as it was read and decoding it
as it was written, if no character was lost on the way. Which steps those are, and how many, is found by a best-first
search: states are texts (visited ones are kept in a hash set), operations are *encode as A, decode as B* and *unescape
entities*, and the cheapest text is expanded first. Cost is implausibility: the negative log probability of the text's
pairs of adjacent characters, learned from the corpus at hand, plus a price for each operation.

Only words with characters beyond ASCII matter to the search, and words recur: each distinct word of the corpus is
searched once. A document is then repaired sentence by sentence, since often only part of it was damaged, with the path of
operations that suits all words of its damaged sentences; sentences that it doesn't fit are searched on their own.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint

LOST = "�"

# The code pages that text is commonly mistaken for.
SINGLE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "koi8-r", "iso8859-2", "cp866")
# The encodings in which text was commonly written.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850", "cp866")
# Quotation marks that may enclose an example.
OPENING, CLOSING = "“„\"'`«‘‹‚", "”“\"'`»’›‘"

#: Distinct pairs of characters that may reach the driver.
MAX_PAIRS = 2_000_000


@lru_cache(maxsize=8)
def _quoted(most: int) -> re.Pattern:
    """A quoted piece of at most this many odd characters, without letters of its own around it: an example and no damage."""
    return re.compile(rf"(?<![^\s(\[])([{OPENING}])\s?([^\s{OPENING}{CLOSING}A-Za-z]{{1,{most}}}[a-zà-ÿ]{{0,12}})\s?([{CLOSING}])(?![^\s.,;:!?)\]])")


_WORD = re.compile(r"\S+", re.ASCII)
_SENTENCE = re.compile(r"(?<=[.!?;:])[ \t]+|\n+")
_ENTITY = re.compile(r"&(#\d{2,6}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,8});")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"[^\x00-\x7f]+")


def odd_words(text: str) -> list[str]:
    """The words of a text that have a character beyond ASCII or an entity; only ASCII white space parts words."""
    if text.isascii() and "&" not in text:
        return []
    return [w for w in _WORD.findall(text) if not w.isascii() or _ENTITY.search(w)]


def _alike(word: str) -> str:
    """Digits are alike to the model and to every operation."""
    return _DIGITS.sub("0", word)


def units(text: str, example: int = 8) -> Iterator[str]:
    """What is searched of a text: its odd words, and the pieces that it quotes."""
    words = odd_words(text)
    yield from map(_alike, words)
    if words:
        for m in _quoted(example).finditer(text):
            if not m.group(2).isascii() or _ENTITY.search(m.group(2)):
                yield _alike(m.group(2))


@dataclass(frozen=True)
class RepairParams:
    """step_cost: price of an operation. least_gain: how much cheaper (in nats) the restored words of a sentence must be.

    A path of n operations costs n times the price at least, and a restored text has to be cheaper than the garbled one; so
    the costs themselves bound the depth of a search, and nothing else does. worst_step: how much worse than the cheapest text
    so far a text may be and still be expanded; infinity searches all that the price allows, at its cost in time. example: odd characters
    of a quoted piece that may be an example. shared_words: how many searched words may be broadcast; more are joined.
    """

    step_cost: float = 2.0
    least_gain: float = 3.0
    worst_step: float = 3.0
    example: int = 8
    shared_words: int = 20_000


def _encode(text: str, page: str) -> bytes | None:
    """Bytes of ``text`` in a code page; where a page leaves a byte undefined, the control character stands for it."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        if page not in ("cp1252", "cp1251", "cp1250"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def _decode(raw: bytes, page: str) -> str | None:
    try:
        return raw.decode(page)
    except UnicodeDecodeError:
        return None


def _operation(read: str, written: str) -> Callable[[str], str | None]:
    def apply(text: str) -> str | None:
        raw = _encode(text, read)
        return None if raw is None else _decode(raw, written)

    return apply


def _unescape(text: str) -> str | None:
    return html.unescape(text) if _ENTITY.search(text) else None


OPERATIONS: dict[str, Callable[[str], str | None]] = {f"{a}>{b}": _operation(a, b) for a in SINGLE_BYTE for b in WRITTEN if a != b and {a, b} != {"cp1252", "latin-1"}}
OPERATIONS["unescape"] = _unescape


def neighbours(text: str) -> Iterator[tuple[str, str]]:
    """(operation, text) of every operation that changes ``text``; of pages that give the same bytes the first counts."""
    seen: set[bytes] = set()
    for read in SINGLE_BYTE:
        raw = _encode(text, read)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for written in WRITTEN:
            name = f"{read}>{written}"
            if name in OPERATIONS and (new := _decode(raw, written)) is not None and new != text:
                yield name, new
    if (new := _unescape(text)) is not None and new != text:
        yield "unescape", new


def reads_as_utf8(word: str) -> bool:
    """Whether a word's bytes in the commonest code page are UTF-8 beyond ASCII: what is probably garbled teaches the model nothing.

    Other pages don't count: short proper words of other alphabets read as UTF-8 in them by chance.
    """
    return not word.isascii() and (raw := _encode(word, SINGLE_BYTE[0])) is not None and _decode(raw, "utf-8") is not None


def _cell(c: str) -> str:
    """Characters as the model tells them apart: ideographs and beyond by block, digits alike."""
    if c.isdigit() and c < "\x80":
        return "0"
    return c if c < "⺀" else chr(ord(c) & ~0xFF)


def pairs_of(word: str) -> Iterator[str]:
    """Pairs of adjacent characters, of which at least one is beyond ASCII; a space stands before and after."""
    last = " "
    for c in word + " ":
        c = _cell(c)
        if c > "\x7f" or last > "\x7f":
            yield last + c
        last = c


class _Cells(dict):
    """Each character's cell, worked out once."""

    def __missing__(self, c: str) -> str:
        self[c] = _cell(c)
        return self[c]


class Plausibility:
    """Cost of a word by the corpus' counts of character pairs."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = math.log(sum(counts.values()) + 1.0)
        self.pair = {p: total - math.log(n + 0.05) for p, n in counts.items()}
        self.unseen = total - math.log(0.05)
        self.cells = _Cells()

    def cost(self, word: str) -> float:
        pair, cells, unseen, found, last = self.pair, self.cells, self.unseen, 0.0, " "
        for c in word + " ":
            # Control characters and replacement characters are in no proper text, however common here.
            if "\x7f" <= c <= "\x9f" or c == LOST:
                found += 12.0
            c = cells[c]
            if c > "\x7f" or last > "\x7f":
                found += pair.get(last + c, unseen)
            last = c
        return found


class Repairer:
    """Repairs texts by what is ``known`` of their words: a word that isn't listed has no cheaper form.

    Without a list (None) each word is searched when it first comes up.
    """

    def __init__(self, model: Plausibility, params: RepairParams) -> None:
        self.model, self.params = model, params
        self.known: dict[str, tuple[float, dict[tuple[str, ...], float]]] | None = None
        self.own: dict[str, tuple[float, dict[tuple[str, ...], float]]] = {}

    def search(self, text: str) -> dict[tuple[str, ...], float]:
        """Path of operations -> cost of all texts cheaper than ``text`` that the search meets."""
        cost = self.model.cost
        start, price = cost(text), self.params.step_cost
        good, best = start - self.params.least_gain / 2, start
        heap: list[tuple[float, int, tuple[str, ...], str]] = [(start, 0, (), text)]
        seen, found, tick = {text}, {}, 0
        while heap:
            total, _, path, state = heapq.heappop(heap)
            # Not even a text without any cost could pay for another step; or there is a much cheaper text by now.
            if price * (len(path) + 1) >= good or total >= best + self.params.worst_step:
                continue
            for name, new in neighbours(state):
                if new in seen:
                    continue
                seen.add(new)
                total = cost(new) + price * (len(path) + 1)
                if total < good and any(p != "unescape" for p in (*path, name)):
                    found[(*path, name)] = total
                tick += 1
                best = min(best, total)
                # A step that makes it much worse leads nowhere: undoing damage never adds implausible characters.
                if total < best + self.params.worst_step:
                    heapq.heappush(heap, (total, tick, (*path, name), new))
        return found

    def searched(self, word: str) -> tuple[float, dict[tuple[str, ...], float]]:
        return self.model.cost(word), self.search(word)

    def word(self, word: str) -> tuple[float, dict[tuple[str, ...], float]]:
        word = _alike(word)
        if self.known is not None:
            return self.known.get(word) or (self.model.cost(word), {})
        if word not in self.own:
            self.own[word] = self.searched(word)
        return self.own[word]

    def repair(self, text: str) -> str | None:
        """The restored text, "" if characters were lost for good, None if nothing is damaged."""
        hidden: list[str] = []

        def hide(m: re.Match) -> str:
            if LOST not in m.group(2) and self._gain([m.group(2)]) < self.params.least_gain / 2:
                return m.group(0)
            hidden.append(m.group(0))
            return f"\x00{len(hidden) - 1}\x00"

        if self.known is not None and LOST not in text and not any(u in self.known for u in units(text, self.params.example)):
            return None
        bare = _quoted(self.params.example).sub(hide, text) if _RUN.search(text) else text
        if LOST in bare:
            return ""
        parts, at = [], 0
        for m in _SENTENCE.finditer(bare):
            parts += [bare[at : m.start()], m.group(0)]
            at = m.end()
        parts.append(bare[at:])
        damaged: dict[int, list[str]] = {}
        for i in range(0, len(parts), 2):
            words = odd_words(parts[i])
            if words and self._gain(words) >= self.params.least_gain:
                damaged[i] = words
        if not damaged:
            return None
        path = self._best(sorted({w for words in damaged.values() for w in words}))
        lost = False
        for i, words in damaged.items():
            whole = self._apply(parts[i], path) if path else None
            if whole is None or self._cost(whole) > self._cost(parts[i]) - self.params.least_gain / 2:
                own = self._best(sorted(set(words)))
                whole = self._apply(parts[i], own) if own else None
            if whole is None:
                whole, gone = self._by_runs(parts[i])
                lost |= gone
            if whole is not None:
                parts[i] = whole
        if lost:
            return ""
        fixed = "".join(parts)
        # What was damaged as a whole may hold an example that only now shows; examples stay as they are.
        return re.sub("\x00(\\d+)\x00", lambda m: hidden[int(m.group(1))], fixed)

    def _cost(self, text: str) -> float:
        return sum(self.model.cost(w) for w in odd_words(text))

    def _gain(self, words: list[str]) -> float:
        """How much cheaper the words get, each by its own best path."""
        return sum(max(0.0, cost - min(found.values(), default=cost)) for cost, found in map(self.word, set(words)))

    def _best(self, words: list[str]) -> tuple[str, ...] | None:
        """The path that makes the words cheapest together, each word that it can't be applied to left as it is."""
        price, known = self.params.step_cost, [self.word(w) for w in words]
        base = sum(cost for cost, _ in known)
        paths = {p for _, found in known for p in found}

        def least(path: tuple[str, ...]) -> float:
            """A bound for the words' cost by this path: what isn't cheaper by it may be so by a path to the same text."""
            steps = price * len(path)
            return steps + sum(found[path] - steps if path in found else min([cost - self.params.least_gain / 2 - steps, *(c - price * len(p) for p, c in found.items())]) for cost, found in known)

        best, best_cost = None, base - self.params.least_gain
        for bound, _, path in sorted((least(p), len(p), p) for p in paths):
            if bound >= best_cost - 1e-9:
                break
            total = price * len(path)
            for w, (cost, _) in zip(words, known):
                new = self._apply(w, path)
                total += self.model.cost(new) if new is not None else cost + 4.0
            if total < best_cost - 1e-9:
                best, best_cost = path, total
        return best

    @staticmethod
    def _apply(text: str, path: tuple[str, ...]) -> str | None:
        for name in path:
            new = OPERATIONS[name](text)
            if new is None:
                return None
            text = new
        return text

    def _by_runs(self, text: str) -> tuple[str | None, bool]:
        """Where no path suits a whole sentence: its runs of non-ASCII characters one by one.

        If some runs can be restored and others are no text in either form, bytes of theirs were dropped.
        """
        path = self._best(sorted(set(odd_words(text))))
        if path is None:
            # The reading that restores most runs; none if all fail.
            runs = _RUN.findall(text)
            most, path = max(((sum(self._apply(r, (o,)) is not None for r in runs), (o,)) for o in OPERATIONS if o.endswith(">utf-8")), key=lambda x: x[0])
            if not most:
                return None, False
        done, broken = False, False

        def one(m: re.Match) -> str:
            nonlocal done, broken
            new = self._apply(m.group(0), path)
            if new is not None and new != m.group(0):
                done = True
                return new
            broken |= new is None and (len(m.group(0)) > 1 or m.group(0) in "ÃÂÐÑâ") and not m.group(0).isalpha() or (new is None and m.group(0)[0] in "ÃÂÐÑÄÅ")
            return m.group(0)

        fixed = _RUN.sub(one, text)
        return (fixed, broken) if done or broken else (None, False)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(units(text))
        if len(counts) > 100_000:
            yield out()
    yield out()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            if not reads_as_utf8(w):
                for p in pairs_of(w):
                    counts[p] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])


_PATHS = "array<struct<path:string,cost:double>>"


def _known(rows: list[dict]) -> dict[str, tuple[float, dict[tuple[str, ...], float]]]:
    return {r["word"]: (r["cost"], {tuple(p["path"].split(" ")): p["cost"] for p in r["paths"]}) for r in rows}


def _repair_rows(repairer: Repairer, batch: pa.RecordBatch, known: list[dict] | None = None) -> pa.RecordBatch:
    fixed = []
    for i, text in enumerate(batch.column("text").to_pylist()):
        if known is not None:
            repairer.known = known[i]
        fixed.append(repairer.repair(text))
    keep = [i for i, f in enumerate(fixed) if f is not None]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array([fixed[i] for i in keep], pa.string())], ["id", "restored"])


def repair_encoding(documents: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """(id, restored) of the damaged rows of ``documents`` (id, text); restored is "" where characters were lost for good.

    Null and empty texts, and texts in ASCII without entities, are never damaged. Repeated texts are judged alike, and count
    once in the model, so that one damaged text can't make itself plausible by its number. A
    garbled sequence that a text only quotes as an example is left alone. Texts of any length are read whole. The
    model counts the pairs of all distinct texts; its size is bounded by the alphabets in use, as ideographs count by block.
    Each distinct word of the corpus is searched once; what the searches found comes to the texts as a broadcast table if it is small
    (``shared_words``), by joins otherwise, with the same result.
    """
    spark = documents.sparkSession
    texts = documents.where("text is not null").where(F.col("text").rlike(r"[^\x00-\x7F]|&#?\w{2,8};"))
    distinct = texts.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.first("text").alias("text"))
    words = checkpoint(distinct.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = words.mapInArrow(_count_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).limit(MAX_PAIRS + 1).collect()
    if len(pairs) > MAX_PAIRS:
        raise ValueError("more pairs of characters than the alphabets in use can give")
    counts = spark.sparkContext.broadcast({r.pair: r.n for r in pairs})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(Plausibility(counts.value), params)
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                cost, found = repairer.searched(word)
                if found:
                    rows.append({"word": word, "cost": cost, "paths": [{"path": " ".join(p), "cost": c} for p, c in found.items()]})
            kind = pa.schema([("word", pa.string()), ("cost", pa.float64()), ("paths", pa.list_(pa.struct([("path", pa.string()), ("cost", pa.float64())])))])
            yield pa.RecordBatch.from_pylist(rows, kind)

    # Words cost by the search, not by their bytes, so they are dealt out by number.
    parts = max(spark.sparkContext.defaultParallelism, -(-words.count() // 20_000))
    found = checkpoint(words.select("word").repartition(parts, "word").mapInArrow(search, f"word string, cost double, paths {_PATHS}"))
    kind = f"id {dict(documents.dtypes)['id']}, restored string"
    held = found.limit(params.shared_words + 1).toArrow()
    if held.num_rows <= params.shared_words:
        shared = spark.sparkContext.broadcast(_known(held.to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            repairer = Repairer(Plausibility(counts.value), params)
            repairer.known = shared.value
            for batch in batches:
                yield _repair_rows(repairer, batch)

        return texts.select("id", "text").mapInArrow(run, kind)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, w) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()) for w in set(units(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["key", "word"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(Plausibility(counts.value), params)
        for batch in batches:
            yield _repair_rows(repairer, batch, [_known(r or []) for r in batch.column("known").to_pylist()])

    own = distinct.mapInArrow(listed, "key string, word string").join(found, "word").groupBy("key").agg(F.collect_list(F.struct("word", "cost", "paths")).alias("known"))
    keyed = texts.select("id", "text", F.md5(F.col("text").cast("binary")).alias("key"))
    return keyed.join(own, "key", "left").select("id", "text", "known").mapInArrow(run_joined, kind)


def text_md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest() if text else ""
