"""Personal data in free text, found by weak supervision and replaced by typed placeholders.

1. Candidate spans are cut from each distinct text, widely, per type of item (``pii_spans``).
2. Labelers vote on each candidate: patterns of known formats, check digits, a short list of given names, titles, words before
   and after, and shapes that speak against it. A vote is for, against, or none. Two labelers of names vote by the whole
   corpus: a gazetteer that grows from it (given names go with many family names, a fixed phrase is always the same
   pair) and the words that it writes in lower case.
3. Expectation-maximisation over the votes of all candidates estimates how reliable each labeler is, without
   any labelled data. Votes are grouped by pattern first, so that only the number of distinct patterns reaches the driver.
4. A span classifier (logistic regression over the form of a span, the words beside it and the votes) is trained on the
   estimated labels of a bounded sample and decides on every candidate, also on those that no labeler voted for; of overlapping spans the more
   certain one, then the longer one, stays.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.pii_model import estimate, rows_of, score, train
from mnemospark.llm.pii_spans import CELLS, CORPUS_LABELERS, LABELERS, TYPES, candidates, decode, encode, features, votes
from mnemospark.runtime import checkpoint

PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
#: Distinct vote patterns that may reach the driver; with the labelers at hand a few hundred occur.
MAX_PATTERNS = 200_000
#: Candidates of a type that the classifier is trained on; all are used where there are fewer.
SAMPLE = 10_000

#: Weight of the prior belief that labelers are right, as a share of their votes.
TRUST = 0.2

_LOWER = "lower"  # rows that count words written in lower case, beside the candidates
_WORD = regex.compile(r"(?<![\p{L}\p{N}_@.'’-])\p{Ll}\p{L}+(?:['’\-]\p{L}+)*")


def _labelers(kind: str) -> int:
    return len(LABELERS[kind]) + (len(CORPUS_LABELERS) if kind == "name" else 0)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "kind", "start", "stop", "item", "pattern", "cells", "first", "last"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string())
    lower: Counter = Counter()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names)

    def counted() -> pa.RecordBatch:
        rows = [(None, _LOWER, None, None, w, n, None, None, None) for w, n in lower.items()]
        lower.clear()
        return out(rows)

    for batch in batches:
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if not text.islower():
                lower.update(_WORD.findall(text))
            rows += [(key, c.kind, c.start, c.end, text[c.start : c.end], encode(votes(c, text)), features(c, text), c.first, c.last) for c in candidates(text)]
        yield out(rows)
        if len(lower) > 200_000:
            yield counted()
    yield counted()


def _beliefs(counted: DataFrame) -> dict[str, dict[int, float]]:
    """Type -> vote pattern -> probability that such a candidate is an item, of ``counted`` (kind, pattern, n)."""
    rows = counted.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError("more vote patterns than labelers of this number can give")
    grouped: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        grouped.setdefault(r.kind, []).append((r.pattern, r.n))
    found = {}
    for kind, pairs in grouped.items():
        pairs.sort()
        grid = np.array([decode(p, _labelers(kind)) for p, _ in pairs])
        found[kind] = dict(zip([p for p, _ in pairs], estimate(grid, np.array([n for _, n in pairs], float), trust=TRUST)[0].tolist()))
    return found


def _pair_votes(names: DataFrame, lower: DataFrame, beliefs: dict[int, float]) -> DataFrame:
    """(first, last, company, lower): the corpus labelers' votes on each pair of given and family name.

    A given name is known by its other bearers: at least two, mostly believed to be names. A pair whose parts meet
    nobody else, however often it is written, is a fixed phrase. Every text and every pair counts.
    """
    table = names.sparkSession.createDataFrame(list(beliefs.items()), "pattern long, p double")
    pairs = names.join(F.broadcast(table), "pattern").groupBy("first", "last").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
    pairs = checkpoint(pairs)
    first = pairs.groupBy("first").agg(F.count(F.lit(1)).alias("families"), F.sum("p").alias("sum"), F.sum("n").alias("n_first"))
    last = pairs.groupBy("last").agg(F.count(F.lit(1)).alias("givens"), F.sum("n").alias("n_last"))
    low = lower.groupBy(F.col("item").alias("word")).agg(F.sum("pattern").alias("low"))
    known = pairs.join(first, "first").join(last, "last")
    known = known.join(low.select(F.col("word").alias("first"), F.col("low").alias("low_first")), "first", "left")
    known = known.join(low.select(F.col("word").alias("last"), F.col("low").alias("low_last")), "last", "left")
    others = F.when(F.col("families") > 1, (F.col("sum") - F.col("p")) / (F.col("families") - 1))
    company = (
        F.when((F.col("families") > 2) & (others >= 0.6), 1)
        .when((F.col("families") > 2) & (others < 0.25), -1)
        .when((F.col("families") == 1) & (F.col("givens") == 1) & (F.col("n") >= 5), -1)
        .otherwise(0)
    )
    common = lambda low, n: (F.coalesce(F.col(low), F.lit(0)) >= 3) & (F.coalesce(F.col(low), F.lit(0)) > 2 * F.col(n))
    return known.select("first", "last", company.alias("company"), F.when(common("low_first", "n_first") | common("low_last", "n_last"), -1).otherwise(0).alias("lower"))


def _learn(sample: pa.Table, beliefs: dict[str, dict[int, float]]) -> dict[str, np.ndarray]:
    """Type -> weights of its classifier, trained on the beliefs in the sample's vote patterns."""
    rows: dict[str, list[tuple]] = {}
    for r in zip(*(sample.column(c).to_pylist() for c in ("kind", "pattern", "cells", "key", "start"))):
        rows.setdefault(r[0], []).append(r)
    weights = {}
    for kind, found in rows.items():
        found.sort(key=lambda r: (r[3], r[4], r[1]))
        n = _labelers(kind)
        x = rows_of([r[2] for r in found], np.array([decode(r[1], n) for r in found]))
        weights[kind] = train(x, np.array([beliefs[kind][r[1]] for r in found]), CELLS + 3 * n + 2)
    return weights


def find_items(texts: DataFrame) -> DataFrame:
    """(key, kind, start, stop, item) of the personal items in ``texts`` (key, text), with character positions.

    Null and empty texts hold no items. Repeated texts, however often, are read once if ``key`` stands for the
    text. Texts of any length are read whole. Items never overlap: of overlapping candidates the one with the higher
    probability stays, then the longer, then the first by type; a name never wins over another type. Only the classifier is fitted to a sample (``SAMPLE``
    candidates a type, chosen by hash); reliabilities, gazetteer and word counts come from all texts.
    """
    spark = texts.sparkSession
    schema = "key string, kind string, start int, stop int, item string, pattern long, cells array<int>, first string, last string"
    everything = checkpoint(texts.where("text is not null and text <> ''").select("key", "text").mapInArrow(_label, schema))
    found, lower = everything.where(F.col("kind") != _LOWER), everything.where(F.col("kind") == _LOWER)
    counted = lambda df: df.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"))
    base = 3 ** len(LABELERS["name"])
    # Until the corpus has voted, its labelers abstain.
    names = found.where("kind = 'name'").withColumn("pattern", F.col("pattern") + F.lit(base * 4).cast("long"))
    first_round = _beliefs(counted(names)).get("name", {})
    if first_round:
        said = _pair_votes(names, lower, first_round)
        by_pair = F.expr(f"pattern + company * {base} + lower * {base * 3}").cast("long")
        names = names.join(said, ["first", "last"]).withColumn("pattern", by_pair).select(*found.columns)
    spans = checkpoint(found.where("kind <> 'name'").unionByName(names).drop("first", "last"))
    totals = {r.kind: r.n for r in spans.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a type
    beliefs = _beliefs(counted(spans))
    parts = 1 << 40
    share = F.coalesce(*[F.when(F.col("kind") == k, F.lit(min(parts, SAMPLE * parts // n))) for k, n in totals.items()], F.lit(0))
    sample = spans.where(F.pmod(F.xxhash64("kind", "key", "start", "stop"), F.lit(parts)) < share)
    weights = spark.sparkContext.broadcast(_learn(sample.select("kind", "pattern", "cells", "key", "start").toArrow(), beliefs))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, p = np.array(batch.column("kind").to_pylist(), dtype=object), np.zeros(batch.num_rows)
            patterns, cells = batch.column("pattern").to_pylist(), batch.column("cells").to_pylist()
            for kind, w in weights.value.items():
                at = np.nonzero(kinds == kind)[0]
                if len(at):
                    p[at] = score(w, rows_of([cells[i] for i in at], np.array([decode(patterns[i], _labelers(kind)) for i in at])))
            keep = pa.array(np.nonzero(p >= 0.5)[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("key", "kind", "start", "stop", "item")), pa.array(p[p >= 0.5])], ["key", "kind", "start", "stop", "item", "p"])

    plain = "key string, kind string, start int, stop int, item string"
    sure = spans.mapInArrow(decide, plain + ", p double")
    # A text's candidates come together and in turn, so that each task holds those of one text at a time.
    return sure.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, plain)


def _clear(rows: list[dict]) -> list[dict]:
    """Of one text's candidates those that stay, none overlapping: what has a form of its own before names (streets hold names), the more certain, then the longer, then the first by type."""
    taken: list[dict] = []
    starts: list[int] = []
    stops: list[int] = []
    for r in sorted(rows, key=lambda r: (r["kind"] == "name", -round(r["p"], 3), r["start"] - r["stop"], TYPES.index(r["kind"]), r["start"])):
        at = bisect.bisect_left(starts, r["start"])
        if (at == 0 or stops[at - 1] <= r["start"]) and (at == len(starts) or starts[at] >= r["stop"]):
            starts.insert(at, r["start"])
            stops.insert(at, r["stop"])
            taken.append(r)
    return taken


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("key", "kind", "start", "stop", "item")
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], list(names))

    held: list[dict] = []
    for batch in batches:
        done: list[dict] = []
        for r in batch.to_pylist():
            if held and held[0]["key"] != r["key"]:
                done += _clear(held)
                held = []
            held.append(r)
        yield out(done)
    yield out(_clear(held))


def text_key(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


def items_of_rows(rows: DataFrame) -> DataFrame:
    """Items of ``rows`` (source_field, record_key, text): one row for each distinct item of a record."""
    keyed = rows.where("text is not null and text <> ''").withColumn("key", text_key("text"))
    items = find_items(keyed.select("key", "text").dropDuplicates(["key"]))
    wanted = items.select("key", F.col("kind").alias("pii_type"), F.col("item").alias("pii_text")).distinct()
    return keyed.select("source_field", "record_key", "key").join(wanted, "key").select("source_field", "record_key", "pii_type", "pii_text").distinct()


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            for s in sorted(spans, key=lambda s: -s["start"]):
                text = text[: s["start"]] + PLACEHOLDER[s["kind"]] + text[s["stop"] :]
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("source_field"), batch.column("record_key"), pa.array(out, pa.string())], ["source_field", "record_key", "redacted"])


def redact(rows: DataFrame) -> DataFrame:
    """(source_field, record_key, redacted) of the records that hold items: each is replaced by its placeholder."""
    keyed = rows.where("text is not null and text <> ''").withColumn("key", text_key("text"))
    items = find_items(keyed.select("key", "text").dropDuplicates(["key"]))
    spans = items.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("spans"))
    distinct = keyed.dropDuplicates(["source_field", "record_key", "key"])
    return distinct.join(spans, "key").select("source_field", "record_key", "text", "spans").mapInArrow(_mask, "source_field string, record_key string, redacted string")
