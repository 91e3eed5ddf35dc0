"""Freely typed values mapped to a reference list by repairing their words.

1. Values and entries are cut into words: compatibility forms unified, accents dropped, camel case and punctuation
   split, lower case.
2. Each distinct word meets the reference vocabulary by edit distance. Two words within d edits (an exchange of
   neighbours is one edit) share a string that is left after deleting at most d letters from each, so an equality join on such
   strings finds every pair within d, without comparing all words. The vocabulary also holds each entry written as one word,
   in either order, and the beginnings of words, for values that were cut off.
3. Repaired words are combined by soft TF-IDF: an entry scores the sum of its words' squared idf times the similarity
   of the word that stands for it, over the norms of entry and value. Entries are looked up by their rarest word
   only, which loses none, since an entry counts only if all its words are found.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.runtime import checkpoint

MAX_EDITS = 2
MIN_SCORE = 0.75
#: Words that join the parts of a value and say nothing.
CONNECTORS = ("and", "of", "the", "for", "a")

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+|[^\W\d_]+")
#: White space of any script, as a regular expression.
WHITE = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"


def words_of(value: str) -> list[str]:
    """The words of a value in order, without connectors; letters without a Latin base are kept as they are."""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    found = _WORD.findall(_CAMEL.sub(" ", text).lower())
    return [w for w in found if w not in CONNECTORS] or found


def edits(word: str) -> int:
    """How many edits a word of this length may differ by."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else MAX_EDITS


def deletions(word: str) -> list[str]:
    """The strings left after deleting up to ``edits(word)`` letters."""
    most = edits(word)
    return list({"".join(c for i, c in enumerate(word) if i not in gone) for n in range(most + 1) for gone in combinations(range(len(word)), n)})


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and exchanges of neighbours."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        before, last = last, now
    return last[-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(values: pd.Series) -> pd.Series:
    return values.map(words_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletions(values: pd.Series) -> pd.Series:
    return values.map(deletions)


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)])


def is_blank(column: Column) -> Column:
    return F.regexp_replace(column, WHITE, "") == ""


def _vocabulary(entries: DataFrame) -> DataFrame:
    """(form, kind, words): single words and whole entries written as one word, forwards and backwards."""
    single = entries.select(F.explode("words").alias("form")).distinct().select("form", F.array("form").alias("words"), F.length("form").alias("least"))
    several = entries.where(F.size("words") > 1)
    compound = [several.select(F.array_join(w, "").alias("form"), "words", (F.length(F.element_at(w, 1)) + 3).alias("least")) for w in (F.col("words"), F.reverse("words"))]
    return single.unionByName(compound[0]).unionByName(compound[1]).groupBy("form").agg(F.min("words").alias("words"), F.min("least").alias("least"))


def map_to_canonical(values: DataFrame, canon: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(value, entry, score) for each distinct non-null value; entry and score are null where nothing matches.

    ``values`` has the column value, ``canon`` the column entry. A value without any letter or digit matches nothing.
    Ties go to the entry that comes first in the alphabet. Very long values cost only their own words: each distinct word is
    repaired once. Null and repeated entries count once; an empty list leaves every value unmatched.
    """
    values = checkpoint(values.where("value is not null").select("value").distinct().withColumn("words", F.array_distinct(_words("value"))))
    entries = checkpoint(canon.where("entry is not null").select("entry").distinct().withColumn("words", F.array_distinct(_words("entry"))).where(F.size("words") > 0))
    n = entries.agg(F.count(F.lit(1)).alias("n"))
    idf = entries.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))

    # Each distinct word and the vocabulary forms that it may stand for.
    words = checkpoint(values.select(F.explode("words").alias("token")).distinct())
    forms = checkpoint(_vocabulary(entries))
    # A word that is longer than the longest form by more letters than may be deleted is near to none of them.
    longest = forms.agg(F.coalesce(F.max(F.length("form")), F.lit(0)).alias("longest"))
    fitting = words.crossJoin(F.broadcast(longest)).where(F.length("token") <= F.col("longest") + MAX_EDITS)  # one row
    # Deletions and distances cost by the row, not by the byte, so words and pairs are dealt out by number.
    parts = max(values.sparkSession.sparkContext.defaultParallelism, -(-words.count() // 10_000))
    near = checkpoint(
        fitting.repartition(parts, "token")
        .select("token", F.explode(_deletions("token")).alias("rest"))
        .join(forms.repartition(parts, "form").select("form", F.explode(_deletions("form")).alias("rest")), "rest")
        .select("token", "form")
        .repartition(parts, "token", "form")
        .distinct()
        .withColumn("d", _distance("token", "form"))
        # Long words that share such a string may be three edits apart, an exchange costing a deletion on either side.
        .where(F.col("d") <= F.when(F.length("form") >= 8, MAX_EDITS + 1).otherwise(MAX_EDITS))
        .select("token", "form", (1 - F.col("d") / F.greatest(F.length("token"), F.length("form"))).alias("sim"))
    )  # read twice below
    start = F.greatest(F.lit(4), F.ceil(F.length("form") / 2), F.when(F.size("words") > 1, F.col("least")).otherwise(F.lit(0))).cast("int")
    beginnings = (
        forms.withColumn("from", start)
        .where(F.col("from") < F.length("form"))
        .select("form", F.explode(F.sequence("from", F.length("form") - 1)).alias("cut"))
        .select("form", F.expr("substring(form, 1, cut)").alias("token"), (1 - 0.5 * (1 - F.col("cut") / F.length("form"))).alias("sim"))
    )
    stands = near.unionByName(words.join(beginnings, "token").select("token", "form", "sim"))
    repaired = stands.join(forms, "form").select("token", F.explode("words").alias("word"), "sim").groupBy("token", "word").agg(F.max("sim").alias("sim")).join(idf, "word")

    # Per value: its repaired words, and the squared norm, where a word that stands for nothing weighs as a rare one.
    rare = idf.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("rare"))
    weight = repaired.groupBy("token").agg(F.max(F.struct("sim", "idf"))["idf"].alias("weight"), F.collect_list(F.struct("word", "sim")).alias("matches"))
    per_token = values.select("value", F.explode("words").alias("token")).join(weight, "token", "left").crossJoin(F.broadcast(rare))
    per_value = per_token.groupBy("value").agg(
        F.sum(F.pow(F.coalesce("weight", "rare"), 2)).alias("norm2"),
        F.flatten(F.collect_list(F.coalesce("matches", F.array().cast("array<struct<word:string,sim:double>>")))).alias("matches"),
    )
    ranked = entries.select("entry", "words", F.explode("words").alias("word")).join(idf, "word")
    entries_idf = ranked.groupBy("entry").agg(
        F.first("words").alias("words"),
        F.max_by("word", F.struct("idf", "word")).alias("key"),
        F.collect_list(F.struct("word", "idf")).alias("weights"),
        F.sum(F.pow("idf", 2)).alias("entry_norm2"),
    )
    keyed = per_value.select("value", "norm2", "matches", F.explode(F.array_distinct(F.transform("matches", lambda m: m["word"]))).alias("key"))
    sim = lambda w: F.array_max(F.transform(F.filter("matches", lambda m: m["word"] == w["word"]), lambda m: m["sim"]))
    scored = (
        keyed.join(entries_idf, "key")
        .withColumn("sims", F.transform("weights", lambda w: F.struct(w["idf"].alias("idf"), sim(w).alias("sim"))))
        .where(~F.exists("sims", lambda s: s["sim"].isNull()))
        .withColumn("dot", F.aggregate("sims", F.lit(0.0), lambda acc, s: acc + s["idf"] * s["idf"] * s["sim"]))
        # A whole entry written as one word has the weight of a single word, so the entry's norm is the least.
        .withColumn("score", F.col("dot") / F.sqrt(F.col("entry_norm2")) / F.sqrt(F.greatest("norm2", "entry_norm2")))
        .where(F.col("score") >= min_score)
    )
    best = scored.groupBy("value").agg(F.min_by(F.struct("entry", "score"), F.struct(-F.col("score"), "entry")).alias("best"))
    return values.select("value").join(best, "value", "left").select("value", F.col("best")["entry"].alias("entry"), F.col("best")["score"].alias("score"))
