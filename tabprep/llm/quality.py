"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean Column that says "reject". Its cost is the time that a bounded sample of rows takes to evaluate it,
its selectivity the share of the sample it rejects. Rules run in order of rejections per cost, and a CASE expression stops
at the first that rejects. The order changes the time only: a row is kept if no rule rejects it, whatever comes first.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import plain
from tabprep.sources.storage import stored

#: Rows, at most, on which costs and selectivities are estimated. They set the order of the rules, never a verdict.
SAMPLE_ROWS = 2_000

_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A name and the condition under which a row is rejected; a null condition does not reject."""
    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words inside a window of three words that stands at least twice in the list.

    Windows are sorted as numbers that hold the leading bits of their hash and, in the last bits, their place. Equal
    windows are then neighbours; neighbours are compared word by word. The places found, in order, cover three words
    each, or as many as there are up to the next place.
    """
    def same(w: Column, i: Column, j: Column) -> Column:
        at = lambda k, d: F.get(w, k + d)
        return (at(i, 0) == at(j, 0)) & (at(i, 1) == at(j, 1)) & (at(i, 2) == at(j, 2))

    def covered(w: Column) -> Column:
        bits = F.ceil(F.log2(F.size(w).cast("double"))).cast("int")
        low = lambda b: F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1

        def places(b: Column) -> Column:
            return let(low(b), lambda mask: let(F.sort_array(F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask))
                .bitwiseOR(i.cast("long")))), lambda s: pairs(s, mask)))

        def pairs(s: Column, mask: Column) -> Column:
            place = lambda x: x.bitwiseAND(mask).cast("int")
            close = F.filter(s, lambda x, k: F.coalesce(
                x.bitwiseXOR(F.get(s, k + 1)) <= mask, F.lit(False)) & (x.bitwiseXOR(F.get(s, k + 1)) >= 0)
                | F.coalesce(x.bitwiseXOR(F.get(s, k - 1)) <= mask, F.lit(False)) & (x.bitwiseXOR(F.get(s, k - 1)) >= 0))
            return let(close, lambda c: F.array_sort(F.transform(F.filter(c, lambda x, k: F.coalesce(
                same(w, place(x), place(F.get(c, k + 1))), F.lit(False)) | F.coalesce(
                same(w, place(x), place(F.get(c, k - 1))), F.lit(False))), place)))

        spread = let(places(bits), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(w) >= 4, spread).otherwise(0).cast("long")

    return let(words, covered)


def measured(text: Column) -> dict[str, Column]:
    """Counts of a text; a null text has none of anything."""
    words = words_of(F.coalesce(text, F.lit("")))
    text = F.coalesce(text, F.lit(""))
    return {"n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": symbols_in(text), "n_dup_lines": repeated_lines(text), "n_repeat_words": repeated_words(words)}


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Cost and selectivity of each rule over the rows of the sample, read from the shared folder, the scan's own cost off."""
    def timed(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias("share")).first().share
        return time.perf_counter() - start, share or 0.0

    timed(F.lit(False))
    empty, _ = timed(F.length(plain(sample.columns[0]).cast("string")) < 0)
    return [Estimate(r.name, max(seconds - empty, 1e-6), share) for r in rules for seconds, share in [timed(r.rejects)]]


def cascade_order(df: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, the best first; ties by name."""
    worth = {e.name: e.worth for e in estimate(stored(df.limit(rows), "sample"), rules)}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, rule.name).otherwise(verdict)
    return verdict


def text_rules(text: str = "text") -> list[Rule]:
    """Rules on the raw text: a large share of symbols, of repeated lines, or of very long or very short words."""
    t = F.coalesce(plain(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.length(F.regexp_replace(t, _SPACES, ""))
    return [Rule("symbols", 100 * symbols_in(t) > 5 * letters),
            Rule("repeated_lines", 100 * repeated_lines(t) > 50 * F.size(lines)),
            Rule("word_length", (letters > 25 * F.size(words_of(t))) | (2 * letters < 3 * F.size(words_of(t)))),
            Rule("few_letters", 100 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < 25 * letters)]


def base_rules(text: str = "text") -> list[Rule]:
    """Fewer than 50 words, or more than half of the words inside repeated three-word windows."""
    words = words_of(F.coalesce(plain(text), F.lit("")))
    return [Rule("few_words", F.size(words) < 50),
            Rule("repeated_words", 100 * repeated_words(words) > 50 * F.size(words))]


def screen(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", column: str = "rejected_by") -> DataFrame:
    """All rows and columns of ``df`` and the name of a rule that rejects the row, null where it is kept.

    Which of several rejecting rules is named follows the estimated order. Null and empty texts have no words. Repeated
    rows are judged alike; an empty table stays empty.
    """
    rules = base_rules(text) + text_rules(text) if rules is None else rules
    return df.withColumn(column, first_rejection(cascade_order(df, rules)))


def keep_good(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they had."""
    return df.where(first_rejection(cascade_order(df, base_rules(text) + text_rules(text) if rules is None else rules)).isNull())


def quality_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, and kept: neither the base rules nor the cascade reject the document."""
    own = docs.select(plain(key).cast("long").alias("doc_id"), plain(text).cast("string").alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = first_rejection(cascade_order(own, text_rules("text"))).isNull()
    return (own.select("doc_id", "text", *(c.alias(n) for n, c in measured(F.col("text")).items()))
            .withColumn("base_failed", failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.when(F.col("base_failed"), False).otherwise(passed).alias("kept")))


#: The same counts and verdict in DuckDB's SQL.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             len(regexp_replace(text, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p ON w.doc_id IS NOT DISTINCT FROM p.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words OR 100 * n_letters < 25 * word_chars) AS kept
FROM f"""
