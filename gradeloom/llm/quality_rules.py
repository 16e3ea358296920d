"""Quality rules: a threshold table compiled into one projection of native expressions.

A rule bounds a measure of the text from below or above. Measures are whole numbers
counted from the words and lines of a text, and a rule compares products of them, so
no rounding decides. ``compile_rules`` turns the table into one boolean expression,
``measures`` gives the expressions it reads; both run in a single projection with no
user function and no shuffle, so a hot source or a group of copies costs nothing more.

A null or empty text has no words, hence zero everywhere and the base rules fail it.
Repeated rows are judged one by one. Very long texts cost n log n: repeated windows
are found by sorting their hashes, never by comparing all with all.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.registry import query, table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
# Characters that count as symbols, and stop words of the corpus's languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by from this or an "
    "der die und das von zu mit im ist den für auf ein eine nicht auch "
    "de la le et les des en un une que pour dans est du au sur "
    "el los las se por con para una su como del no"
).split()


@dataclass(frozen=True)
class Rule:
    """``scale * measure`` must not pass ``bound * of`` (or fall below it, if ``least``)."""

    name: str
    measure: str
    bound: int
    of: str | None = None
    scale: int = 1
    least: bool = False

    def failed(self, value: dict[str, Column]) -> Column:
        own = value[self.measure] * F.lit(self.scale).cast("long")
        other = F.lit(self.bound).cast("long")
        if self.of is not None:
            other = value[self.of] * other
        return own < other if self.least else own > other


#: Rules that every corpus needs.
BASE_RULES = (
    Rule("few_words", "n_words", 10, least=True),
    Rule("repeated_words", "n_repeat_words", 20, of="n_words", scale=100),
)
#: The method's own thresholds: length, symbol, stop-word and line ratios.
TABLE = (
    Rule("many_words", "n_words", 1_000_000),
    Rule("short_words", "word_chars", 2, of="n_words", least=True),
    Rule("long_words", "word_chars", 15, of="n_words"),
    Rule("symbols", "n_symbols", 10, of="n_words", scale=100),
    Rule("equal_lines", "n_dup_lines", 30, of="n_lines", scale=100),
    Rule("stop_words", "n_stop_words", 2, of="n_words", scale=100, least=True),
)


def _let(value: Column, use) -> Column:
    """Use a value several times and compute it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _neighbours_equal(ordered: Column, item: Column, i: Column) -> Column:
    """The key of ``item`` equals the one before or behind it."""
    return F.coalesce(F.get(ordered, i - 1)["h"] == item["h"], F.lit(False)) | F.coalesce(
        F.get(ordered, i + 1)["h"] == item["h"], F.lit(False)
    )


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more."""

    def covered(places: Column) -> Column:
        # Each place covers up to the next one, five words at most.
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
            ),
            lambda acc: acc["n"],
        )

    def repeats(ordered: Column) -> Column:
        again = F.filter(ordered, lambda item, i: _neighbours_equal(ordered, item, i))
        return F.sort_array(F.transform(again, lambda item: item["p"]))

    def windows(hashes: Column) -> Column:
        keyed = F.transform(
            F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
            lambda h, i: F.struct(
                F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("p")
            ),
        )
        return F.sort_array(keyed)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(_let(hashes, windows), lambda ordered: covered(repeats(ordered)))


def equal_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line: all but the distinct ones."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures as columns; own columns of their names are replaced, text may be null."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    filled = lambda parts: F.filter(parts, lambda w: w != "")
    row = F.struct(*[df[c] for c in df.columns]).alias("_row")
    staged = (
        df.select(row, df[text].alias("_text"))
        .withColumns({"_words": filled(F.split(whole, SPACE, -1)), "_all_lines": F.split(whole, "\n", -1)})
        .withColumn("_lines", F.filter("_all_lines", lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))))
    )
    listed = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    measures = {
        "n_words": F.size("_words").cast("long"),
        # Text without its white space: the code points in words.
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": equal_lines(F.col("_lines")),
        "n_lines": F.size("_lines").cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_stop_words": F.expr(f"size(filter(_words, w -> lower(w) IN ({listed})))").cast("long"),
    }
    own = [F.col("_row")[c].alias(c) for c in df.columns if c not in measures]
    return staged.select(*own, *[value.alias(name) for name, value in measures.items()])


def failed_any(rules: Iterable[Rule]) -> Column:
    """The table as one expression over the measure columns."""
    names = {r.measure for r in rules} | {r.of for r in rules if r.of}
    value = {n: F.col(n) for n in names}
    out = F.lit(False)
    for rule in rules:
        out = out | rule.failed(value)
    return out


def judge(df: DataFrame, text: str = "text", base=BASE_RULES, rules=TABLE) -> DataFrame:
    """Add measures, ``base_failed`` and ``kept``."""
    measured = text_measures(df, text)
    return measured.withColumn("base_failed", failed_any(base)).withColumn(
        "kept", ~F.col("base_failed") & ~failed_any(rules)
    )


def _sql_rule(rule: Rule) -> str:
    other = f"{rule.bound} * {rule.of}" if rule.of else str(rule.bound)
    return f"{rule.scale} * {rule.measure} {'<' if rule.least else '>'} {other}"


_ANY = {name: " OR ".join(map(_sql_rule, rules)) for name, rules in (("base", BASE_RULES), ("own", TABLE))}
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT doc_id, t,
           list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
),
p AS (
    SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS five
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
),
again AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
),
m AS (
    SELECT doc_id, len(words) AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           len(lines) AS n_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
    FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_ANY['base']}) AS base_failed,
       NOT ({_ANY['base']}) AND NOT ({_ANY['own']}) AS kept
FROM m
"""


@query("op7_quality_rules", _SQL)
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
