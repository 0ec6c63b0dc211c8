"""Quality rules: a threshold table compiled into one projection of text ratios.

Every rule is a row (name, numerator, denominator, lowest, highest). The table
is data: it is compiled into one Spark projection of built-in functions, so a
rule costs no user function, no shuffle and no second scan, and a change of
thresholds is a change of the table only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._shared import SPACE_CLASS, WORD, fresh, let, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "by", "on", "this", "be", "from", "are", "at", "it", "or", "an", "a", "as"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "in", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "dans", "est", "pour", "qui", "au", "sur", "par", "il", "ne"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"),
}


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [lowest, highest]; None leaves a side open, a denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str | None
    lowest: float | None
    highest: float | None


#: Lenient bounds: they name texts that no reader would call prose, and leave ordinary prose alone.
RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5),
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.4),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def repeated_windows(w: Column, width: int = 3, few: int = 48) -> Column:
    """How many words lie in a window of ``width`` words that the array ``w`` holds twice or more.

    Windows are compared by 64-bit hashes, so a wrong count needs a hash
    collision within one text. Hashes are sorted as primitive longs; equal
    neighbours are the repeated ones. With at most ``few`` of them the places
    are found by a membership scan, else by sorting (hash, place), so that a
    long text of repeats stays at n log n.
    """
    n = F.size(w)
    hashes = F.when(
        n >= width,
        F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        def with_sorted(s: Column) -> Column:
            again = F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))

            def with_again(d: Column) -> Column:
                by_scan = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, F.get(h, i)))

                def with_pairs(p: Column) -> Column:
                    same = lambda i, j: F.coalesce(F.get(p, j)["h"] == F.get(p, i)["h"], F.lit(False))
                    kept = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
                    return F.sort_array(F.transform(kept, lambda i: F.get(p, i)["i"]))

                pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
                return F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= few, by_scan).otherwise(let(pairs, with_pairs))

            return let(again, with_again)

        return let(F.sort_array(h), with_sorted)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(let(hashes, places), covered).cast("long")


def features(text: Column) -> Column:
    """All counts of one text as a struct of longs; null counts as a text without words.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``
    (``#*$%&|<>``), ``n_stop_words``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` (equal to an earlier such line), ``n_bullet_lines``,
    ``n_ellipsis_lines`` and ``n_repeat_words``.
    """
    text = F.coalesce(text, F.lit(""))
    stops = sorted({x for group in STOP_WORDS.values() for x in group})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    stop_pattern = f"(?<![^{SPACE_CLASS}])(?:{'|'.join(stops)})(?![^{SPACE_CLASS}])"
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))

    def counted(w: Column) -> Column:
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                F.length(F.regexp_replace(F.regexp_replace(F.lower(text), f"{stop_pattern}", "\u0001"), "[^\u0001]+", "")).cast("long").alias("n_stop_words"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda x: x.rlike(f"^[{SPACE_CLASS}]*[-*•‣▪]"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(ls, lambda x: x.rlike(f"(…|\\.\\.\\.)[{SPACE_CLASS}]*$"))).cast("long").alias("n_ellipsis_lines"),
                repeated_windows(w).alias("n_repeat_words"),
            ),
        )

    return let(words(text), counted)


def passes(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        top = stats[r.numerator].cast("double")
        value = top if r.denominator is None else top / F.nullif(stats[r.denominator], F.lit(0)).cast("double")
        if r.lowest is not None:
            verdict = verdict & F.coalesce(value >= r.lowest, F.lit(True))
        if r.highest is not None:
            verdict = verdict & F.coalesce(value <= r.highest, F.lit(True))
    return verdict


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct column ``quality`` (all counts, base_failed, kept); other columns stay.

    A name that ``docs`` already has gets underscores. Null and empty texts
    have no words and fail; repeated rows are judged alike; an empty table
    stays empty; a text of any length is judged whole.
    """
    (stats, out) = fresh(docs, "stats", "quality")
    judged = docs.withColumn(stats, features(F.col(text)))
    failed = base_failed(F.col(stats))
    fields = [F.col(stats)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")]
    return judged.withColumn(out, F.struct(*fields, failed.alias("base_failed"), (~failed & passes(F.col(stats), rules)).alias("kept"))).drop(stats)


def query(docs: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"))
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")
    return judged.select("doc_id", *[q[c].alias(c) for c in names])


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text the rules keep, with the columns of ``docs``.

    Null and empty texts have no words and go; repeated rows stay or go
    together; an empty table stays empty. The counts are bound once, inside the
    filter, so the optimiser has nothing to repeat for each rule.
    """
    return docs.where(let(features(F.col(text)), lambda stats: ~base_failed(stats) & passes(stats, rules)))


_STOPS_SQL = ", ".join("'" + x + "'" for x in sorted({x for g in STOP_WORDS.values() for x in g}))
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, unnest(a) AS word, generate_subscripts(a, 1) AS i
      FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS a FROM d)),
g AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS t FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM g WHERE t IS NOT NULL) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
             count(*) FILTER (lower(word) IN ({_STOPS_SQL})) AS n_stop_words FROM w GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (regexp_matches(line, '^[{SPACE_CLASS}]*[-*•‣▪]')) AS n_bullet_lines,
             count(*) FILTER (regexp_matches(line, '(…|\.\.\.)[{SPACE_CLASS}]*$')) AS n_ellipsis_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
      FROM d LEFT JOIN s USING (rid) LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 15.0 * n_words AND n_symbols / n_words <= 0.4
         AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5
         AND n_bullet_lines / n_lines <= 0.9 AND n_ellipsis_lines / n_lines <= 0.5 AS kept,
       n_stop_words::BIGINT AS n_stop_words, n_lines::BIGINT AS n_lines
FROM b
"""
