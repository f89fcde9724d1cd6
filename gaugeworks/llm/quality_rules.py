"""Line-first cleaning: rules judge each line, failing lines go, and texts that lose too much are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACE, let

# Fixed values of the query contract.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

#: Marks that noisy lines carry: symbols, or two and more of ! or ? together.
ODD_MARKS = "[#*$%&<>]+|[!?]{2,}"
#: Separators between the entries of menus and link lists.
LINK_MARKS = "[|·»›]"
#: Phrases of page furniture, in lower case.
FURNITURE = (
    "accept all cookies", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign up for our newsletter",
    "skip to content", "terms of service", "terms of use", "this site uses cookies", "use of cookies",
)
#: A line fails above this share of odd marks or separators to words.
LINE_SHARE = 0.25
#: Lines with fewer words or marks than this are not judged by their share of marks.
LEAST_MARKS = 3
#: A text is rejected when more than this share of its word characters stood in failing lines.
LOST_SHARE = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _repeated_words(words: Column) -> Column:
    """Words inside a window of eight that occurs twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with an equal pair sort their windows; equal ones are
    then neighbours, and the covered words follow from the gaps between their places.
    """

    def places(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(order: Column) -> Column:
            def same(x: Column, i: Column, step: int) -> Column:
                return F.coalesce(F.get(order, i + step)["h"] == x["h"], F.lit(False))

            equal = F.filter(order, lambda x, i: same(x, i, -1) | same(x, i, 1))
            return F.sort_array(F.transform(equal, lambda x: x["i"]))

        return let(order, neighbours)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def with_windows(windows: Column) -> Column:
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, let(places(windows), covered)).otherwise(F.lit(0))

    def with_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))), with_windows)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(hashed, with_hashes)).otherwise(F.lit(0))


def _line(line: Column) -> Column:
    """Why a line fails (null: it passes), with its word characters."""
    words = F.size(_words(line))
    chars = F.length(F.regexp_replace(line, f"[{SPACE}]+", ""))
    odd, links = F.regexp_count(line, F.lit(ODD_MARKS)), F.regexp_count(line, F.lit(LINK_MARKS))

    def over(marks: Column) -> Column:
        return (marks >= LEAST_MARKS) & (marks > words * LINE_SHARE)

    why = (
        F.when(over(odd), "punctuation").when(over(links), "navigation")
        .when(F.lower(line).rlike("|".join(FURNITURE)), "boilerplate")
    )
    return F.struct(line.alias("line"), chars.alias("chars"), why.alias("why"))


def rules_of(text: str = "text") -> Column:
    """What the rules say about a text, and the text without its failing lines.

    A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines,
    lost_chars (all long), base_failed, kept and cleaned. Empty lines are neither judged nor removed. A null
    text has no words: base_failed is true, kept false and cleaned null. Rows are judged one by one, so
    repeated rows, null ids and other columns change nothing. Built from SQL functions alone, with no shuffle.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(raw, "\n")
    has_word = f"[^{SPACE}]"
    full = F.filter(lines, lambda x: x.rlike(has_word))
    base = F.struct(
        let(
            _words(raw),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("words"),
        F.regexp_count(raw, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(lines, _line).alias("lines"),
    )

    def verdict(b: Column) -> Column:
        w, failed = b["words"], F.filter(b["lines"], lambda x: x["why"].isNotNull())
        lost = F.aggregate(failed, F.lit(0).cast("long"), lambda total, x: total + x["chars"])
        base_failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > REPEAT_PERCENT * w["n_words"])
        cleaned = F.array_join(F.transform(F.filter(b["lines"], lambda x: x["why"].isNull()), lambda x: x["line"]), "\n")
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), b["n_symbols"].alias("n_symbols"),
            b["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            base_failed.alias("base_failed"), (~base_failed & (lost <= w["word_chars"] * LOST_SHARE)).alias("kept"),
            F.size(F.filter(b["lines"], lambda x: x["chars"] > 0)).cast("long").alias("n_lines"),
            F.size(failed).cast("long").alias("n_failed_lines"), lost.alias("lost_chars"),
            F.when(F.col(text).isNotNull(), cleaned).alias("cleaned"),
        )

    return let(base, verdict)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of figures and verdict for each text."""
    judged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("rules", rules_of())
    fields = [f for f in judged.schema["rules"].dataType.names if f != "cleaned"]
    return judged.select("doc_id", *[F.col("rules")[f].alias(f) for f in fields])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The texts that pass, without their failing lines; all columns of ``docs``, whatever their names.

    The rules are the one element of a generator, so the filter on their verdict does not evaluate them again.
    """
    judged = docs.select(F.struct("*").alias("row"), F.explode(F.array(rules_of(text))).alias("rules")).filter("rules.kept")
    return judged.select(*[F.col("rules.cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


#: The same in the checking engine's SQL.
ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM t, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
marked AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, len(regexp_extract_all(line, '[#*$%&<>]+|[!?]{{2,}}')) AS odd,
    len(regexp_extract_all(line, '[|·»›]')) AS links FROM lines),
judged AS (
  SELECT *, (odd >= 3 AND odd > nw * 0.25) OR (links >= 3 AND links > nw * 0.25)
    OR regexp_matches(lower(line), '{"|".join(FURNITURE)}') AS bad FROM marked),
per AS (
  SELECT doc_id, count(*) FILTER (chars > 0) AS n_lines, count(*) FILTER (bad) AS n_failed_lines,
    coalesce(sum(chars) FILTER (bad), 0) AS lost_chars,
    count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS n_dup_lines FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(rep.n, 0) AS n_repeat_words,
    len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed FROM t LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= word_chars * 0.5 AS kept, n_lines::BIGINT AS n_lines,
  n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars
FROM base JOIN per USING (doc_id)
"""
