"""Quality rules, line first, with DataFrame operations only.

Each line is judged by itself: punctuation (a share of words that carry symbols, shouting, or a fragment of a few
words that no terminal mark ends), navigation (separators between a few words) and boilerplate (set phrases, in
four languages, in a short line). Lines that fail are removed; a document is rejected when the removed lines hold
more than `most_lost` percent of its characters, or when it fails the base limits (fewer than 50 words, or over
half of its words inside 3-word windows that recur).

Everything happens inside the document's row: no shuffle, no Python. Each rule is evaluated once a line.

Defined cases: null text is the empty text, has no words and so fails the base limits; repeated rows, and rows that
tie in id, are judged alike and give a row each; very long texts only cost their own length (a sort of window
hashes, and that only where some window recurs); 3-word windows are compared by 64-bit hashes of the words; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WHITE, WHITE, let, words

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture; a line of at most FURNITURE_WORDS words that holds one is removed.
FURNITURE = "|".join((
    # English
    "all rights reserved", "terms of (use|service)", "privacy policy", "cookie (policy|settings)", "accept cookies", "enable javascript",
    "sign (in|up) ", "log ?in", "subscribe to", "click here", "read more", "share (this|on)", "powered by", "licensed under", "follow us",
    "back to top", "skip to content",
    # German
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz(erklärung|richtlinie|hinweis)", "cookie-(richtlinie|einstellungen)", "cookies akzeptieren",
    "jetzt anmelden", "newsletter abonnieren", "hier klicken", "weiterlesen", "nach oben", "zum inhalt springen", "impressum",
    # French
    "tous droits réservés", "conditions (générales|d.utilisation)", "politique de confidentialité", "accepter les cookies", "se connecter",
    "s.abonner à", "cliquez ici", "lire la suite", "retour en haut", "aller au contenu", "mentions légales", "suivez-nous",
    # Spanish
    "todos los derechos reservados", "términos (de uso|y condiciones)", "política de (privacidad|cookies)", "aceptar (las )?cookies", "iniciar sesión",
    "suscríbete a", "haga clic aquí", "leer más", "volver arriba", "saltar al contenido", "aviso legal", "síguenos en",
))
FURNITURE_WORDS = 40
#: Words that hold one of the symbols, in percent of the line's words, from which it fails.
SYMBOL_PERCENT = 20
#: Words of at least two capitals that end in "!!", in percent.
SHOUT_PERCENT = 50
#: Separators between words, at least so many, for at most so many words each.
NAV_SEPARATORS, NAV_WORDS = 2, 3
#: A line of at most so many words that ends in none of the marks (a closing quote or bracket may follow) is a fragment.
FRAGMENT_WORDS = 12
ENDED = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
MOST_LOST = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words is page furniture or junk. Cheap tests guard the dear ones."""
    symbol_words = _count(line, r"[^\x20\x09-\x0D]*[#*$%&<>{}][^\x20\x09-\x0D]*")
    shouted = _count(line, r"!!")
    bars = _count(line, r"[\x20\x09][|»›•·][\x20\x09]")
    return (
        (line.rlike(r"[#*$%&<>{}]") & (symbol_words * 100 >= n * SYMBOL_PERCENT))
        | (line.contains("!!") & (shouted * 100 >= n * SHOUT_PERCENT))
        | (line.rlike(r"[|»›•·]") & (bars >= NAV_SEPARATORS) & (n <= (bars + 1) * NAV_WORDS))
        | ((n <= FURNITURE_WORDS) & F.lower(line).rlike(FURNITURE))
        | ((n <= FRAGMENT_WORDS) & ~line.rlike(ENDED))
    )


def _line_words(line: Column) -> Column:
    """Words of a line that has one."""
    return F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), WHITE))


def repeated_words(tokens: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; hashes are those of the windows, in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(
        placed,
        lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.size(covered))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_lines, n_removed and clean_text, the text without removed lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = lambda x: let(_line_words(x), lambda k: line_fails(x, k))
    flagged = F.transform(
        F.split(text, "\n"),
        lambda x: let(x.rlike(NOT_WHITE), lambda ink: F.struct(x.alias("line"), ink.alias("ink"), F.when(ink, fails(x)).otherwise(False).alias("bad"))),
    )
    split = df.select(F.col(id_col).alias("doc_id"), text.alias("t"), words(F.col(text_col)).alias("w"), flagged.alias("all_lines"))
    n = F.size("w")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))
    )
    counted = split.select(
        "doc_id",
        "t",
        "w",
        "all_lines",
        F.filter("all_lines", lambda x: x["ink"])["line"].alias("lines"),
        F.filter("all_lines", lambda x: x["bad"])["line"].alias("removed"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h3"),
    )
    judged = counted.select(
        "doc_id",
        "t",
        "all_lines",
        "lines",
        "removed",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w"), F.col("h3")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * F.length(F.array_join("removed", "")) <= most_lost * F.length(F.array_join("lines", "")))).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("removed").cast("bigint").alias("n_removed"),
        F.when(F.size("removed") == 0, F.col("t"))
        .otherwise(F.array_join(F.filter("all_lines", lambda x: ~x["bad"])["line"], "\n"))
        .alias("clean_text"),
    )


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


_W = r"[^\x20\x09-\x0D]+"
ORACLE_OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_W}') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d
), pos AS (
  SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w
), win AS (
  SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)
), tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM win WHERE c IS NOT NULL
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c >= 2) GROUP BY rid
), ln AS (
  SELECT rid, x, len(regexp_extract_all(x, '{_W}')) AS n FROM (SELECT rid, unnest(lines) AS x FROM w)
), judged AS (
  SELECT rid, length(x) AS chars,
    (len(regexp_extract_all(x, '[^\x20\x09-\x0D]*[#*$%&<>{{}}][^\x20\x09-\x0D]*')) * 100 >= n * {SYMBOL_PERCENT})
    AND regexp_matches(x, '[#*$%&<>{{}}]')
    OR (contains(x, '!!') AND len(regexp_extract_all(x, '!!')) * 100 >= n * {SHOUT_PERCENT})
    OR (len(regexp_extract_all(x, '[\x20\x09][|»›•·][\x20\x09]')) >= {NAV_SEPARATORS}
        AND n <= (len(regexp_extract_all(x, '[\x20\x09][|»›•·][\x20\x09]')) + 1) * {NAV_WORDS})
    OR (n <= {FURNITURE_WORDS} AND regexp_matches(lower(x), '{FURNITURE}'))
    OR (n <= {FRAGMENT_WORDS} AND NOT regexp_matches(x, '{ENDED.replace("'", "''")}')) AS bad
  FROM ln
), loss AS (
  SELECT rid, count(*) AS n_lines, sum(bad::INT) AS n_removed, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, sum(chars) AS chars
  FROM judged GROUP BY rid
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
         coalesce(lost, 0) AS lost, coalesce(chars, 0) AS chars
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN loss USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {MOST_LOST} * chars AS kept,
       n_lines, n_removed
FROM base
"""
