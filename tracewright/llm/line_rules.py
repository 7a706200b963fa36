"""Line-first cleaning, and counts of a text's words, symbols and repeats; all within Spark's own expressions.

Each line is tested alone: marks (too much punctuation or too many symbols, or a long run of words with no punctuation
at all), navigation (a short unfinished line that opens with a menu word or is cut by separators) and boilerplate
(fixed notices). Failing lines go; a document goes if more than `most_lost` percent of the characters of its words went.
Phrases are rows of a table (language, kind, phrase), limits are parameters; both are in Rules. Everything is computed
within a row, so there is no shuffle, and a document's length is the only thing that counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common

# Fixed values.
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!-/:-@\\[-`{-~]"
HAS_WORD = "[^\\x20\\x09-\\x0D]"
SENTENCE_END = "[.!?:;,\\)\"'\\]] *$"
SEPARATORS = "([|>/*] .*){2}"

_NAVIGATION = {
    "en": "home|menu|log in|login|sign in|sign up|subscribe|share|next|previous|back to top|contact us|about us|search|skip to content|read more|click here|site map|sitemap",
    "fr": "accueil|connexion|se connecter|inscription|abonnez-vous|partager|suivant|précédent|haut de page|contactez-nous|à propos|rechercher|aller au contenu|lire la suite|cliquez ici|plan du site",
    "de": "startseite|menü|anmelden|einloggen|registrieren|abonnieren|teilen|nächste seite|vorherige seite|nach oben|kontakt|über uns|suche|zum inhalt|weiterlesen|hier klicken|sitemap",
    "es": "inicio|menú|acceder|iniciar sesión|registrarse|suscribirse|compartir|siguiente|anterior|volver arriba|contacto|sobre nosotros|buscar|saltar al contenido|leer más|haga clic aquí|mapa del sitio",
}
_BOILERPLATE = {
    "en": "all rights reserved|we use cookies|cookie policy|privacy policy|terms of use|terms of service|javascript is disabled|enable javascript|lorem ipsum",
    "fr": "tous droits réservés|nous utilisons des cookies|politique de cookies|politique de confidentialité|conditions d'utilisation|mentions légales|javascript est désactivé|activer javascript",
    "de": "alle rechte vorbehalten|wir verwenden cookies|cookie-richtlinie|datenschutzerklärung|nutzungsbedingungen|javascript ist deaktiviert|javascript aktivieren",
    "es": "todos los derechos reservados|utilizamos cookies|política de cookies|política de privacidad|términos de uso|condiciones de uso|javascript está desactivado|activar javascript",
}
#: (language, kind, phrase).
PHRASES = tuple(
    (language, kind, phrase) for kind,
    table in (("navigation", _NAVIGATION), ("boilerplate", _BOILERPLATE)) for language,
    phrases in table.items() for phrase in phrases.split("|")
)


def _any(phrases: list[str]) -> str:
    """Any of the phrases, whatever the case of their letters."""
    either = lambda c: f"[{c}{c.upper()}]" if c.upper() != c and not c.isascii() else re.escape(c) if c in ".-" else c
    return "(" + "|".join("".join(map(either, p)) for p in sorted(set(phrases))) + ")"


@dataclass(frozen=True)
class Rules:
    """A line fails with more than a fifth of marks or a tenth of symbols among its characters other than white space
    (marks_in, symbols_in), with unmarked_words words and no mark, as a menu of menu_words words at most, or with a notice
    among notice_words words at most."""

    phrases: tuple[tuple[str, str, str], ...] = PHRASES
    marks_in: int = 5
    symbols_in: int = 10
    unmarked_words: int = 30
    menu_words: int = 6
    notice_words: int = 40

    def pattern(self, kind: str) -> str:
        """A regular expression of the phrases of a kind; one that matches nothing if there are none."""
        own = [p for _, k, p in self.phrases if k == kind]
        if not own:
            return "[^\\x00-\\x{10FFFF}]"
        return "(?i)^ *" + _any(own) + "([^a-z]|$)" if kind == "navigation" else "(?i)" + _any(own)


RULES = Rules()


def line_size(line: Column) -> Column:
    """Characters other than ASCII white space."""
    return F.length(F.replace(line, F.lit(" "), F.lit(""))) - F.regexp_count(line, F.lit("[\\x09-\\x0D]"))


def line_fails(line: Column, n: Column, rules: Rules = RULES) -> Column:
    """Whether a line that has a word, and n characters other than white space, fails one of the rules."""

    def tested(x: Column) -> Column:
        noisy = (rules.marks_in * x["marks"] > n) | ((x["marks"] == 0) & (x["words"] >= rules.unmarked_words)) | (
            rules.symbols_in * F.regexp_count(line, F.lit(SYMBOLS)) > n
        )
        menu = (x["words"] <= rules.menu_words) & ~line.rlike(SENTENCE_END) & (
            line.rlike(rules.pattern("navigation")) | line.rlike(SEPARATORS)
        )
        return noisy | menu | ((x["words"] <= rules.notice_words) & line.rlike(rules.pattern("boilerplate")))

    return common.let(
        F.struct(F.regexp_count(line, F.lit(MARKS)).alias("marks"), F.regexp_count(line, F.lit(HAS_WORD + "+")).alias("words")), tested
    )


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text, counted once each."""

    def covered(sorted_windows: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(sorted_windows, a)["h"] == F.get(sorted_windows, b)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(sorted_windows) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        starts = F.array_sort(F.transform(twice, lambda j: F.get(sorted_windows, j)["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"]
        )

    window = lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
    )
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.when(F.size(words) >= 4, common.let(windows, covered)).otherwise(0)


def clean_lines(docs: DataFrame, most_lost: int = 50, rules: Rules = RULES) -> DataFrame:
    """Counts and verdict of each row of docs, and its text without the failing lines.

    A null or empty text has no words and fails the base rule. Ties and repeated rows change nothing: every row stands
    alone. Other columns of docs are ignored. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words")
        )

    def by_line(lines: Column) -> Column:
        judged = F.transform(
            lines, lambda x: common.let(line_size(x), lambda n: F.struct(x.alias("t"), F.when(line_fails(x, n, rules), n).alias("lost")))
        )
        # A line has a word, so a line that fails loses a character at least.
        return common.let(judged, lambda js: F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.aggregate(
                js, F.lit(0), lambda acc, j: acc + F.coalesce(j["lost"], F.lit(0))
            ).alias("lost"),
            F.size(F.filter(js, lambda j: j["lost"].isNotNull())).alias("n_failed_lines"), F.array_join(
                F.transform(F.filter(js, lambda j: j["lost"].isNull()), lambda j: j["t"]), "\n"
            ).alias("kept_text"),
        ))

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.let(common.space_words(F.col("text")), measured).alias("w"),
        common.let(worded, by_line).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    rows = rows.withColumn("base_failed", (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words")))
    kept = ~F.col("base_failed") & (100 * F.col("l.lost") <= most_lost * F.col("w.word_chars"))
    return rows.select(
        "doc_id",
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        "l.n_failed_lines",
        "l.kept_text",
        "base_failed",
        kept.alias("kept")
    )


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: translate(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') <> '') AS ls FROM t),
win AS (SELECT uid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
rep AS (SELECT uid, i FROM (SELECT *, count(*) OVER (PARTITION BY uid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT uid, count(DISTINCT i + j) AS n FROM rep, range(3) AS r(j) GROUP BY uid),
li AS (SELECT uid, x AS t, translate(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') AS s FROM w, unnest(ls) AS r(x)),
lm AS (SELECT *, length(s) AS n, length(s) - length(regexp_replace(s, '[!-/:-@\[-`{-~]', '', 'g')) AS marks,
              length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS symbols, len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k FROM li),
lf AS (SELECT uid, n, (5 * marks > n OR 10 * symbols > n OR (marks = 0 AND k >= 30))
         OR (k <= 6 AND NOT regexp_matches(t, '[.!?:;,\)"''\]] *$') AND (regexp_matches(t, '{navigation}') OR regexp_matches(t, '{separators}')))
         OR (k <= 40 AND regexp_matches(t, '{boilerplate}')) AS fails FROM lm),
lost AS (SELECT uid, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM lf GROUP BY uid),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN cov c USING (uid) LEFT JOIN lost USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept
FROM b
""".replace("{navigation}", _quoted(RULES.pattern("navigation"))).replace("{separators}", SEPARATORS).replace("{boilerplate}", _quoted(RULES.pattern("boilerplate")))
