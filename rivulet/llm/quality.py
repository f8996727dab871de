"""Document quality by cleaning lines first, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import WS_CLASS, let, words

#: Phrases of page furniture and of licence notices, matched in any case anywhere in a line of at most
#: LONG characters.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "uses cookies", "accept cookies", "privacy policy", "terms of use", "terms of service", "terms and conditions", "lorem ipsum", "enable javascript",
    "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter", "follow us on", "click here to", "licensed under the", "permission is hereby granted", "spdx-license-identifier",
    "alle rechte vorbehalten", "verwendet cookies", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "newsletter abonnieren", "javascript aktivieren",
    "tous droits réservés", "utilise des cookies", "politique de confidentialité", "conditions générales", "mentions légales", "abonnez-vous à notre newsletter",
    "todos los derechos reservados", "utiliza cookies", "política de privacidad", "términos y condiciones", "aviso legal", "suscríbete a nuestro boletín",
)
#: Labels of navigation. A line of at most 80 characters that holds nothing else is navigation.
NAVIGATION = (
    "home", "menu", "next", "next page", "previous", "previous page", "back", "back to top", "top", "login", "log in", "log out", "sign in", "sign up", "register", "contact", "contact us", "about", "about us", "sitemap",
    "search", "share", "share this", "tweet", "print", "read more", "more", "continue reading", "skip to content", "leave a comment", "faq", "help", "archive", "blog", "news",
    "startseite", "weiter", "zurück", "nach oben", "anmelden", "registrieren", "kontakt", "über uns", "impressum", "datenschutz", "suche", "teilen", "drucken", "weiterlesen", "mehr",
    "accueil", "suivant", "précédent", "retour", "connexion", "inscription", "nous contacter", "à propos", "plan du site", "recherche", "partager", "imprimer", "lire la suite",
    "inicio", "siguiente", "anterior", "volver", "iniciar sesión", "registrarse", "contacto", "sobre nosotros", "mapa del sitio", "buscar", "compartir", "imprimir", "leer más",
)
LONG = 400
_GAP = "[\\x20\\x09-\\x0D!-@\\[-`{-~•»·…]"
NAVIGATION_LINE = f"^{_GAP}*(?:(?:{'|'.join(sorted(NAVIGATION, key=lambda x: (-len(x), x)))})(?:{_GAP}+|$))+$"
#: Three dots at the end of a short line: a teaser that was cut off.
TEASER = "(?:\\.\\.\\.|…|\\[\\.\\.\\.\\]|\\[…\\])[\\x20\\x09-\\x0D]*$"
SYMBOLS = "[#*$%&|<>]"
_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs; 0 for null and empty texts).

    Repeated three-word windows are found inside the row: window hashes are sorted with their positions, those equal
    to a neighbour are repeats, and the words they cover are summed over the gaps between their positions, so a
    text of n words costs n log n however often it repeats itself.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"__t": t, "__w": words(F.col(text))})
    w = F.col("__w")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(_HAS_WORD))
    windows = F.when(
        F.size(w) >= 3,
        let(
            w,
            lambda a: F.sort_array(
                F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.struct(F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("h"), i.alias("i")))
            ),
        ),
    )

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    positions = let(windows, lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.char_length("__t") - F.char_length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.coalesce(let(positions, covered), F.lit(0)).cast("long"),
        }
    )
    return out.drop("__w", "__t")


def line_passes(line: Column) -> Column:
    """True for a line that fails none of the rules on punctuation, navigation and boilerplate. Blank lines pass.

    Punctuation: at most one symbol of SYMBOLS for every eight characters, exclamation marks in at most one character
    of ten, and, in a line of fewer than 12 words, no three dots at its end. Navigation: fewer than three separators (a
    bar, bullet, guillemet or middle dot between blanks) or at least twelve words to a separator; and not labels of
    NAVIGATION alone. Boilerplate: none of the phrases of BOILERPLATE in a line of at most LONG characters.
    """
    size = F.char_length(line)
    symbols = size - F.char_length(F.regexp_replace(line, SYMBOLS, ""))
    marks = size - F.char_length(F.regexp_replace(line, "!", ""))
    bars = F.size(F.split(line, " [|•»·>] ")) - 1
    blanks = size - F.char_length(F.regexp_replace(line, WS_CLASS, ""))
    navigation = (bars >= 3) & (blanks < 12 * bars) | (size <= 80) & line.rlike("(?iu)" + NAVIGATION_LINE)
    boilerplate = (size <= LONG) & line.rlike("(?iu)" + "|".join(BOILERPLATE))
    return ~((symbols * 8 > size) | (marks * 10 > size) | (blanks < 11) & line.rlike(TEASER) | navigation | boilerplate)


def assess(docs: DataFrame, text: str = "text", min_kept: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """`docs` with the statistics, clean_text, kept_share, base_failed and kept.

    clean_text is the text of the lines that pass; kept_share the share of the characters they hold (1 for texts
    without a character). base_failed: fewer than `min_words` words, or over `max_repeat` per cent of the words in
    repeated windows. kept: not base_failed and kept_share at least `min_kept`. Null texts count as empty and fail
    the base rule; their clean_text is ''. Every row is judged alone, so ties and repeated rows need no rule. Columns of
    `docs` with names of the new ones are replaced.
    """
    out = statistics(docs, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    out = out.withColumn("clean_text", F.array_join(F.filter(lines, line_passes), "\n"))
    total = F.char_length(F.coalesce(F.col(text), F.lit("")))
    share = F.when(total == 0, F.lit(1.0)).otherwise(F.char_length("clean_text") / total)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = out.withColumns({"kept_share": share, "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept))
