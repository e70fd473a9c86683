"""Quality rules, line first: each line is judged by punctuation, navigation and
boilerplate rules; failing lines go, and a document that loses too much of its
text goes with them. Base counts over the whole text come beside that.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Phrases of licences, notices and site furniture that carry no content.
BOILERPLATE = re.compile(
    r"\b(all rights reserved|licen[sc]ed under|spdx-license-identifier|terms of (use|service)|privacy policy|cookie policy|"
    r"accept (all )?cookies|enable javascript|subscribe to our newsletter|sign (in|up)|log ?in|click here|read more|lorem ipsum)\b|©|\(c\) \d{4}",
    re.IGNORECASE,
)
#: A line is navigation if separators stand between its words this often.
MAX_SEPARATORS = 0.2
#: A line is noise if it has more symbols than this a word.
MAX_SYMBOLS = 0.3
#: Of a line's words, how many may end in several exclamation or question marks.
MAX_SHOUTED = 0.3
#: A line of so many words must hold a sentence's end somewhere.
LONG_LINE = 60
#: A document goes if the lines that fail hold more of its word characters.
MAX_LOST = 0.5
MIN_WORDS, MAX_REPEATED = 10, 20
_CUES = ("rights", "licen", "spdx", "terms", "polic", "cookie", "javascript", "newsletter", "sign", "log", "click", "read", "lorem", "©", "(c)")
_SEPARATOR = re.compile(r"[|»›>•·/]+")
#: Words of menus and page turners; a line of at least three words and nothing
#: but these (and numbers and separators) is navigation.
MENU = frozenset(
    "home about contact us faq help search menu login logout register account news blog archive archives categories tags sitemap "
    "next previous prev first last back top page pages older newer posts share print start kontakt impressum datenschutz suche hilfe weiter zurück "
    "accueil recherche aide suivant précédent inicio contacto buscar ayuda siguiente anterior".split()
)


def line_fails(line: str, words: list[bytes]) -> str | None:
    """The rule that a line with words (UTF-8) fails, or None."""
    n = len(words)
    if _SEPARATOR.search(line):
        bars = sum(1 for w in words if _SEPARATOR.fullmatch(w.decode("utf-8", "surrogatepass")))
        if bars > MAX_SEPARATORS * n:
            return "navigation"
    if 3 <= n <= 30 and all(w in MENU or w.isdigit() or _SEPARATOR.fullmatch(w) for w in (w.strip(".,:;()[]") for w in line.lower().split())):
        return "navigation"
    if sum(map(line.count, "#*$%&|<>")) > MAX_SYMBOLS * n:
        return "symbols"
    if n >= 3 and any(x in line for x in ("!!", "??", "!?", "?!")):
        if sum(1 for w in words if w.endswith((b"!!", b"??", b"!?", b"?!"))) > MAX_SHOUTED * n:
            return "punctuation"
    if n >= LONG_LINE and not any(x in line for x in ".!?…。"):
        return "punctuation"
    if n <= 30 and (low := line.lower()) and any(x in low for x in _CUES) and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) ** width < 1 << 62:
        windows = np.zeros(n, np.int64)
        for i in range(width):
            windows = windows * len(known) + codes[i : i + n]
    else:  # ranks of ever longer windows: 1, 2, 4, then 5 words, exact at any length
        windows, have = codes, 1
        while have < width:
            step = min(have, width - have)
            a, b = windows[:-step], windows[step:]
            windows = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
            have += step
    ranked = np.sort(windows)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(windows, twice))
    starts = np.zeros(len(words) + 1, np.int64)
    starts[hit] += 1
    np.add.at(starts, hit + width, -1)
    return int((np.cumsum(starts)[: len(words)] > 0).sum())


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone


def _chars(words: list[bytes]) -> int:
    return len(b"".join(words).decode("utf-8", "surrogatepass"))


def clean(text: str | None) -> tuple[str | None, int]:
    """The text without its failing lines, and how many went; blank lines stay.
    Null stays null."""
    if text is None:
        return None, 0
    lines = text.split("\n")
    kept = [x for x in lines if not (own := _words(x)) or line_fails(x, own) is None]
    return "\n".join(kept), len(lines) - len(kept)


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, n_removed_lines).

    The counts are those of the whole text. The line rules then remove lines, and
    what is left decides: a document that loses over ``MAX_LOST`` of its word
    characters is not kept.
    """
    text = text or ""
    words, seen, dup = [], set(), 0
    for line in text.split("\n"):
        if own := _words(line):
            dup += line in seen
            seen.add(line)
            words += own
    chars, n = _chars(words), len(words)
    left, removed = clean(text)
    lost = chars - _chars(_words(left)) if removed else 0
    repeats = repeated_words(words)
    symbols = sum(map(text.count, "#*$%&|<>"))
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
    return n, chars, symbols, dup, repeats, failed, not failed and lost <= MAX_LOST * chars, lost, removed


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, n_removed_lines long"


def rules(text: Column) -> Column:
    @F.pandas_udf(_FIELDS)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t) for t in texts], columns=[f.split()[0] for f in _FIELDS.split(", ")])

    return of(text)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts and verdicts of ``judge`` for each row.

    A null or empty text has no word, fails the base rules and is not kept.
    Rows that repeat, null ids and extra columns make no difference to others.
    An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), rules(F.col(text_col)).alias("r")).select("doc_id", "r.*")


def cleaned(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The documents that are kept, without their failing lines.

    All columns are returned; ``count_col``, if there, is the text's new length.
    Null, empty and wordless texts fail the base rules and go. Rows that repeat
    are treated alike. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("kept boolean, text string")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(judge(t)[6], clean(t)[0]) for t in texts], columns=["kept", "text"])

    cols = docs.columns
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), of(F.col(text_col)).alias("new")).where("new.kept")
    return out.select(
        *(
            F.col("new.text").alias(c) if c == text_col else F.length("new.text").cast("long").alias(c) if c == count_col else F.col("row").getField(c).alias(c)
            for c in cols
        )
    )
