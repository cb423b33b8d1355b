"""Finnish word stems, after the published Snowball description of the language."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

V = "aeiouyäö"
LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
REGION = re.compile(f"[{V}][^{V}]")

# The suffix classes of the description.
PARTICLES = ["kin", "kaan", "kään", "ko", "kö", "han", "hän", "pa", "pä"]
OWNERS = ["si", "ni", "nsa", "nsä", "mme", "nne", "an", "än", "en"]
BEFORE_AN = ["ta", "ssa", "sta", "lla", "lta", "na"]
BEFORE_ÄN = ["tä", "ssä", "stä", "llä", "ltä", "nä"]
BEFORE_EN = ["lle", "ine"]
CASES = ["siin", "tten", "seen", "han", "hen", "hin", "hon", "hän", "hön", "den", "lla", "llä", "lle", "lta", "ltä",
         "ssa", "ssä", "sta", "stä", "tta", "ttä", "ine", "ksi", "na", "nä", "ta", "tä", "a", "ä", "n"]
ENDINGS = ["impi", "impa", "impä", "immi", "imma", "immä", "mpi", "mpa", "mpä", "mmi", "mma", "mmä", "eja", "ejä"]


def _regions(w: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first non-vowel that follows a vowel, and once more."""
    m = REGION.search(w)
    r1 = m.end() if m else len(w)
    m = REGION.search(w, r1)
    return r1, (m.end() if m else len(w))


def _ending(w: str, suffixes: list[str], start: int) -> str | None:
    """The longest suffix that lies wholly at or after ``start``."""
    fits = [s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start]
    return max(fits, key=len, default=None)


def _drop_particle(w: str, r1: int, r2: int) -> str:
    s = _ending(w, [*PARTICLES, "sti"], r1)
    if s == "sti":
        return w[:-3] if len(w) - 3 >= r2 else w
    return w[: -len(s)] if s and len(w) > len(s) and w[-len(s) - 1] in V + "nt" else w


def _drop_owner(w: str, r1: int) -> str:
    s = _ending(w, OWNERS, r1)
    if s is None:
        return w
    rest = w[: -len(s)]
    if s == "si":
        return w if rest.endswith("k") else rest
    if s == "ni":
        return rest[:-3] + "ksi" if rest.endswith("kse") else rest
    before = {"an": BEFORE_AN, "än": BEFORE_ÄN, "en": BEFORE_EN}.get(s)
    return rest if before is None or rest.endswith(tuple(before)) else w


def _plural_before(rest: str) -> bool:
    return len(rest) >= 2 and rest[-1] == "i" and rest[-2] in V.replace("y", "")


# Endings that only count after a certain shape; when it is missing a shorter ending may apply.
SHAPED = {"siin": _plural_before, "den": _plural_before, "tten": _plural_before, "seen": lambda r: r.endswith(LONG)}


def _drop_case(w: str, r1: int) -> tuple[str, bool]:
    s = _ending(w, [c for c in CASES if c not in SHAPED or SHAPED[c](w[: -len(c)])], r1)
    if s is None:
        return w, False
    rest = w[: -len(s)]
    if s in ("han", "hen", "hin", "hon", "hän", "hön"):
        fits = rest.endswith(s[1])
    elif s in ("a", "ä"):
        fits = len(rest) >= 2 and rest[-1] in V and rest[-2] not in V
    elif s in ("tta", "ttä"):
        fits = rest.endswith("e")
    else:
        fits = True
    if s == "n" and rest.endswith((*LONG, "ie")):
        rest = rest[:-1]
    return (rest, True) if fits else (w, False)


def _drop_ending(w: str, r2: int) -> str:
    s = _ending(w, ENDINGS, r2)
    if s is None:
        return w
    rest = w[: -len(s)]
    return w if s in ("mpi", "mpa", "mpä", "mmi", "mma", "mmä") and rest.endswith("po") else rest


def _drop_plural(w: str, r1: int, r2: int, case_dropped: bool) -> str:
    if case_dropped:
        return w[:-1] if w[-1:] in ("i", "j") and len(w) - 1 >= r1 else w
    if w.endswith("t") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] in V:
        w = w[:-1]
        s = _ending(w, ["imma", "mma"], r2)
        if s and not (s == "mma" and w[: -len(s)].endswith("po")):
            w = w[: -len(s)]
    return w


def _tidy(w: str, r1: int) -> str:
    if w.endswith(LONG) and len(w) - 2 >= r1:
        w = w[:-1]
    if len(w) - 2 >= r1 and w[-1:] in ("a", "ä", "e", "i") and len(w) > 1 and w[-2] not in V:
        w = w[:-1]
    if w.endswith(("oj", "uj")) and len(w) - 2 >= r1:
        w = w[:-1]
    if w.endswith("jo") and len(w) - 2 >= r1:
        w = w[:-1]
    tail = re.search(f"([^{V}])[{V}]*$", w)
    if tail and tail.start() > 0 and w[tail.start() - 1] == tail.group(1):
        w = w[: tail.start()] + w[tail.start() + 1 :]
    return w


def stem(word: str) -> str:
    w = word
    r1, r2 = _regions(w)
    w = _drop_particle(w, r1, r2)
    w = _drop_owner(w, r1)
    w, case_dropped = _drop_case(w, r1)
    w = _drop_ending(w, r2)
    w = _drop_plural(w, r1, r2, case_dropped)
    return _tidy(w, r1)


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_table(words: DataFrame) -> DataFrame:
    """(term, stem) of distinct lower-cased words ``words(term)``; Finnish stop words have none."""
    stop = [w.lower() for w in StopWordsRemover.loadDefaultStopWords("finnish")]
    return words.where(~F.col("term").isin(stop)).select("term", _stem("term").alias("stem"))
