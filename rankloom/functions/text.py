"""Column functions over text. Everything here is a native expression (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that only number or structure a heading.
STRUCTURAL_WORDS = ["luku", "mom", "momentti", "pykälä", "liite", "osa", "kohta", "ja", "tai"]
HEADING_PUNCTUATION = "[§()\\[\\]{}.:,;\"'–—-]"
SECTION_SEPARATOR = "[;|]|\\s*,\\s*(?=\\d+[.\\s]*§)"


WHITESPACE = " \t\n\r\f\x0b\u00a0"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not spaces only."""
    return F.trim(text, F.lit(WHITESPACE))


def code_tokens(text: Column) -> Column:
    """Split camel case, lower, keep runs of two or more ASCII letters and digits."""
    spaced = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]{2,}"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def or_terms(question: Column) -> Column:
    """The operands of the OR query: no quotes, no leading +/-, no bare and/or."""
    parts = F.split(F.regexp_replace(question, '"', " "), "\\s+")
    bare = F.transform(parts, lambda w: F.regexp_replace(w, "^[-+]+", ""))
    return F.filter(bare, lambda w: (F.length(w) > 0) & ~F.lower(w).isin("or", "and"))


def or_query(question: Column) -> Column:
    return F.array_join(or_terms(question), " OR ")


def split_file_list(raw: Column) -> Column:
    """Comma list of ``.md`` names whose names may hold commas; a leftover piece is kept."""
    pieces = F.filter(F.transform(F.split(raw, ","), strip), lambda p: F.length(p) > 0)
    # No piece holds a comma, so the glued pieces part again behind the names only.
    names = F.filter(F.split(F.array_join(pieces, ","), "(?<=\\.[mM][dD]),"), lambda n: F.length(n) > 0)
    return F.transform(names, lambda n: F.replace(n, F.lit(","), F.lit(", ")))


def split_sections(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, SECTION_SEPARATOR), strip), lambda s: F.length(s) > 0)


def heading_tokens(heading: Column) -> Column:
    """Distinct identifying words of the last path segment of a heading."""
    last = F.element_at(F.split(heading, "/"), -1)
    parts = F.split(F.regexp_replace(F.lower(last), HEADING_PUNCTUATION, " "), "\\s+")
    keep = F.filter(
        parts,
        lambda t: (F.length(t) > 2)
        & ~t.rlike("^\\d+$")
        & ~t.rlike("^[ivxlcdm]+$")
        & ~t.isin(*STRUCTURAL_WORDS),
    )
    return F.array_distinct(keep)


def section_number(heading: Column) -> Column:
    before = F.regexp_extract(heading, "(\\d+)\\s*\\.?\\s*§|§\\s*(\\d+)", 1)
    after = F.regexp_extract(heading, "(\\d+)\\s*\\.?\\s*§|§\\s*(\\d+)", 2)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).try_cast("double")


def normalise_heading(heading: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(heading), "[§.:,]", " "), "\\s+", " "))


def headings_match(gold: Column, candidate: Column) -> Column:
    """Same section: equal numbers where both have one, and enough shared identifying words."""
    g, c = section_number(gold), section_number(candidate)
    a, b = heading_tokens(gold), heading_tokens(candidate)
    shared = F.size(F.array_intersect(a, b))
    smaller = F.least(F.size(a), F.size(b))
    numbers_agree = g.isNull() | c.isNull() | (g == c)
    overlap = (shared == smaller) | ((shared >= 2) & (F.try_divide(shared, smaller) >= 0.6))
    return F.coalesce(numbers_agree & (smaller >= 1) & overlap, F.lit(False))


def section_relevant(sections: Column, heading: Column, heading_path: Column) -> Column:
    """Any gold section matches the heading, or is long and contained in the heading path."""
    path = normalise_heading(heading_path)

    def hit(s):
        want = normalise_heading(s)
        return (F.length(strip(s)) > 0) & (
            headings_match(s, heading) | ((F.length(want) > 12) & F.contains(path, want))
        )

    return F.exists(sections, hit)


def passage_text(title: Column, heading_path: Column, body: Column) -> Column:
    """Title and heading path joined by a dash, a blank line, then the body; no empty head."""
    blank = F.lit("")
    head = F.concat_ws(" — ", F.nullif(title, blank), F.nullif(heading_path, blank))
    return F.when(F.length(head) > 0, F.concat(head, F.lit("\n\n"), body)).otherwise(body)


def title_or_id(title: Column, doc_id: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), doc_id.cast("string"))


def strip_title(file: Column) -> Column:
    """File name without ``.md`` and without a leading CAPS+digits tag."""
    return F.regexp_replace(F.regexp_replace(file, "\\.md$", ""), "^[A-Z]+\\d+_", "")


def truncate_chars(text: Column, limit: int) -> Column:
    """Cut at an external service's input limit. Only for that boundary, never before scoring."""
    return F.substring(text, 1, limit)


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def humanize(label: Column) -> Column:
    return F.translate(label, "_", " ")


def normal_label(x: Column) -> Column:
    """Case and surrounding quotes or sentence punctuation do not distinguish labels."""
    return F.lower(strip(F.regexp_replace(strip(x), "^[`'\".?!]+|[`'\".?!]+$", "")))


def label_candidates(answer: Column) -> Column:
    """Readings of a free-text answer, best first: as is, underscored, first word."""
    t = F.regexp_replace(normal_label(answer), "^(intent|label)\\s*:\\s*", "")
    return F.transform(
        F.array(t, F.replace(t, F.lit(" "), F.lit("_")), F.get(F.split(strip(t), "\\s+"), F.lit(0))), normal_label
    )


def parse_label(answer: Column, labels: Column) -> Column:
    """First reading that names one of ``labels`` (an array column), else NULL.

    When two labels normalise alike the later one answers, as in a dictionary build.
    """
    named = F.transform(
        label_candidates(answer),
        lambda c: F.try_element_at(F.filter(labels, lambda l: normal_label(l) == c), F.lit(-1)),
    )
    return F.get(F.filter(named, lambda l: l.isNotNull()), F.lit(0))


def option_label(token: Column, labels: Column) -> Column:
    """Label at a 0-based option number; NULL when not a number or out of bounds."""
    t = strip(token)
    return F.when(t.rlike("^[0-9]+$"), F.get(labels, t.try_cast("int")))


def first_digit(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, "([0-9])", 1), F.lit("")).try_cast("int"), F.lit(-1))


def yes_probability(top: Column, text: Column) -> Column:
    """Normalised mass of yes-tokens; when no token says yes or no, the text decides."""

    def mass(prefix):
        said = F.filter(top, lambda t: F.lower(strip(t["token"])).startswith(prefix))
        return F.aggregate(said, F.lit(0.0).cast("double"), lambda acc, t: acc + F.exp(t["logprob"]))

    yes, no = mass("yes"), mass("no")
    said_yes = F.lower(strip(text)).startswith("yes").cast("double")
    return F.when(yes + no > 0, yes / (yes + no)).otherwise(said_yes)
