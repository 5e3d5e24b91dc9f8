"""Text functions: column expressions, and pandas UDFs where Spark has no counterpart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: English stop words.
STOPWORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
did doing a an the and but if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now""".split()
)


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or _; English stop words and numbers are left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS) & ~t.rlike(r"^\p{Nd}+$"))


def filtered(words: Column) -> Column:
    """Words of at least three characters that are neither stop words nor numbers."""
    return F.filter(words, lambda t: (F.char_length(t) >= 3) & ~t.isin(*STOPWORDS) & ~t.rlike(r"^\p{Nd}+$"))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks."""
    size = F.size(words) - (n - 1)
    return F.transform(F.slice(words, F.lit(1), F.greatest(size, F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, n))))


def dehyphenated(text: Column) -> Column:
    return F.replace(text, F.lit("-\n"), F.lit(""))


def merged(*parts: Column) -> Column:
    """The parts that are not null, with a blank between."""
    return F.concat_ws(" ", *parts)


def title_query(title: Column) -> Column:
    """A keyword query from a title: no punctuation, lower case, no stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", "")), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)), " ")


def venue_name(name: Column) -> Column:
    """Without proceedings, parentheses; `A - B` as `B A`, `rest; prefix ...` as `prefix rest`."""
    n = F.regexp_replace(name, r"(?i)\b(proceedings|proc\.)\s*", "")
    parts = F.split(n, "; ")
    swapped = F.when((F.size(parts) == 2) & F.contains(F.get(parts, F.lit(1)), F.lit("...")), F.trim(F.concat_ws(" ", F.trim(F.replace(F.get(parts, F.lit(1)), F.lit("..."), F.lit(""))), F.get(parts, F.lit(0))))).otherwise(n)
    dashed = F.when(F.contains(swapped, F.lit(" - ")), F.regexp_replace(swapped, r"(?s)^(.*?) - (.*)$", "$2 $1")).otherwise(swapped)
    return F.translate(dashed, "()", "")


def author_name(name: Column) -> Column:
    """Without a disambiguating number at the end, tabs and outer blanks."""
    return F.regexp_replace(F.trim(F.translate(name, "\t", " ")), r" \d+$", "")


def key_name(name: Column) -> Column:
    """A join key of a name: no quotes or backslashes."""
    return F.translate(name, "'\\", "")


def file_name(text: Column) -> Column:
    return F.translate(text, " /", "++")


def trimmed_context(text: Column) -> Column:
    """From after the first blank to the last: whole words only."""
    return F.regexp_extract(text, r"(?s)^[^ ]* (.*) [^ ]*$", 1)


def sentence_window(text: Column, start: Column, end: Column, reach: int = 300) -> Column:
    """The sentence around [start, end): from `reach` characters before to as many after, cut at sentence ends."""
    flat = F.translate(text, "\n", " ")
    before = F.substring(flat, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    after = F.substring(flat, end + 1, F.lit(reach))
    head = F.regexp_replace(before, r"^.*\.\s+(?=[A-Z])", "")
    tail = F.regexp_replace(after, r"\.\s+[A-Z].*$", ".")
    return F.concat(head, F.substring(flat, start + 1, end - start), tail)


def sentence_limits(text: Column, at: Column) -> Column:
    """first, last: the places between full stops around a place."""
    before = F.substring(text, F.lit(1), at)
    first = F.char_length(before) - F.coalesce(F.nullif(F.instr(F.reverse(before), "."), F.lit(0)) - 1, F.char_length(before))
    rest = F.substring(text, at + 1, F.char_length(text))
    step = F.instr(rest, ".")
    return F.struct(first.alias("first"), F.when(step > 0, at + step).otherwise(F.char_length(text)).alias("last"))


#: Marks of contributions, and their weights.
CONTRIBUTION_WEIGHTS = (
    (r"this\s+(paper|work|article|chapter|tutorial)", 0.5),
    (r"(\s|^)+we\s+", 0.2),
    (r"contribution(s)?", 1.0),
    (r"\s+our\s+(result(s)+|methodology|framework|architecture)", 0.5),
    (r"(\s|^)+we\s+(.*)(show|prove|describe|give|provide|present|demonstrate|explore|implement|derive|introduce|investigate|extend|address|conclude|evaluate|propose|develop|study|focus)", 1.0),
    (r"license|copy", -1.0),
    (r"section", -0.5),
    (r"supported|funded|grant|thank", -1.5),
)


def contribution_score(sentence: Column) -> Column:
    """The weights of all marks in the sentence; -0.5 without any."""
    s = F.lower(F.trim(sentence))
    total = sum((F.when(s.rlike(f"(?d){p}"), w).otherwise(0.0) for p, w in CONTRIBUTION_WEIGHTS), F.lit(0.0))
    return F.when(F.abs(total) < 1e-9, -0.5).otherwise(total)


def expanded_numbers(marker: Column) -> Column:
    """The numbers that a marker like [1,3-5] cites, each once."""
    parts = F.split(F.translate(marker, "[] ", ""), ",")
    each = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+(-\d+)?$")), lambda p: F.sequence(F.get(F.split(p, "-"), F.lit(0)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.array_distinct(F.flatten(each))


#: Forms of citation markers.
MARKERS = {"numeric": r"\[\d+(?:\s*[-,]\s*\d+)*\]", "alphanumeric": r"(?i)\[[a-z]+\d{2}[a-z]?(?:,\s*[a-z]+\d{2}[a-z]?)*\]", "authors_year": r"\([\p{L}\s.,&]+,?\s(?:19|20)\d{2}[a-z]?\)|[A-Z]\p{L}+(?:\s+(?:and|&)\s+\p{L}+|\s+et al\.?)?\s*\((?:19|20)\d{2}[a-z]?\)"}


def markers(text: Column) -> Column:
    """format, found: the markers of the most frequent form; the form is null without any."""
    found = [F.struct(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("format"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found")) for k, (name, p) in enumerate(MARKERS.items())]
    best = F.array_max(F.array(*found))
    return F.struct(F.when(best["n"] > 0, best["format"]).alias("format"), best["found"].alias("found"))


def reference_section(text: Column) -> Column:
    """What follows the last references or bibliography heading, up to an appendix or acknowledgements."""
    rest = F.regexp_extract(text, r"(?is)^.*\n?\s*\b(?:references|bibliography)\b\s*\n(.*)$", 1)
    return F.regexp_replace(rest, r"(?is)\n\s*(appendix|acknowledge?ments?)\b.*$", "")


def split_references(section: Column) -> Column:
    """References that begin with [n], or else with a numbered line."""
    marked = F.split(section, r"\[\d+\]\s*")
    numbered = F.split(F.concat(F.lit("\n"), section), r"\n\s*\d+\.\s+")
    chosen = F.transform(F.when(F.size(marked) > 1, marked).otherwise(numbered), lambda r: F.regexp_replace(r, r"^\s+|\s+$", ""))
    return F.filter(F.slice(chosen, F.lit(2), F.greatest(F.size(chosen) - 1, F.lit(0))), lambda r: r != "")


def section(paragraphs: Column, start: str, end: str) -> Column:
    """Paragraphs from the last that begins with the start mark to the next that holds the end mark."""
    marks = F.transform(paragraphs, lambda p, i: F.when(F.substring(F.lower(p), 1, 20).rlike(start), i))
    first = F.array_max(F.filter(marks, lambda x: x.isNotNull()))
    tail = F.slice(paragraphs, first + 1, F.size(paragraphs))
    ends = F.transform(tail, lambda p, i: F.when((i > 0) & F.substring(F.lower(p), 1, 20).rlike(end), i))
    last = F.coalesce(F.array_min(F.filter(ends, lambda x: x.isNotNull())), F.size(tail))
    return F.when(first.isNotNull(), F.array_join(F.slice(tail, F.lit(1), last), "\n"))


def html_paragraphs(html: Column) -> Column:
    """Text of the <p> elements, without tags, in order."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1))
    return F.transform(inner, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?s)<[^>]+>", ""), r"\s+", " ")))


def python_title(text: Column) -> Column:
    """Upper case after any non-letter, lower case after a letter."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


#: Words that make a part of an affiliation line an institution, in several languages; those of the first line count before the others.
INSTITUTION_WORDS = (
    "university universität universitat universitaet universidad universidade università universita université universite universiteit universitet uniwersytet academy akademie académie accademia academia",
    "institute institut instituto istituto polytechnic polytechnique politecnico college hochschule école council laboratory laboratories hospital centre center",
)
#: Short forms and misreadings of such words.
INSTITUTION_FORMS = {"univ": "university", "umversity": "university", "inst": "institute", "acad": "academy", "coll": "college"}


def affil_name(text: Column) -> Column:
    """The institution that an affiliation line names, each word capitalised; empty without one.

    The line falls into parts at commas, semicolons, colons, brackets and
    digits. The first part with a word for a university or an academy is the
    institution, or else the first with another institution's word. Only whole
    words count, and only a whole word "the" is taken from its front.
    """
    whole = text
    for short, word in INSTITUTION_FORMS.items():
        whole = F.regexp_replace(whole, rf"(?iU)\b{short}\b\.?", word)
    parts = F.split(whole, r"[,;:<>()\[\]{}\d]+")
    rank = lambda p: F.coalesce(*(F.when(p.rlike(rf"(?iU)\b({'|'.join(words.split())})\b"), k) for k, words in enumerate(INSTITUTION_WORDS)))
    found = F.array_min(F.filter(F.transform(parts, lambda p, i: F.struct(rank(p).alias("rank"), i.alias("i"), p.alias("part"))), lambda x: x["rank"].isNotNull()))["part"]
    bare = F.regexp_replace(F.trim(F.regexp_replace(found, r"\s+", " ")), r"(?i)^the ", "")
    return F.coalesce(python_title(bare), F.lit(""))


def host_tokens(url: Column) -> Column:
    """The parts of a URL's scheme and host, between dots and slashes."""
    return F.split(F.translate(F.regexp_extract(url, r"^https*://([.a-z^/][^/]+[.a-z^/])?", 0), "/", "."), r"\.")


def porter_stem(word: str) -> str:
    """Porter's algorithm of 1980, from the paper."""
    if len(word) <= 2:
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    def measure(w: str) -> int:
        shape = [consonant(w, i) for i in range(len(w))]
        return sum(1 for a, b in zip(shape, shape[1:], strict=False) if b and not a)

    def vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def short(w: str) -> bool:
        return len(w) > 2 and consonant(w, len(w) - 3) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, table: dict[str, str], least: int) -> str:
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + table[end] if measure(stem) > least else w
        return w

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}, 0)
    w = swap(w, {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}, 0)
    for end in sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Porter stems; each distinct word of a batch is stemmed once."""
    table = {w: porter_stem(w) for w in words.dropna().unique()}
    return words.map(table)


def jaro_winkler_similarity(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, (b[j] for j in range(len(b)) if used[j]), strict=True)) // 2  # whole transpositions
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro) if jaro > 0.7 else jaro


#: Cells (pairs times characters of the longer side) that a step of the kernel holds.
KERNEL_CELLS = 1 << 20


def _codes(names: list[str], width: int, blank: int) -> np.ndarray:
    """Code points of the names, a row each, filled up with `blank`."""
    out = np.full((len(names), width), blank, np.int32)
    for row, name in zip(out, names, strict=True):
        row[: len(name)] = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def jaro_winkler_codes(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray, scale: float = 0.1) -> np.ndarray:
    """`jaro_winkler_similarity` of rows of code points, four wide at least, ends filled with -1 in x and -2 in y: each step places one character of all left names."""
    rows, place = np.arange(len(x)), np.arange(x.shape[1])
    reach = (np.maximum(la, lb) // 2 - 1)[:, None]
    from_a, used = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(int(la.max())):
        fits = (y == x[:, i : i + 1]) & ~used & (np.abs(place - i) <= reach)
        at = fits.argmax(1)
        hit = fits[rows, at]
        from_a[:, i] = hit
        used[rows[hit], at[hit]] = True
    m = from_a.sum(1)
    in_order = lambda codes, taken: np.take_along_axis(codes, np.argsort(~taken, axis=1, kind="stable"), 1)
    moved = ((in_order(x, from_a) != in_order(y, used)) & (place < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    same = x == y
    prefix = np.cumprod(same[:, :4], axis=1).sum(1)
    out = np.where(jaro > 0.7, jaro + prefix * scale * (1 - jaro), jaro)
    out[(la == lb) & (same.sum(1) == la)] = 1.0
    return out


def jaro_winkler_pairs(a: list[str], b: list[str], scale: float = 0.1) -> np.ndarray:
    """`jaro_winkler_similarity` of many pairs at once."""
    if not a:
        return np.zeros(0)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = max(int(la.max()), int(lb.max()), 4)
    return jaro_winkler_codes(_codes(a, width, -1), _codes(b, width, -2), la, lb, scale)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs are compared by length, so that a long name widens only its own step."""
    out = np.full(len(a), np.nan)
    given = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    longest = np.maximum(a.str.len().to_numpy(float), b.str.len().to_numpy(float))
    order = given[np.argsort(longest[given], kind="stable")]
    k = 0
    while k < len(order):
        step = max(1, KERNEL_CELLS // max(4, int(longest[order[min(len(order) - 1, k + KERNEL_CELLS // 64)]])))
        part = order[k : k + min(step, KERNEL_CELLS // 64)]
        out[part] = jaro_winkler_pairs(a.iloc[part].tolist(), b.iloc[part].tolist())
        k += len(part)
    return pd.Series([None if np.isnan(v) else v for v in out], dtype="float64")
