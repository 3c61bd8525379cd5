"""Text decoding and naming: legacy-font soup, transliteration, glossaries, header and title words.

Lexicons are parameters (arrays of key and value, in order), so a corpus brings its own.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.functions import cells as C

# The public glyph order of the Kruti Dev font.
MULTI_GLYPHS = [
    ("vkS", "औ"), ("vks", "ओ"), ("vk", "आ"), ("bZ", "ई"), ("{k", "क्ष"), ("K", "ज्ञ"), ("J", "श्र"), ("?k", "घ"), ("[k", "ख"), ("'k", "श"), ("’k", "श"),
    ('"k', "ष"), ("Fk", "थ"), ("Hk", "भ"), (".k", "ण"), ("/k", "ध"), ("M+", "ड़"), ("<+", "ढ़"), ("t+", "ज़"), ("d+", "क़"), ("Q+", "फ़"), ("x+", "ग़"),
    ("ksa", "ों"), ("kSa", "ौं"), ("ks", "ो"), ("kS", "ौ"),
]
SINGLE_GLYPHS = {
    "v": "अ", "b": "इ", "m": "उ", "Å": "ऊ", ",": "ए", "d": "क", "x": "ग", "p": "च", "N": "छ", "t": "ज", ">": "झ", "V": "ट", "B": "ठ", "M": "ड", "<": "ढ", "r": "त", "n": "द",
    "/": "ध्", "[": "ख्", "u": "न", "i": "प", "Q": "फ", "c": "ब", "e": "म", ";": "य", "j": "र", "y": "ल", "o": "व", "l": "स", "g": "ह", ".": "ण्", "U": "न्", "R": "त्", "T": "ज्",
    "X": "ग्", "L": "स्", "D": "क्", "P": "च्", "C": "ब्", "O": "व्", "H": "भ्", "F": "थ्", "E": "म्", "Y": "ल्", "W": "व्", "I": "प्", "k": "ा", "h": "ी", "q": "ु", "w": "ू",
    "s": "े", "S": "ै", "a": "ं", "¡": "ँ", "`": "ृ", "~": "्", "z": "्र", "f": "ि", "&": "-", "A": "।", "]": ",", "_": ";", "=": "त्र", "|": "द्य", "Ø": "क्र", "{": "क्ष्", "º": "ह्", "¼": "(", "½": ")",
}
SOUP_MARKERS = ("ks", "iq", "qj", "Uk", "[k", ".k", "kS", "Fk", "Hk", "?k", '"k', "'k", "M+", "<+", "~", "ftk", "yk", "uk", "ok", "dh", "kj", "fj", "Tt", "esa", "dz", "{k")
PLAIN_WORDS = ("of", "per", "and", "the", "in", "on", "for", "to", "no", "by", "at", "total", "male", "female", "males", "females", "persons", "years", "year", "rate", "all", "india", "district", "number")
SMALL_WORDS = ("of", "per", "and", "the", "in", "on", "for", "to", "no", "by", "at")
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
    "Andaman and Nicobar Islands", "Chandigarh", "Dadra and Nagar Haveli and Daman and Diu", "Dadra Nagar Haveli and Daman Diu", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "NCT of Delhi", "Puducherry",
)
STATE_FRAGMENTS = {"tam nadu": "Tamil Nadu", "tel angana": "Telangana", "of delhi": "NCT of Delhi"}
TITLE = r"(?i)(Table|Tabel|Statement|Annexure|Appendix)[\s\-:.]*\(?\s*(\p{Nd}+([.\-]\p{Nd}+)*)\s*\)?[\s\-:.]*(.*)"
TITLE_PREFIX = r"(?i)^(table|tabel|statement|annexure|appendix|chapter|figure)\b[\s\-]*(no\.?)?[\s\-]*(\p{Nd}+[A-Za-z]?(\.\p{Nd}+)*)?[\s:.\-]+"
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split()))
VOWELS = dict(zip("अआइईउऊएऐओऔऋ", "a aa i ee u oo e ai o au ri".split()))
SIGNS = dict(zip("ािीुूेैोौृंँः", "aa i ee u oo e ai o au ri n n h".split()))


def fold_replace(text: Column, pairs) -> Column:
    """Ordered replacements."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def bare(token: Column) -> Column:
    return F.regexp_replace(token, "[^A-Za-z]", "")


def has_vowel(word: Column) -> Column:
    return word.rlike("(?i)[aeiou]")


def looks_soup(token: Column, deep: int = 2) -> Column:
    """Is an ASCII token text in a legacy font? Ordered tests; parts of compounds are judged by themselves."""

    def judged(x: Column) -> Column:
        t, b = x["t"], x["b"]
        plain = (F.length(b) < 3) | F.lower(b).isin(*PLAIN_WORDS) | b.rlike("^([A-Z][a-z]+|[A-Z]+)$")
        out = F.when(plain, False)
        if deep:
            # a sign splits a compound when each of its parts has letters enough
            parts = F.filter(F.split(t, F.when(t.contains("/"), "/").otherwise("-")), lambda p: p != "")
            slash = t.contains("/") & F.forall(parts, lambda p: F.length(bare(p)) >= 3)
            dash = ~t.contains("/") & t.contains("-") & (F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(bare(p)) >= 2)
            out = out.when((F.size(parts) > 0) & (slash | dash), F.forall(parts, lambda p: looks_soup(p, 0)))
        good = lambda c: (F.length(c) >= 5) & has_vowel(c) & ~F.lower(c).rlike("q(?!u)")
        joined = M.bind(F.regexp_extract_all(b, F.lit("([A-Z][a-z]+|^[a-z]+)"), F.lit(1)), lambda c: (F.size(c) > 0) & (F.array_join(c, "") == b) & F.forall(c, good))
        out = out.when(t.rlike(r"[\[\]~<>{}|]"), True).when(~has_vowel(b), True).when(b.rlike("^.+[A-Z]"), ~joined)
        if deep:
            stem = F.substring(b, F.lit(1), F.length(b) - 1)
            out = out.when(b.rlike("^[a-z]+s$") & (F.length(stem) >= 3) & stem.rlike("[aeiou]") & ~looks_soup(stem, 0), False)
        return out.otherwise(t.rlike("|".join(map(re.escape, SOUP_MARKERS))))

    return M.bind(F.struct(token.alias("t"), bare(token).alias("b")), judged)


def script_kind(v: Column) -> Column:
    """deva, kruti or an empty string for a clean cell; null for a blank one."""
    s = C.strip(v)
    tokens = F.filter(C.words(s), lambda t: t.rlike("[A-Za-z]"))
    return F.when(F.lower(s).isin("", "nan", "none"), F.lit(None)).when(s.rlike("[ऀ-ॿ]"), "deva").when((F.size(tokens) > 0) & (M.share(tokens, lambda t: looks_soup(t)) >= 0.5), "kruti").otherwise("")


def soup_to_unicode(text: Column) -> Column:
    """Glyphs to Devanagari; the short i moves behind its cluster, the reph before its syllable."""
    t = fold_replace(text, MULTI_GLYPHS)
    table = F.create_map(*(F.lit(x) for p in SINGLE_GLYPHS.items() for x in p))
    t = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.get(F.array(table), F.lit(0))[c], c)), "")
    t = F.regexp_replace(t, "ि([क-ह]़?(?:्[क-ह]़?)*)", "$1ि")
    return F.regexp_replace(t, "([क-ह]़?[ािीुूृेैोौंँ]*)Z", "र्$1")


def unicode_to_ascii(text: Column) -> Column:
    """The inverse: what was typed where a font shows Devanagari."""
    inverse: dict[str, str] = {}
    for glyph, dev in [*MULTI_GLYPHS, *SINGLE_GLYPHS.items()]:
        inverse.setdefault(dev, glyph)
    t = fold_replace(text, sorted(inverse.items(), key=lambda p: -len(p[0])))
    return F.translate(t, "&¼½]_", "-(),;")


def decode_mojibake(token: Column, small: tuple[str, ...] = ("blocks", "ltd", "trg", "pvt", "dept", "sub", "respectively")) -> Column:
    """English typed in a legacy font's slots, where its letters come out cased like English; else the token as it is."""

    def judged(d: Column) -> Column:
        parts = F.filter(F.split(d, "[^A-Za-z]+"), lambda p: p != "")
        vowels = lambda p: F.length(F.regexp_replace(p, "[^aeiou]", ""))
        cased = lambda p: p.rlike("^([A-Z][a-z]*|[A-Z]+s?)$") | (p.rlike("^[a-z]+$") & (p.isin(*small) | (F.length(p) <= 3) | (vowels(p) >= 0.3 * F.length(p))))
        fits = d.rlike("^[A-Za-z][A-Za-z0-9./()&,-]*$") & (F.length(bare(d)) >= 2) & (F.size(parts) > 0) & F.forall(parts, cased)
        return F.when(fits, d).otherwise(token)

    return F.when(token.rlike("[ऀ-ॿ]"), M.bind(unicode_to_ascii(token), judged)).otherwise(token)


def transliterate(text: Column) -> Column:
    """Devanagari to Latin letters: a consonant keeps its a unless a sign or a virama follows."""
    t = text
    for dev, latin in CONSONANTS.items():
        t = F.regexp_replace(t, f"{dev}़?(?=्)", latin)
        t = F.regexp_replace(t, f"{dev}़?(?=[ािीुूेैोौृ])", latin)
        t = F.regexp_replace(t, f"{dev}़?", f"{latin}a")
    for dev, latin in {**VOWELS, **SIGNS, "्": "", "।": ".", **{chr(0x966 + k): str(k) for k in range(10)}}.items():
        t = F.replace(t, F.lit(dev), F.lit(latin))
    return F.regexp_replace(t, "[ऀ-ॿ]", "")


def translate(text: Column, phrases: list[tuple[str, str]], terms: list[tuple[str, str]] = (), exact: list[tuple[str, str]] = ()) -> Column:
    """A label in English: exact and loose entries, else phrases in order and then words; soup is decoded first.

    A soup label followed by its own English words is those words.
    """
    norm = C.strip(F.regexp_replace(F.translate(text, "’‘“”", "''\"\""), r"(?U)\s+", " "))
    known = F.create_map(*(F.lit(x) for p in exact for x in p)) if exact else None
    loose = F.create_map(*(F.lit(x) for k, v in exact for x in ("".join(k.split()).lower(), v))) if exact else None
    tokens = F.split(norm, " ")
    soup = lambda t: looks_soup(t, 1)
    flags = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^[A-Za-z]{1,3}\.[A-Z][a-z]{2,}") | ((bare(t) != "") & ~soup(t)), "E").when(soup(t), "S").otherwise("x")), "")
    run = F.length(F.regexp_extract(flags, "(E+)$", 1))
    suffix = F.array_join(F.slice(tokens, F.size(tokens) - run + 1, run), " ")
    decoded = F.array_join(F.transform(tokens, lambda t: F.when(soup(t), soup_to_unicode(t)).otherwise(t)), " ")
    dev = F.when(norm.rlike("[ऀ-ॿ]"), norm).when(flags.contains("S"), decoded)
    word = F.create_map(*(F.lit(x) for p in terms for x in p)) if terms else None
    said = fold_replace(dev, phrases)
    if word is not None:
        said = F.array_join(F.filter(F.transform(F.split(said, " "), lambda t: F.coalesce(F.get(F.array(word), F.lit(0))[F.regexp_replace(t, "^[:,;()|.]+|[:,;()|.]+$", "")], t)), lambda t: t != ""), " ")
    out = F.when(norm == "", text).when((run > 0) & (run < F.size(tokens)) & suffix.rlike("[A-Za-z]{3}") & flags.rlike("S.*E"), suffix)
    if known is not None:
        out = out.when(F.get(F.array(known), F.lit(0))[norm].isNotNull(), F.get(F.array(known), F.lit(0))[norm])
        low = F.lower(F.regexp_replace(norm, " ", ""))
        out = out.when(F.get(F.array(loose), F.lit(0))[low].isNotNull(), F.get(F.array(loose), F.lit(0))[low])
    return out.when(dev.isNotNull(), C.strip(F.regexp_replace(said, r"\s+", " "))).otherwise(text)


# -- header and title words -------------------------------------------------------------------------


def clean_header(text: Column) -> Column:
    """Lower case with underscores; centre is center; a word repeated at once stays once."""
    t = F.replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("centre"), F.lit("center"))
    once = lambda p: F.array_join(F.filter(F.transform(p, lambda w, i: F.when((i == 0) | (w != F.get(p, i - 1)), w)), lambda w: w.isNotNull()), "_")
    return M.bind(F.split(F.regexp_replace(t, "^_+|_+$", ""), "_"), once)


def clean_column_name(name: Column, keep: tuple[str, ...] = ()) -> Column:
    """At most four distinct plausible words and the fiscal years; null if nothing is left."""
    n = F.lower(name)
    vowels = lambda w: F.length(w) - F.length(F.regexp_replace(w, "[aeiou]", ""))
    plausible = lambda w: (F.length(w) >= 3) & (vowels(w) > 0) & (w.isin(*keep, "") | (vowels(w) >= 0.25 * F.length(w)))
    words = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(n, F.lit("([a-z]+)"), F.lit(1)), plausible)), 1, 4)
    years = F.transform(F.regexp_extract_all(n, F.lit(r"(\p{Nd}{4}[_-]\p{Nd}{2})"), F.lit(1)), lambda y: F.replace(y, F.lit("-"), F.lit("_")))
    made = F.array_join(F.concat(words, F.array_distinct(years)), "_")
    return (
        F.when(n.rlike("^(indicator|nfhs[0-9](_(urban|rural|total))?(_[0-9]+)?)$"), n).when(n.rlike(r"^s?l?[._\s]*no[._\s]*$"), "s_no")
        .when(n.rlike(r"^\p{Nd}{4}[_-]\p{Nd}{2}$"), F.replace(n, F.lit("-"), F.lit("_"))).when(made != "", made)
    )


def title_words(text: Column, limit: int = 18) -> Column:
    """English-looking words, consecutive repeats once."""

    def english(w: Column) -> Column:
        shape = lambda b: has_vowel(b) & (F.lower(b).isin(*SMALL_WORDS) | ((F.length(b) >= 3) & b.rlike("^([A-Z][a-z]+|[A-Z]+|[a-z]+)$")))
        return M.bind(bare(w), shape) & ~looks_soup(w, 1) & ~w.contains("`")

    def single(ws: Column) -> Column:
        return F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (F.lower(w) != F.lower(F.get(ws, i - 1))), w)), lambda w: w.isNotNull())

    return F.array_join(F.slice(M.bind(F.filter(C.words(text), english), single), 1, limit), " ")


def numbered_title(text: Column) -> Column:
    """"Table 1.2 words" of a text that says so; null otherwise."""
    rest = F.nullif(title_words(F.regexp_extract(text, TITLE, 4)), F.lit(""))
    name = F.concat_ws(" ", F.initcap(F.regexp_extract(text, TITLE, 1)), F.replace(F.regexp_extract(text, TITLE, 2), F.lit("-"), F.lit(".")), rest)
    return F.when(text.rlike(TITLE), name)


def without(pattern: str):
    """Cuts a pattern unless nothing would be left."""
    return lambda t: F.coalesce(F.nullif(C.strip(F.regexp_replace(t, pattern, "")), F.lit("")), t)


def plain_title(text: Column, least: float = 0.45) -> Column:
    """A line that reads like a title, without its prefix or enumerator; null otherwise."""

    def judged(x: Column) -> Column:
        line, said = x["line"], x["said"]
        ok = C.word_count(said).between(2, 16) & ~line.rlike(r"[.;]\s|[.;]$") & (F.length(said) >= least * F.length(line))
        return F.when(ok, F.when(said.rlike(r"(?i)\bIndicators?\b"), repair_state(said)).otherwise(said))

    line = M.bind(M.bind(C.strip(text), without(TITLE_PREFIX)), without(r"^\s*(\p{Nd}{1,2}|[A-Za-z])[.)]\s+"))
    return M.bind(M.bind(line, lambda x: F.struct(x.alias("line"), title_words(x, 16).alias("said"))), judged)


def repair_state(name: Column) -> Column:
    """A truncated state before "Key Indicators" is made whole."""
    states = F.array(*map(F.lit, STATES))
    short = F.create_map(*(F.lit(x) for p in STATE_FRAGMENTS.items() for x in p))

    def fixed(low: Column) -> Column:
        known = F.exists(states, lambda s: F.lower(s) == low)
        longer = F.get(F.filter(states, lambda s: F.lower(s).endswith(low) & (F.length(low) >= 3)), F.lit(0))
        return F.when(~known, F.concat(F.coalesce(F.try_element_at(short, low), longer), F.lit(" Key Indicators")))

    low = F.lower(C.strip(F.regexp_extract(name, r"(?i)^(.*?)\s*(Key\s+)?Indicators\b", 1)))
    return F.coalesce(F.when(name.rlike(r"(?i)Indicators\b"), M.bind(low, fixed)), name)


def slug(name: Column, limit: int = 42) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def eta(seconds: Column) -> Column:
    """Xm YYs."""
    return F.format_string("%dm %02ds", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))
