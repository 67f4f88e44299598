"""Normalisation, phonetics and n-grams of place names.

Column expressions where Spark has the operations; pandas UDFs over pure functions where Unicode
decomposition or phonetic rules are needed.
"""

from __future__ import annotations

import tomllib
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded by the Nordic ASCII form.
NORDIC = ("åäæöøÅÄÆÖØ", "aaaooAAAOO")
#: Latin letters without a decomposition.
SPECIAL = {"æ": "a", "Æ": "a", "œ": "o", "Œ": "o", "ø": "o", "Ø": "o", "ß": "s", "ð": "d", "Ð": "d", "þ": "t", "Þ": "t", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d"}
#: Code points of Latin letters.
LATIN = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F))
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}


def base(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def nordic_ascii(text: Column) -> Column:
    """å, ä, æ as a; ö, ø as o."""
    return F.translate(text, *NORDIC)


def half_width(text: Column) -> Column:
    """Full-width ASCII as ASCII."""
    wide = "".join(map(chr, _WIDE))
    return F.translate(text, wide, "".join(chr(x) for x in _WIDE.values()))


def tokens(text: Column) -> Column:
    """Words between spaces."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def without(words: Column, stop: Iterable[str]) -> Column:
    """Words that are not stop words; all of them if none would stay."""
    listed = F.array(*map(F.lit, stop)).cast("array<string>")
    kept = F.filter(words, lambda t: ~F.array_contains(listed, t))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def trigrams(text: Column) -> Column:
    """Sorted distinct three-letter pieces of each word between its marks ^ and $."""
    marked = F.transform(tokens(text), lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    pieces = F.transform(marked, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(pieces)))


def core_name(text: Column) -> Column:
    """What stands before the first comma or bracket, null if there is neither."""
    head = F.trim(F.regexp_extract(text, r"^([^,(]*)[,(]", 1))
    return F.when(head != "", head)


def punctuation(text: Column) -> Column:
    """Slashes, semicolons and bars as spaces, commas followed by one space, empty parts dropped."""
    parts = F.transform(F.split(F.translate(text, "/;|", "   "), ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def deletions(word: Column) -> Column:
    """A word and all its forms with one letter left out."""
    n = F.length(word)
    short = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n > 0, short).otherwise(F.array().cast("array<string>"))))


def deletions_twice(word: Column) -> Column:
    """A word and all its forms with one or two letters left out."""
    return F.array_distinct(F.flatten(F.transform(deletions(word), deletions)))


def title_case(text: Column) -> Column:
    """Words with a capital and small letters behind it, one space apart."""
    one = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(F.transform(tokens(text), one), " ")


def bilingual_parts(name: Column) -> Column:
    """Parts of a name in lower case between " / ", " - " or "/", other than the whole."""
    lower = F.lower(name)
    pieces = F.flatten(F.array(*[F.when(F.instr(lower, F.lit(sep)) > 0, F.split(lower, sep)).otherwise(F.array().cast("array<string>")) for sep in (" / ", " - ", "/")]))
    return F.array_distinct(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: (p != "") & (p != lower)))


def mistyped(name: Column, seed: Column) -> Column:
    """A name with one typing error drawn from ``seed``: a letter left out, two neighbours swapped, or one replaced."""
    n = F.length(name)
    draw = lambda salt, below: F.pmod(F.xxhash64(seed, F.lit(salt)), below)
    at = (draw("at", n) + 1).cast("int")
    first = (draw("first", F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    upto = lambda i: F.substring(name, F.lit(1), i)
    behind = lambda i: F.substring(name, i, n)
    letter = F.char(97 + draw("letter", F.lit(26)))
    swapped = F.concat(upto(first - 1), F.substring(name, first + 1, F.lit(1)), F.substring(name, first, F.lit(1)), behind(first + 2))
    made = F.when(draw("how", F.lit(3)) == 0, F.concat(upto(at - 1), behind(at + 1))).when(draw("how", F.lit(3)) == 1, swapped).otherwise(F.concat(upto(at - 1), letter, behind(at + 1)))
    return F.when(n <= 1, name).otherwise(made)


def strip_marks(text: str) -> str:
    """Without combining marks, composed again."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")))


def universal_ascii(text: str) -> str | None:
    """Latin letters without their marks; None if the text has letters of another script."""
    if any(c.isalpha() and not any(a <= ord(c) <= b for a, b in LATIN) for c in text):
        return None
    plain = (c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return "".join(SPECIAL.get(c, c) for c in plain)


def swedish_key(text: str) -> str:
    """Phonetic key: soft and hard consonants told apart, vowels only at the start, doubles once."""
    letters = text.translate(str.maketrans(*NORDIC))
    out: list[str] = []
    skip = False
    for here, after in zip(letters, [*letters[1:], ""]):
        if skip:
            skip = False
        elif here in "aeiouy":
            if not out:
                out.append("A")
        elif here in "kts" and after == "j":
            out.append("X")
            skip = True
        elif here in "cg":
            soft = bool(after) and after in "eiy"
            out.append({"c": "KS", "g": "KJ"}[here][soft])
        elif here in "zw":
            out.append("SV"["zw".index(here)])
        elif here == " ":
            out.append(" ")
        elif here != "h" and here.isalpha():
            out.append(here.upper() if here.isascii() else here)
            skip = here == after
    return "".join(out)


def cologne_word(word: str) -> str:
    """Cologne phonetics of one word, from Postel's published rules."""
    w = word.upper().replace("Ä", "A").replace("Ö", "O").replace("Ü", "U").replace("ß", "SS").replace("SS", "SS")
    w = [c for c in w if "A" <= c <= "Z"]
    codes = []
    for i, c in enumerate(w):
        before, after = (w[i - 1] if i else ""), (w[i + 1] if i + 1 < len(w) else "")
        if c in "AEIJOUY":
            code = "0"
        elif c == "H":
            code = ""
        elif c == "B" or (c == "P" and after != "H"):
            code = "1"
        elif c in "DT":
            code = "8" if after and after in "CSZ" else "2"
        elif c in "FVWP":
            code = "3"
        elif c in "GKQ":
            code = "4"
        elif c == "C":
            follows = "AHKLOQRUX" if i == 0 else "AHKOQUX"
            hard = bool(after) and after in follows and not (before and before in "SZ")
            code = "4" if hard else "8"
        elif c == "X":
            code = "8" if before and before in "CKQ" else "48"
        elif c == "L":
            code = "5"
        elif c in "MN":
            code = "6"
        elif c == "R":
            code = "7"
        else:
            code = "8"
        codes.append(code)
    whole = "".join(codes)
    single = "".join(c for i, c in enumerate(whole) if i == 0 or c != whole[i - 1])
    return single[:1] + single[1:].replace("0", "")


def cologne_key(text: str) -> str:
    """Cologne phonetics of all words."""
    return " ".join(map(cologne_word, text.split()))


def boundary_variants(text: str) -> list[str]:
    """Each gap between words once as a hyphen and once closed; hyphens open and closed."""
    out: list[str] = []
    words = text.split()
    for i in range(len(words) - 1):
        for glue in ("-", ""):
            out.append(" ".join([*words[:i], words[i] + glue + words[i + 1], *words[i + 2 :]]))
    for i, c in enumerate(text):
        if c == "-":
            out += [text[:i] + " " + text[i + 1 :], text[:i] + text[i + 1 :]]
    return list(dict.fromkeys(x for x in out if x != text))


@dataclass(frozen=True)
class Language:
    """Normaliser settings of one language."""

    engine: str = "swedish"
    strip_combining_marks: bool = False
    fullwidth_to_halfwidth: bool = False
    abbreviations: dict[str, str] = field(default_factory=dict)
    stopwords: tuple[str, ...] = ()
    known_variants: dict[str, str] = field(default_factory=dict)
    case_suffixes: tuple[str, ...] = ()
    definite_suffixes: tuple[str, ...] = ()
    diacritics: dict[str, str] = field(default_factory=dict)
    char_equivalences: dict[str, str] = field(default_factory=dict)
    suffix_abbreviations: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_toml(cls, text: str) -> Language:
        """Settings from a configuration text with the sections of the normaliser contract."""
        c = tomllib.loads(text)
        phonetic = c.get("phonetic", {})
        suffixes = lambda k: tuple(sorted(c.get(k, {}).get("suffixes", ()), key=lambda s: (-len(s), s)))
        return cls(
            engine=phonetic.get("engine", "swedish"),
            strip_combining_marks=phonetic.get("strip_combining_marks", False),
            fullwidth_to_halfwidth=phonetic.get("fullwidth_to_halfwidth", False),
            abbreviations=c.get("abbreviations") or SWEDISH.abbreviations,
            stopwords=tuple(c.get("stopwords", {}).get("words", ())) or SWEDISH.stopwords,
            known_variants=c.get("known_variants", {}),
            case_suffixes=suffixes("case_suffixes"),
            definite_suffixes=suffixes("definite_suffixes"),
            diacritics=c.get("diacritics", {}),
            char_equivalences=c.get("char_equivalences", {}),
            suffix_abbreviations=c.get("suffix_abbreviations", {}),
        )

    def base(self, text: str) -> str:
        """Composed, lower case, single spaces."""
        s = unicodedata.normalize("NFC", text)
        if self.strip_combining_marks:
            s = strip_marks(s)
        if self.fullwidth_to_halfwidth:
            s = s.translate(_WIDE)
        return " ".join(s.lower().split())

    def _stripped(self, text: str) -> str:
        kept = [w for w in text.split() if w not in self.stopwords]
        return " ".join(kept) if kept else text

    def _expanded(self, text: str) -> str:
        return " ".join(self.abbreviations.get(w, self.abbreviations.get(w.rstrip("."), w)) for w in text.split())

    def _suffixed(self, text: str) -> str:
        rules = sorted(self.suffix_abbreviations.items(), key=lambda kv: (-len(kv[0]), kv[0]))
        done = []
        for w in text.split():
            for short, long in rules:
                if w.endswith(short) and len(w.encode()) - len(short.encode()) >= 4:
                    w = w[: -len(short)] + long
                    break
            done.append(w)
        return " ".join(done)

    def _uncased(self, text: str) -> str:
        if " " not in text:
            for s in self.case_suffixes:
                if text.endswith(s) and len(text.encode()) - len(s.encode()) >= 3:
                    return text[: -len(s)]
        return text

    def candidates(self, text: str) -> list[str]:
        """Ordered distinct forms under which a name is indexed."""
        out: list[str] = []

        def add(form: str | None) -> None:
            if form and form not in out:
                out.append(form)

        lowered = text.lower().strip()
        add(self.known_variants.get(lowered))
        b = self.base(text)
        add(b)
        add(self._stripped(b))
        expanded = self._expanded(b)
        if expanded != b:
            add(expanded)
            add(self._stripped(expanded))
        add(self._suffixed(b))
        cut = min((i for i in (text.find(","), text.find("(")) if i >= 0), default=-1)
        if cut > 0 and text[:cut].strip():
            core = self.base(text[:cut])
            add(core)
            add(self.known_variants.get(core))
        uncased = self._uncased(b)
        if uncased != b:
            add(self.known_variants.get(uncased))
            add(uncased)
        # sorted, so that the order of forms never depends on a table's
        for a, z in sorted(self.char_equivalences.items()):
            for form in list(out):
                add(form.replace(a, z))
                add(form.replace(z, a))
        for form in list(out):
            if self.diacritics:
                plain = form
                for a, z in sorted(self.diacritics.items(), key=lambda kv: (-len(kv[0]), kv[0])):
                    plain = plain.replace(a, z)
                add(plain)
            else:
                add(form.translate(str.maketrans(*NORDIC)))
        for form in list(out):
            add(universal_ascii(form))
        return out

    def query_candidates(self, text: str) -> list[str]:
        """The index forms and those that only queries try."""
        out = self.candidates(text)

        def add(form: str) -> None:
            if form and form not in out:
                out.append(form)

        b = self.base(text)
        words = b.split()
        if len(words) > 1 and len(words[-1]) == 1 and words[-1].isalpha():
            add(" ".join(words[:-1]))
        for i, w in enumerate(words):
            for s in self.definite_suffixes:
                if w.endswith(s) and len(w.encode()) - len(s.encode()) >= 4:
                    add(" ".join([*words[:i], w[: -len(s)], *words[i + 1 :]]))
        for form in boundary_variants(b)[:16]:
            add(form)
        if len(words) == 2:
            add(f"{words[1]} {words[0]}")
        return out

    def phonetic(self, text: str) -> str:
        """Phonetic key by the language's engine."""
        b = self.base(text)
        if self.engine in ("cologne", "koelner"):
            return cologne_key(b)
        return b if self.engine == "none" else swedish_key(b)


#: The default language's abbreviations and stop words.
SWEDISH = Language(
    abbreviations={"st": "sankt", "s:t": "sankt", "s:ta": "sankta", "n": "norra", "s": "södra", "v": "västra", "ö": "östra", "g": "gamla", "k": "kungliga"},
    stopwords=("kommun", "stad", "län", "tätort", "socken", "församling", "distrikt"),
)


def _mapped(result: str, function: Callable[[str], object]):
    @F.pandas_udf(result)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return run


def normalize_udf(language: Language = SWEDISH):
    """Index forms of a name as array<string>."""
    return _mapped("array<string>", language.candidates)


def normalize_query_udf(language: Language = SWEDISH):
    """Query forms of a name as array<string>."""
    return _mapped("array<string>", language.query_candidates)


def phonetic_udf(language: Language = SWEDISH):
    """Phonetic key of a name."""
    return _mapped("string", language.phonetic)


def universal_ascii_udf():
    """Latin names without marks, null for other scripts."""
    return _mapped("string", universal_ascii)
