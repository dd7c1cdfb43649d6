"""Text functions as columns: folding, stemming, tokens, phrases, dates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry intent and not content (folded), in one list.
STOP = """pokaz pokazac podaj jaka jaki jakie jak ile czy gdzie kiedy co ktory ktora ktore wymien opisz
jest sa byc ma maja moze mozna w we z ze na do od za o u i oraz lub a the of dla przy po pod nad bez przez
temat informacje informacja""".split()
# Inflectional endings.
SUFFIXES = """iajacych iajacego ajacych ajacego iajacy iajace ajacy ajace owych owego iach ami ach emu ego ych ymi
owe owa owi ow em ie ia ym ej y a e i u o""".split()
# Openings of questions, in order of trial.
PREFIXES = [
    "pokaz mi", "pokaz", "pokaż mi", "pokaż", "podaj mi", "podaj", "jaka jest", "jaki jest", "jakie sa", "jakie są", "jaka", "jaki", "jakie",
    "ile kosztuje", "ile kosztuj", "ile kosztuja", "ile kosztują", "ile", "czy", "gdzie", "kiedy", "wymien", "wymień", "opisz", "co to jest", "co to",
    "informacje na temat", "informacje o", "informacja o", "what is", "what are", "show me", "show", "how much", "list",
]
# A filler before the subject, and what is cut off a phrase.
FILLER = r"(?i)^\s*(?:pokaz|pokaż|podaj|wymien|wymień|opisz)?\s*(?:informacje|informacja)\s+(?:na\s+temat|o)\s+"
TRIM = " ?.,:"


def _fold_table() -> tuple[str, str]:
    """Latin letters whose decomposition is a base letter and marks, and marks, which go."""
    pairs = {"ł": "l", "Ł": "L"}
    gone = ""
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x300, 0x370)]):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            pairs[c] = bare
        elif not bare:
            gone += c
    return "".join(pairs) + gone, "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()
STEM = "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$"


def fold(c: Column) -> Column:
    """Letters without their marks; plain ASCII is left as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, FOLD_FROM, FOLD_TO))


def stem(w: Column) -> Column:
    """A word of over four characters, not a number, without its longest ending that leaves four."""
    return F.when((F.char_length(w) <= 4) | w.rlike("^[0-9]+$"), w).otherwise(F.regexp_replace(w, STEM, "$1"))


def stem_sources(t: Column) -> Column:
    """array<string>: the words that `stem` makes the term `t` of: there are no others, for it cuts one ending off at most."""
    longer = F.transform(F.array(*(F.lit(x) for x in ["", *SUFFIXES])), lambda x: F.concat(t, x))
    return F.filter(longer, lambda w: stem(w) == t)


def tokenise(c: Column, drop_stop: bool = True, stemmed: bool = True) -> Column:
    """array<string>: lower, fold, words, without stop words and single characters, stemmed."""
    words = F.regexp_extract_all(fold(F.lower(c)), F.lit("[0-9a-z]+"), F.lit(0))
    keep = lambda w: (F.char_length(w) >= 2) & (~w.isin(STOP) if drop_stop else F.lit(True))
    kept = F.filter(words, keep)
    return F.transform(kept, stem) if stemmed else kept


def cite_tokens(c: Column) -> Column:
    """array<string>: fold, then lower; all words."""
    return F.regexp_extract_all(F.lower(fold(c)), F.lit("[0-9a-z]+"), F.lit(0))


def noun_phrase(q: Column) -> Column:
    """The question without its opening; '' if nothing is taken away."""
    s = F.regexp_replace(q, FILLER, "")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    low = F.lower(s)
    cut = F.coalesce(*[F.when(F.startswith(low, F.lit(p + " ")), F.btrim(F.substring(s, len(p) + 1, 1 << 30), F.lit(TRIM))) for p in PREFIXES], s)
    cut = F.btrim(cut, F.lit(TRIM))
    same = F.lower(cut) == F.lower(F.btrim(q, F.lit(TRIM)))
    return F.when((cut != "") & ~same, cut).otherwise(F.lit(""))


def query_variants(q: Column) -> Column:
    """array<string>: the question, and its noun phrase if that has three characters."""
    np = noun_phrase(q)
    return F.filter(F.array(F.regexp_replace(q, r"^\s+|\s+$", ""), F.when(F.char_length(np) >= 3, np)), lambda x: x.isNotNull())


def revision(c: Column) -> Column:
    """yyyy-mm-dd of the document number, or else of the first date in the first 400 characters."""
    date = r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})"

    def of(x, p):
        d, m, y = (F.regexp_extract(x, p, i) for i in (1, 2, 3))
        return F.when(y != "", F.concat_ws("-", y, m, d))

    return F.coalesce(of(c, "CBG/PL-PLN/" + date), of(F.substring(c, 1, 400), date))


def flat(c: Column) -> Column:
    """Soft hyphens gone, white space single, small letters."""
    s = F.translate(F.translate(c, "­", ""), " ", " ")
    return F.lower(F.btrim(F.regexp_replace(s, r"\s+", " ")))
