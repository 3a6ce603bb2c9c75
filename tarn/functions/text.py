"""Column functions on text: counting, normal forms, identifiers and simple recognisers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a latin word.
LATIN_WORD = r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?"
CJK = r"[一-鿿]"
#: Neither letter, digit, underscore nor white space, in any script.
PUNCTUATION = r"[^\p{L}\p{N}_\s]"
#: Words that token sets leave out.
STOP_WORDS = ("a", "an", "and", "for", "in", "is", "of", "the", "to", "what")
SEP = "\x1f"


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def token_count(text: Column) -> Column:
    """CJK characters, latin words and punctuation marks; at least 1."""
    return F.greatest(F.lit(1), count(text, CJK) + count(text, LATIN_WORD) + count(text, PUNCTUATION)).cast("long")


def word_count(text: Column) -> Column:
    return count(text, r"\S+").cast("long")


def language(text: Column) -> Column:
    """zh if CJK characters are at least as many as latin words (so also with neither), else en."""
    return F.when(count(text, CJK) >= count(text, r"[A-Za-z]+"), "zh").otherwise("en")


def title(text: Column, fallback: Column) -> Column:
    """The first level-1 heading of a markdown text, else ``fallback``."""
    found = F.regexp_extract(text, r"(?m)^\s*#\s+(.+?)\s*$", 1)
    return F.when(found != "", found).otherwise(fallback)


def squash(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_term(text: Column) -> Column:
    return squash(F.translate(F.lower(text), "_", " "))


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters beyond ASCII whose folded form is another, by Unicode's rules: to one letter, and to several."""
    letters = [c for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c]
    return {c: c.casefold() for c in letters if len(c.casefold()) == 1}, {c: c.casefold() for c in letters if len(c.casefold()) > 1}


ONE_LETTER, SEVERAL_LETTERS = _folds()


def folded(text: Column) -> Column:
    """Folded case for comparing, and blanks made one: every letter in its folded form, also where that isn't its lower case (ß is ss)."""
    one = F.translate(F.lower(text), "".join(ONE_LETTER), "".join(ONE_LETTER.values()))
    letters = F.filter(F.split(one, ""), lambda c: c != "")
    spelled = F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SEVERAL_LETTERS.items() for x in p]), c), c)), "")
    out = F.when(one.rlike(f"[{''.join(SEVERAL_LETTERS)}]"), spelled).otherwise(one)
    return squash(out)


def document_key(uri: Column) -> Column:
    """Letters and digits of a file's base name, without query, fragment and suffix."""
    path = F.regexp_replace(uri, r"[?#].*$", "")
    name = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def words(text: Column) -> Column:
    """All runs of ASCII letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.array_except(F.array_distinct(words(text)), F.array(*map(F.lit, stop_words)))


def column_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def preview(text: Column, limit: int = 320) -> Column:
    whole = squash(text)
    return F.when(F.length(whole) > limit, F.concat(F.rtrim(F.left(whole, F.lit(limit - 3))), F.lit("..."))).otherwise(whole)


def has_phrase(text: Column, phrase: Column) -> Column:
    """``phrase`` stands in ``text`` and touches no letter or digit on either side; both in normal form."""
    quoted = F.regexp_replace(phrase, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.contains(text, phrase) & F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))


def years(text: Column) -> Column:
    """Years from 1900 to 2099, also behind FY, in order of their first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FY)?((?:19|20)\d{2})\b"), F.lit(1)))


def period_names(text: Column) -> Column:
    """Years as they are named: FY2023 where the text holds it so, else 2023."""
    return F.transform(years(text), lambda y: F.when(F.contains(F.lower(text), F.concat(F.lit("fy"), y)), F.concat(F.lit("FY"), y)).otherwise(y))


#: Names with a corporate suffix, and tickers behind an exchange.
SUFFIXED = (
    r"\b([A-Z][A-Za-z0-9&.'-]*(?:\s+[A-Z][A-Za-z0-9&.'-]*){0,5}\s+"
    r"(?:Inc\.?|Corp\.?|Corporation|Company|Co\.?|Ltd\.?|Limited|LLC|PLC|Holdings|Group|Technologies|Technology))\b"
)
TICKER = r"\b(?:NASDAQ|NYSE|AMEX|LON|TSX)\s*:\s*([A-Z]{1,6})\b"
#: Companies and other names that stand for them.
COMPANIES = {
    "3M": ("3m", "mmm"), "AES Corporation": ("aes corporation", "aes"), "AMCOR": ("amcor",), "Adobe": ("adobe", "adbe"), "Apple": ("apple", "aapl"),
    "Amazon": ("amazon", "amzn"), "Alphabet": ("alphabet", "google", "goog", "googl"), "Boeing": ("boeing",), "Chevron": ("chevron", "cvx"), "Coca-Cola": ("coca-cola", "coca cola"),
    "Costco": ("costco",), "Exxon Mobil": ("exxon", "exxon mobil", "exxonmobil"), "Ford": ("ford", "ford motor"), "General Motors": ("general motors", "gm"), "Home Depot": ("home depot",),
    "IBM": ("ibm", "international business machines"), "Johnson & Johnson": ("johnson & johnson", "johnson and johnson", "jnj"), "JPMorgan": ("jpmorgan", "jp morgan", "jpmorgan chase"),
    "Microsoft": ("microsoft", "msft"), "NVIDIA": ("nvidia", "nvda"), "Oracle": ("oracle",), "Pfizer": ("pfizer",), "Salesforce": ("salesforce",), "Target": ("target",),
    "Tesla": ("tesla", "tsla"), "Verizon": ("verizon",), "Walmart": ("walmart", "wal-mart"),
}


def companies(text: Column, known: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Companies that a text names, each once: names with a corporate suffix, tickers behind an exchange, and known names."""
    plain = normal_term(text)
    names = COMPANIES if known is None else known
    hit = lambda aliases: F.exists(F.array(*map(F.lit, aliases)), lambda a: has_phrase(plain, a))
    listed = F.array_compact(F.array(*[F.when(hit(a), name) for name, a in names.items()]))
    suffixed = F.transform(F.regexp_extract_all(text, F.lit(SUFFIXED), F.lit(1)), lambda n: F.btrim(n, F.lit(" .,?;:")))
    return F.array_distinct(F.concat(suffixed, F.regexp_extract_all(text, F.lit(TICKER), F.lit(1)), listed))


def quarter(text: Column) -> Column:
    """Q1 to Q4 from forms such as "Q3", "3Q", "third quarter" or "3rd quarter"; null without any."""
    t = F.lower(text)
    found = None
    for n, (name, short) in enumerate((("first", "1st"), ("second", "2nd"), ("third", "3rd"), ("fourth", "4th")), 1):
        hit = t.rlike(rf"\b(?:q{n}|{n}q|(?:{name}|{short}) quarter)\b")
        found = F.when(hit, f"Q{n}") if found is None else found.when(hit, f"Q{n}")
    return found


def citations(text: Column, any_case: bool = False) -> Column:
    """Ids in marks such as [c12], in order of their first use; with ``any_case``, as a critic reads them, [C12] is a mark of c12 too."""
    if any_case:
        return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([cC]\d+)\]"), F.lit(1)), F.lower))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(c\d+)\]"), F.lit(1)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def coverage_aliases(value: Column) -> Column:
    """Forms in which a plan's term may stand in a text: with blanks for underscores, singular and plural."""
    base = normal_term(value)
    other = F.when(base.endswith("s"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(F.concat(base, F.lit("s")))
    return F.array_distinct(F.array(base, other))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 32 hex digits of the parts' SHA-256; null parts count as empty."""
    joined = F.concat_ws(SEP, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(joined, 256), F.lit(32)))
