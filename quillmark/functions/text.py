"""Column functions that clean and normalise text. All are Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.tokens import let

# Character tables and patterns of the cleaning contract.
OLD_LETTERS = "ѣѢіІїЇѳѲѵѴ"
NEW_LETTERS = "еЕиИиИфФиИ"
DASHES = "[‐‑‒–—―−﹘﹣－]"
QUOTES = "[«»„“”‟‹›]"
GARBAGE = r"[^а-яА-Яa-zA-Z0-9\s\.,;:!?—\-\"@]"
WIKI_RESIDUE = r"__[A-ZА-Я]+__|Страницы\s+с[^\n]*|Литература\s+\d{3,4}\s+года|(?:Категория|Category|Импорт)\s*:?\s*\S[^\n]*|(?:az\.)?lib\.ru\S*"
TEMPLATES = None  # the place of `drop_templates` among the rules
WIKITEXT_RULES = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<ref[^>/]*>.*?</ref>", ""),
    (r"(?i)<ref[^>]*/>", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"__[A-ZА-Я]+__", ""),
    (r"(?i)\[\[(?:Категория|Category|Файл|File|Image|Изображение|[a-z]{2,3}):[^\]]*\]\]", ""),
    TEMPLATES,
    (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
    (r"\[\[([^\]]*)\]\]", "$1"),
    (r"\[https?://\S+\s+([^\]]*)\]", "$1"),
    (r"\[https?://\S+\]", ""),
    (r"<[^>]+>", ""),
    (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"),
    (r"'{2,}", ""),
    (r"(?m)^[*#:;]+\s*", ""),
    (r"\n{3,}", "\n\n"),
)


def strip_wiki_residue(text: Column) -> Column:
    return F.regexp_replace(text, WIKI_RESIDUE, " ")


def normalise_dashes(text: Column) -> Column:
    """Every dash is an em dash between single spaces."""
    one = F.regexp_replace(F.regexp_replace(text, DASHES, "—"), "--", "—")
    return F.regexp_replace(one, r"(?U)\s*—\s*", " — ")


def fold_yo(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def modern_letters(text: Column) -> Column:
    """Letters of the old orthography, then the hard sign at a word's end."""
    return F.regexp_replace(F.translate(text, OLD_LETTERS, NEW_LETTERS), "ъ(?![а-яёА-ЯЁ])", "")


def old_orthography_share(text: Column, probe: int | None = None) -> Column:
    """Share of old letters in the whole text, or among its first `probe` characters (as the detector below defines it)."""
    head = F.substring(text, 1, probe) if probe else text
    return F.when(F.length(head) > 0, (F.length(head) - F.length(F.regexp_replace(head, "[ѣѢіІѳѲѵѴ]", ""))) / F.length(head)).otherwise(F.lit(0.0))


def is_old_orthography(text: Column, probe: int = 20_000, least: float = 0.002) -> Column:
    return old_orthography_share(text, probe) > least


def unify_quotes(text: Column) -> Column:
    return F.regexp_replace(text, QUOTES, '"')


def keep_allowed(text: Column) -> Column:
    """Letters, digits and plain marks stay; other characters are spaces; runs of space are one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, GARBAGE, " "), r"(?U)\s+", " "))


def mask_entities(text: Column, entities: Column | None = None, label: str = "PER", mark: str = " @ ") -> Column:
    """Entities (array of start, end, label; end exclusive, not overlapping) under a mark. Without annotations: runs of capitalised
    words that do not start a sentence, a rule and no recogniser."""
    if entities is None:
        return F.regexp_replace(text, r"(?U)(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*", mark)
    chosen = F.array_sort(F.filter(entities, lambda e: e["label"] == label))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        chosen,
        start,
        lambda acc, e: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), F.lit(mark)).alias("out"), e["end"].cast("int").alias("at")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def clean(text: Column, entities: Column | None = None) -> Column:
    """The whole cleaning chain."""
    steps = (strip_wiki_residue, normalise_dashes, lambda t: mask_entities(t, entities), fold_yo, modern_letters, unify_quotes, keep_allowed)
    return reduce(lambda t, f: f(t), steps, text)


def drop_templates(text: Column) -> Column:
    """Text outside {{...}}, nested to any depth: innermost pairs go, as often as braces are deep. Without a partner, closing braces
    go, opening ones take the rest of the text along. Each pair of braces is one sign first (code points that are no characters),
    so what is left of a template makes no new braces."""
    opening, closing = "\ufdd0", "\ufdd1"

    def without(marked: Column) -> Column:
        signs = F.regexp_extract_all(marked, F.lit(f"([{opening}{closing}])"), F.lit(1))

        def level(s: Column, sign: Column) -> Column:
            now = F.when(sign == opening, s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0)))
            return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

        depth = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), level, lambda s: s["most"])
        rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
        flat = F.aggregate(rounds, marked, lambda t, _: F.regexp_replace(t, f"{opening}[^{opening}{closing}]*+{closing}", ""))
        return F.translate(F.substring_index(flat, opening, 1), closing, "")

    return let(F.replace(F.replace(text, F.lit("{{"), F.lit(opening)), F.lit("}}"), F.lit(closing)), without)


def wikitext_plain(text: Column) -> Column:
    return F.trim(reduce(lambda t, rule: drop_templates(t) if rule is TEMPLATES else F.regexp_replace(t, *rule), WIKITEXT_RULES, text))


def historical_word(word: Column) -> Column:
    """A word's form for alignment: old letters, lower case, no final hard sign after a Cyrillic letter."""
    low = F.lower(F.translate(word, "ёЁ" + OLD_LETTERS, "еЕ" + NEW_LETTERS))
    return F.regexp_replace(low, "([а-яѣіѳѵ])ъ$", "$1")


def drop_doubled(text: Column, least: int = 200, probe: int = 40) -> Column:
    """A text that starts over in its middle half loses the second copy; words are then joined by single spaces."""

    def first_copy(words: Column) -> Column:
        n = F.size(words)
        first = F.greatest(F.lit(probe), F.floor(n / 4).cast("int"))
        last = F.floor(3 * n / 4).cast("int") - 1
        places = F.when((n >= least) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        head = F.slice(words, 1, probe)
        found = F.filter(places, lambda i: F.when(F.element_at(words, i + 1) == F.element_at(words, 1), F.slice(words, i + 1, probe) == head).otherwise(F.lit(False)))
        return F.when(F.size(found) > 0, F.array_join(F.slice(words, 1, F.greatest(F.element_at(found, 1), F.lit(1))), " ")).otherwise(text)

    return let(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), first_copy)


def repair_literal(text: Column, old: str, new: str) -> Column:
    """Replaces the one place where `old` occurs; fails a row where it does not occur just once."""
    times = F.size(F.split(text, F.lit("\\Q" + old + "\\E"), -1)) - 1
    return F.when(times == 1, F.replace(text, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit("expected one occurrence, found "), times.cast("string"))))


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines start..end-1, from 0."""
    return F.array_join(F.slice(F.split(text, "\n"), start + 1, end - start), "\n")


def canonical_violations(text: Column) -> Column:
    """Names of the rules of canonical text that are broken: one final line feed, no CR or tab, no space at edges or line ends, no
    two blank lines together, no control characters."""
    body = F.regexp_replace(text, r"\n\z", "")
    rules = {
        "empty": F.coalesce(F.length(text) == 0, F.lit(True)),
        "final_lf": ~text.endswith("\n") | text.endswith("\n\n"),
        "cr": text.contains("\r"),
        "tab": text.contains("\t"),
        "edge_space": body.rlike(r"(?U)\A\s|\s\z"),
        "line_end_space": body.rlike(r"(?Um)[^\S\n]+$"),
        "blank_lines": body.contains("\n\n\n"),
        "control": text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"),
    }
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
