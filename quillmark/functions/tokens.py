"""Tokens, n-grams, shingles and chunks as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
HYPHEN_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}_])?"
JOINED_WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
PUNCTUATION = r"[\p{P}\p{S}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: a lambda's free expressions are computed anew for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def words(text: Column) -> Column:
    """Lower-cased Unicode words; words of one character count."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def alpha_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"^\p{L}+$"))


def hyphen_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(HYPHEN_WORD), F.lit(0))


def joined_words(text: Column) -> Column:
    """Words with inner hyphens and apostrophes, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(JOINED_WORD), F.lit(0))


def space_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces that end in a run of . ! ? or …, or at a line feed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?…\n]+[.!?…]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(tokens: Column, low: int, high: int | None = None) -> Column:
    """All n-grams for n in low..high, joined by one space, shortest first."""

    def of(ts: Column, n: int) -> Column:
        count = F.size(ts) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(ts, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda ts: F.flatten(F.array(*(of(ts, n) for n in range(low, (high or low) + 1)))))


def char_ngrams(text: Column, low: int, high: int | None = None) -> Column:
    """All substrings of low..high characters, after runs of space became one. A substring of characters is found by counting from
    the text's start, so the text is split into characters once and slices are joined."""

    def of(chars: Column, n: int) -> Column:
        count = F.size(chars) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, n), ""))).otherwise(F.array().cast("array<string>"))

    chars = F.regexp_extract_all(F.regexp_replace(text, r"(?U)\s\s+", " "), F.lit("(?s)."), F.lit(0))
    return let(chars, lambda cs: F.flatten(F.array(*(of(cs, n) for n in range(low, (high or low) + 1)))))


def char_ngrams_in_words(text: Column, low: int, high: int | None = None) -> Column:
    """Substrings of each word between single spaces; a padded word no longer than n stands once, and then for no larger n."""
    padded = F.transform(space_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        # the first n that a word does not exceed takes it whole; larger n skip it
        usable = F.filter(padded, lambda w: F.length(w) >= n) if n > low else padded
        return F.flatten(F.transform(usable, lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))))

    return F.flatten(F.array(*(of(n) for n in range(low, (high or low) + 1))))


def punctuation_string(text: Column) -> Column:
    """Marks alone, dashes as one glyph, joined by spaces."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PUNCTUATION), F.lit(0)), lambda p: F.translate(p, "–―-", "———")), " ")


def pos_string(tokens: Column) -> Column:
    """Parts of speech of annotated tokens, without white space."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~t["is_space"]), lambda t: t["pos"]), " ")


def bleach(tokens: Column, markers: dict[str, str]) -> Column:
    """Numbers and marked parts of speech become markers, other words lower case, marks stay, the rest goes."""
    number = markers.get("NUM", "%")

    def form(t: Column) -> Column:
        case = F.when((t["pos"] == "NUM") | t["like_num"], F.lit(number))
        for pos, mark in markers.items():
            if pos != "NUM":
                case = case.when(t["pos"] == pos, F.lit(mark))
        return case.when(t["is_alpha"], F.lower(t["text"])).when(t["is_punct"], t["text"])

    return F.array_join(F.filter(F.transform(tokens, form), lambda x: x.isNotNull()), " ")


def word_windows(text: Column, size: int, keep_tail: bool = True) -> Column:
    """Windows of `size` words next to each other; a text of at most `size` words is one chunk as it stands."""
    none = F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        n = F.size(w)
        count = F.ceil(n / size) if keep_tail else F.floor(n / size)
        parts = F.transform(F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))
        if keep_tail:
            return F.when(n == 0, none).when(n <= size, F.array(text)).otherwise(parts)
        return F.when(n < size, none).otherwise(parts)

    return let(space_words(text), cut)


def packed_sentences(sents: Column, sizes: Column, size: int, least: int) -> Column:
    """Sentences packed in order up to `size` tokens a chunk; a longer sentence is a chunk of its own; shorter chunks than `least` go,
    unless they are one long sentence. For chunks without overlap."""
    start = F.struct(F.array().cast("array<struct<text:string,n:int>>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        fits = (acc["n"] + s["n"] <= size) | (acc["n"] == 0)
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n")))))
        text = F.when(fits & (acc["n"] > 0), F.concat_ws(" ", acc["text"], s["text"])).otherwise(s["text"])
        return F.struct(done.alias("done"), text.alias("text"), F.when(fits, acc["n"] + s["n"]).otherwise(s["n"]).alias("n"))

    pairs = F.filter(F.zip_with(sents, sizes, lambda t, n: F.struct(t.alias("text"), n.cast("int").alias("n"))), lambda s: s["n"] > 0)
    folded = F.aggregate(pairs, start, add)
    chunks = F.concat(folded["done"], F.array(F.struct(folded["text"].alias("text"), folded["n"].alias("n"))))
    return F.transform(F.filter(chunks, lambda c: (c["n"] >= least) | (c["n"] > size)), lambda c: c["text"])


def even_sample(values: Column, most: int) -> Column:
    """At most `most` values, evenly spaced by place, first and last among them."""

    def pick(v: Column) -> Column:
        step = F.size(v) - 1
        return F.when(F.size(v) <= most, v).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(v, F.floor(i * step / F.lit(max(most - 1, 1))).cast("int") + 1)))

    return let(values, pick)
