"""Corpus checks as findings: (work_id, severity, code, ...). A gate is an empty set of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import tokens as T
from quillmark.operators import features as FT

# What counts as transport markup and as a publisher's apparatus.
TRANSPORT = {
    "nul": r"\x00",
    "unicode_replacement_character": "�",
    "html_tag": r"</?[A-Za-z][^>\n]{0,200}>",
    "html_entity": r"(?i)&(?:nbsp|amp|lt|gt|quot|apos|#\d+|#x[0-9a-f]+);",
    "wiki_link": r"\[\[|\]\]",
    "wiki_template": r"\{\{|\}\}",
    "wiki_bold_italic": r"'{3,5}",
    "wiki_category": r"(?i)(?:Категория|Category)\s*:",
    "wiki_magic_word": r"__[A-ZА-Я][A-ZА-Я0-9_]+__",
    "redirect_directive": r"(?iU)^\s*#\s*(?:redirect|перенаправление)\b",
    "rendered_redirect_notice": r"(?iU)\bперенаправлени[ея]\b",
    "web_url": r"(?i)https?://|www\.",
    "source_separator": r"^\s*[-_=]{20,}\s*$",
}
APPARATUS = {
    "print_run_colophon": r"(?iU)\b(?:тираж|уч\.-изд\.\s*л\.|заказ\s+\d+)\b",
    "publisher_colophon": r"(?iU)\b(?:издательств[оа]|книжная\s+фабрика|госкомитет[а-я]*\s+.*издательств)\b",
    "isbn_colophon": r"(?iU)\bISBN(?:-1[03])?\b",
    "digital_source_colophon": r"(?iU)\b(?:OCR|proofread|project\s+gutenberg|электронн(?:ая|ое)\s+(?:библиотека|издание))\b",
    "source_navigation": r"(?iU)^\s*(?:См\.\s+также|Викитека|Wikisource)\s*$",
}
SEVERITY = {"error": 0, "warn": 1, "info": 2}


def _kinds(line: Column, rules: dict[str, str], when: Column | None = None) -> Column:
    hits = (F.when(line.rlike(p) if when is None else when & line.rlike(p), F.lit(k)) for k, p in rules.items())
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def line_findings(rows: DataFrame, unit: str = "work_id", edge: int = 100) -> DataFrame:
    """unit, line_number, kind, line_sha256, excerpt: transport markup anywhere, apparatus in the first and last `edge` lines."""
    lines = rows.select(unit, F.split("text", "\n").alias("ls")).select(unit, F.size("ls").alias("n"), F.posexplode("ls").alias("i", "line"))
    at_edge = (F.col("i") < edge) | (F.col("i") >= F.col("n") - edge)
    kinds = F.concat(_kinds(F.col("line"), TRANSPORT), _kinds(F.col("line"), APPARATUS, at_edge))
    return lines.select(unit, (F.col("i") + 1).alias("line_number"), F.explode(kinds).alias("kind"), F.sha2("line", 256).alias("line_sha256"), F.substring("line", 1, 240).alias("excerpt"))


def residue_kinds(text: Column) -> Column:
    """Sorted kinds of transport markup in a whole text."""
    return F.array_sort(_kinds(text, {k: p.replace("^", "(?m)^", 1) if p.startswith("^") else p for k, p in TRANSPORT.items()}))


def repeated_tail(rows: DataFrame, unit: str = "work_id", least: int = 400, anchor: int = 32, least_repeat: int = 200) -> DataFrame:
    """unit, offset, repeated: the text's beginning stands again at its end. One narrow pass in Python, linear in the text (the places
    of the anchor are compared from the right, where the repeat must reach the end)."""
    kind = dict(rows.dtypes)[unit]

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for u, w in b.itertuples(index=False):
                w = list(w)
                n = len(w)
                if n < least:
                    continue
                # border[i]: longest prefix that ends at i; the borders of the whole text are its repeats at the end
                border = [0] * n
                k = 0
                for i in range(1, n):
                    while k and w[i] != w[k]:
                        k = border[k - 1]
                    k += w[i] == w[k]
                    border[i] = k
                k, found = border[-1], None
                while k >= least_repeat:
                    if n - k >= max(anchor, n // 3):
                        found = k
                        break
                    k = border[k - 1]
                if found:
                    out.append((u, n - found, found))
            yield pd.DataFrame(out, columns=[unit, "second_copy_offset", "repeated"])

    return rows.select(unit, T.joined_words(F.col("text")).alias("w")).mapInPandas(run, f"{unit} {kind}, second_copy_offset long, repeated long")


def work_findings(rows: DataFrame, tiny: int = 50, noisy: int = 5) -> DataFrame:
    """work_id, severity, code: empty, tiny, non-Cyrillic, noise."""
    n = F.size(T.space_words(F.col("text")))
    noise = F.greatest(*FT.noise_counts(F.col("text")).values())
    rules = [("error", "empty", n == 0), ("warn", "tiny", (n > 0) & (n < tiny)), ("warn", "non_cyrillic", (n > 0) & (FT.cyrillic_ratio(F.col("text")) < 0.6)), ("info", "noise", (n > 0) & (noise > noisy))]
    found = F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, c in rules))
    return rows.select("work_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("work_id", "f.severity", "f.code")


def author_findings(rows: DataFrame, least_books: int = 2, least_words: int = 500, imbalance: float = 5.0) -> DataFrame:
    """author (null for the corpus), severity, code: few books, few words, imbalance."""
    per = rows.groupBy("author").agg(F.count_distinct("work_id").alias("books"), F.sum(F.size(T.space_words(F.col("text")))).alias("words"))
    found = F.array(F.when(F.col("books") < least_books, F.lit("few_books")), F.when(F.col("words") < least_words, F.lit("few_words")))
    own = per.select("author", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("code"))
    whole = per.agg((F.max("words") / F.min(F.when(F.col("words") > 0, F.col("words")))).alias("r")).where(F.col("r") > imbalance).select(F.lit(None).cast("string").alias("author"), F.lit("imbalance").alias("code"))
    return own.unionByName(whole).select("author", F.lit("warn").alias("severity"), "code")


def ordered(findings: DataFrame) -> DataFrame:
    """Errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return findings.orderBy(rank, "code")


def gate(findings: DataFrame) -> DataFrame:
    """One row: errors, passed."""
    return findings.agg(F.coalesce(F.sum((F.col("severity") == "error").cast("long")), F.lit(0)).alias("errors")).withColumn("passed", F.col("errors") == 0)


def contract(rows: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, problem: broken rules of canonical text."""
    return rows.select(unit, F.explode(X.canonical_violations(F.col("text"))).alias("problem"))


def audit(rows: DataFrame, least_words: int = 200) -> DataFrame:
    """work_id, code: every blocker of a corpus: contract, markup, apparatus, repeated tails, short works, contained works."""
    from quillmark.operators import overlap as O

    short = rows.where(F.size(T.joined_words(F.col("text"))) < least_words).select("work_id", F.lit("too_short").alias("code"))
    parts = [contract(rows).select("work_id", F.concat(F.lit("contract:"), "problem").alias("code")), line_findings(rows).select("work_id", F.col("kind").alias("code")).distinct(), repeated_tail(rows).select("work_id", F.lit("repeated_tail").alias("code")), short, O.containment(rows).select(F.col("short").alias("work_id"), F.lit("contained").alias("code")).distinct(), O.exact_copies(rows).select(F.col("copy").alias("work_id"), F.lit("identical").alias("code"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
