"""Editions: word tokens with offsets, aligned blocks, compression distance. What compares two whole texts runs in Python,
one pair at a time, over pairs that an equi-join has chosen."""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_OLD = str.maketrans("ёЁѣѢіІїЇѳѲѵѴ", "еЕеЕиИиИфФиИ")
_HARD = re.compile(r"(?<=[а-я])ъ$")


def normal_word(word: str) -> str:
    return _HARD.sub("", word.translate(_OLD).casefold())


TOKENS = "array<struct<text: string, start: int, end: int>>"


#: Bytes of text whose tokens a worker holds at once; one longer text is a piece of its own.
PIECE = 1 << 20


def token_offsets(rows: DataFrame, pattern: re.Pattern = _TOKEN, unit: str = "doc_id") -> DataFrame:
    """unit, tokens: each with its place in code points. Tokens are gathered in Arrow columns, some texts at a time."""
    kind = dict(rows.dtypes)[unit]

    def tokens(texts):
        import pyarrow as pa

        words, parts, starts, ends, offsets = [], [pa.array([], pa.string())], array("i"), array("i"), array("i", [0])
        for t in texts:
            for m in pattern.finditer(t or ""):
                words.append(m[0])
                starts.append(m.start())
                ends.append(m.end())
                if len(words) == 1 << 16:
                    parts.append(pa.array(words, pa.string()))
                    words.clear()
            offsets.append(len(starts))
        column = pa.concat_arrays([*parts, pa.array(words, pa.string())])
        places = [pa.array(memoryview(x), pa.int32()) for x in (starts, ends)]
        return pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.StructArray.from_arrays([column, *places], ["text", "start", "end"]))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            step = max(1, b.num_rows * PIECE // max(b.nbytes, 1))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                yield pa.RecordBatch.from_arrays([part.column(0), tokens(x.as_py() for x in part.column(1))], [unit, "tokens"])
            pa.default_memory_pool().release_unused()

    return rows.select(unit, "text").mapInArrow(run, f"{unit} {kind}, tokens {TOKENS}")


BLOCKS = "pair_id long, a_start int, a_end int, b_start int, b_end int, n_words int, a_char int, a_char_end int, b_char int, b_char_end int"


def aligned_blocks(pairs: DataFrame, least: int = 80) -> DataFrame:
    """BLOCKS of pairs (pair_id, text_a, text_b): equal runs of normalised words, `least` long, as the longest match first rule finds them."""

    def run(batches):
        from difflib import SequenceMatcher

        import pandas as pd

        for b in batches:
            out = []
            for pair, x, y in zip(b["pair_id"], b["text_a"], b["text_b"], strict=True):
                u, v = list(_WORD.finditer(x)), list(_WORD.finditer(y))
                match = SequenceMatcher(None, [normal_word(m[0]) for m in u], [normal_word(m[0]) for m in v], autojunk=False)
                out += [(pair, i, i + n, j, j + n, n, u[i].start(), u[i + n - 1].end(), v[j].start(), v[j + n - 1].end()) for i, j, n in match.get_matching_blocks() if n >= least]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return pairs.select("pair_id", "text_a", "text_b").mapInPandas(run, BLOCKS)


def coverage(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pair_id, matched, coverage of both sides and of their sum."""
    n = lambda c: F.size(F.regexp_extract_all(F.col(c), F.lit(r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"), F.lit(0)))
    sizes = pairs.select("pair_id", n("text_a").alias("na"), n("text_b").alias("nb"))
    m = blocks.groupBy("pair_id").agg(F.sum("n_words").alias("m"))
    share = lambda c: F.coalesce(F.try_divide(F.col("matched"), F.col(c)), F.lit(0.0))
    j = sizes.join(m, "pair_id", "left").withColumn("matched", F.coalesce("m", F.lit(0)))
    return j.select("pair_id", "matched", share("na").alias("coverage_a"), share("nb").alias("coverage_b"), F.coalesce(F.try_divide(2 * F.col("matched"), F.col("na") + F.col("nb")), F.lit(0.0)).alias("coverage"))


def aligned_texts(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pair_id, a_start, text_a, text_b: the surface of each block."""
    j = pairs.join(blocks, "pair_id")
    return j.select("pair_id", "a_start", F.substring("text_a", F.col("a_char") + 1, F.col("a_char_end") - F.col("a_char")).alias("text_a"), F.substring("text_b", F.col("b_char") + 1, F.col("b_char_end") - F.col("b_char")).alias("text_b"))


def shared_intervals(reports: list[DataFrame], least: int = 1) -> DataFrame:
    """start, end, and the mapped start in each variant, of reference intervals that all variants have. reports: (start, end, other)."""
    out = reports[0].select("start", "end", F.col("other").alias("other_0"))
    for i, r in enumerate(reports[1:], 1):
        j = out.alias("x").join(r.alias("r"), (F.col("x.start") < F.col("r.end")) & (F.col("r.start") < F.col("x.end")))
        start, end = F.greatest("x.start", "r.start"), F.least("x.end", "r.end")
        moved = [(F.col(f"x.other_{k}") + start - F.col("x.start")).alias(f"other_{k}") for k in range(i)]
        out = j.select(start.alias("start"), end.alias("end"), *moved, (F.col("r.other") + start - F.col("r.start")).alias(f"other_{i}")).where(F.col("end") - F.col("start") >= least)
    return out


def compression_scores(pairs: DataFrame, preset: int = 6) -> DataFrame:
    """The rows with score: how many bytes the target adds to a reference under one LZMA stream, for each of its own bytes. pairs:
    reference, target, any ids."""
    names = [c for c in pairs.columns if c not in ("reference", "target")]
    kinds = ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes if n in names)

    def run(batches):
        import lzma

        def size(data: bytes) -> int:
            return len(lzma.compress(data, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "preset": preset}]))

        for b in batches:
            known: dict[str, int] = {}
            scores = []
            for r, t in zip(b["reference"], b["target"], strict=True):
                if r not in known:
                    known = {r: size(r.encode())}
                scores.append((size((r + t).encode()) - known[r]) / len(t.encode()))
            yield b[names].assign(score=scores)

    return pairs.mapInPandas(run, f"{kinds}, score double")


def compression_ranking(target: DataFrame, references: DataFrame) -> DataFrame:
    """candidate_id, score, place: the mean over a candidate's works, each work alike; smallest first, ties by name. A reference work
    that is the target, or twice in the panel, is an error. target: work_id, text (one row); references: candidate_id, work_id, text."""
    one = F.broadcast(target.select(F.col("work_id").alias("_t"), F.col("text").alias("target")))
    pairs = references.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("work_id"))).crossJoin(one)
    bad = (F.col("work_id") == F.col("_t")) | (F.col("_n") > 1)
    checked = pairs.select("candidate_id", "work_id", F.when(bad, F.raise_error(F.lit("target or repeated work among references"))).otherwise(F.col("text")).alias("reference"), "target")
    mean = compression_scores(checked).groupBy("candidate_id").agg(F.avg("score").alias("score"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy("score", "candidate_id")))
