"""Cleaning, tokens, chunks and scalar features over `documents`, `pages` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import tokens as T
from quillmark.functions.words import BUILT_IN, word_table
from quillmark.operators import alignment as AL
from quillmark.operators import corpus as C
from quillmark.operators import features as FT
from quillmark.operators import quality as Q
from quillmark.queries.registry import documents, query, works
from quillmark.sources import files as S

def TEXT():
    return F.col("text")



@query("SELECT doc_id, len(<tok>) AS n_tokens FROM documents")
def token_count(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.words(TEXT())).cast("long").alias("n_tokens"))


@query("SELECT doc_id, len(<space>) AS n_words FROM documents")
def space_word_count(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.space_words(TEXT())).cast("long").alias("n_words"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*')) AS n_words FROM documents")
def joined_word_count(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.joined_words(TEXT())).cast("long").alias("n_words"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}_])?')) AS n_words FROM documents")
def hyphen_word_count(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.hyphen_words(TEXT())).cast("long").alias("n_words"))


@query("SELECT doc_id, len(<sents>) AS n_sentences FROM documents")
def sentence_count(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.sentences(TEXT())).cast("long").alias("n_sentences"))


@query(r"""SELECT doc_id, md5(regexp_replace(replace(regexp_replace(text, '[‐‑‒–—―−﹘﹣－]', '—', 'g'), '--', '—'), '\s*—\s*', ' — ', 'g')) AS digest FROM documents""")
def normalise_dashes(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.normalise_dashes(TEXT())).alias("digest"))


@query("""SELECT doc_id, md5(regexp_replace(text, '[«»„“”‟‹›]', '"', 'g')) AS digest FROM documents""")
def unify_quotes(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.unify_quotes(TEXT())).alias("digest"))


@query("SELECT doc_id, md5(translate(text, 'ёЁ', 'еЕ')) AS digest FROM documents")
def fold_yo(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.fold_yo(TEXT())).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, 'ѣѢіІїЇѳѲѵѴ', 'еЕиИиИфФиИ'), 'ъ([^а-яёА-ЯЁ])', '\\1', 'g'), 'ъ$', '')) AS digest FROM documents")
def modern_letters(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.modern_letters(TEXT())).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[ѣѢіІѳѲѵѴ]')) / length(text) AS share FROM documents", "share")
def old_orthography(spark, d):
    return documents(spark, d).select("doc_id", X.old_orthography_share(TEXT()).alias("share"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '__[A-ZА-Я]+__|Страницы\s+с[^\n]*|Литература\s+\d{3,4}\s+года|(?:Категория|Category|Импорт)\s*:?\s*\S[^\n]*|(?:az\.)?lib\.ru\S*', ' ', 'g')) AS digest FROM documents""")
def strip_wiki_residue(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.strip_wiki_residue(TEXT())).alias("digest"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^а-яА-Яa-zA-Z0-9\s\.,;:!?—\-"@]', ' ', 'g'), '\s+', ' ', 'g')) AS kept FROM documents""")
def keep_allowed(spark, d):
    return documents(spark, d).select("doc_id", X.keep_allowed(TEXT()).alias("kept"))


@query()
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", X.clean(TEXT()).alias("text"))


@query()
def wikitext_plain(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.wikitext_plain(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, i AS place, CASE WHEN hit IS NULL THEN n ELSE hit END AS kept FROM (SELECT doc_id, 0 AS i, len(w) AS n, CASE WHEN len(w) < 200 THEN NULL ELSE list_min(list_filter(range(greatest(40, len(w) // 4), (3 * len(w)) // 4), lambda k: w[k + 1] = w[1] AND w[k + 1:k + 40] = w[1:40])) END AS hit FROM (SELECT doc_id, <space> AS w FROM documents))""")
def drop_doubled(spark, d):
    rows = documents(spark, d)
    return rows.select("doc_id", F.lit(0).alias("place"), F.size(T.space_words(X.drop_doubled(TEXT()))).cast("long").alias("kept"))


@query(r"""SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '[\p{P}\p{S}]'), lambda p: translate(p, '–―-', '———')), 'string_agg', ' ') AS marks FROM documents""")
def punctuation_string(spark, d):
    return documents(spark, d).select("doc_id", F.nullif(T.punctuation_string(TEXT()), F.lit("")).alias("marks"))


@query(r"""WITH g AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM (SELECT regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM documents)) SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 500""")
def char_trigrams_top(spark, d):
    g = documents(spark, d).select(F.explode(T.char_ngrams(F.lower(TEXT()), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(500)


@query(r"""WITH w AS (SELECT doc_id, unnest(<space>) AS w FROM (SELECT doc_id, lower(text) AS text FROM documents)), p AS (SELECT doc_id, ' ' || w || ' ' AS w FROM w), g AS (SELECT doc_id, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END) AS gram FROM p) SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS n_distinct FROM g GROUP BY doc_id""")
def char_trigrams_in_words(spark, d):
    g = documents(spark, d).select("doc_id", F.explode(T.char_ngrams_in_words(F.lower(TEXT()), 3)).alias("gram"))
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gram").alias("n_distinct"))


@query(r"""WITH t AS (SELECT doc_id, <tok> AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 3""")
def word_bigram_df(spark, d):
    g = documents(spark, d).select("doc_id", F.explode(F.array_distinct(T.ngrams(T.words(TEXT()), 2))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")


@query(r"""WITH w AS (SELECT doc_id, text, <space> AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(w) / 100) AS BIGINT))) AS ordinal, w, text FROM w) SELECT doc_id AS work_id, CAST(ordinal AS INT) AS ordinal, md5(CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[ordinal * 100 + 1:ordinal * 100 + 100], ' ') END) AS digest FROM c""")
def word_window_chunks(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")
    return C.chunk_by_words(rows, 100).select("work_id", "ordinal", F.md5("text").alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, <space> AS w FROM documents) SELECT doc_id AS work_id, count(*) AS n FROM (SELECT doc_id, unnest(range(0, len(w) // 100)) FROM w) GROUP BY doc_id""")
def word_window_whole_chunks(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")
    return C.chunk_by_words(rows, 100, keep_tail=False).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(<sents>, lambda x: {'t': x, 'n': len(regexp_extract_all(x, '[\p{L}\p{N}_]+'))}), lambda x: x.n > 0) AS l FROM documents),
r AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s), m AS (SELECT doc_id, x.t AS t, x.n AS n, i FROM r),
f AS (SELECT doc_id, i, n, t, 0 AS chunk, n AS filled FROM m WHERE i = 1
 UNION ALL SELECT m.doc_id, m.i, m.n, m.t, CASE WHEN f.filled + m.n <= 60 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.filled + m.n <= 60 THEN f.filled + m.n ELSE m.n END FROM f JOIN m ON m.doc_id = f.doc_id AND m.i = f.i + 1),
c AS (SELECT doc_id, chunk, sum(n) AS n, md5(string_agg(t, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id, chunk)
SELECT doc_id AS work_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INT) AS ordinal, digest FROM c WHERE n >= 20 OR n > 60""")
def sentence_chunks(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")
    return C.chunk_by_sentences(rows, 60, 20).select("work_id", F.col("ordinal").cast("int").alias("ordinal"), F.md5("text").alias("digest"))


@query()
def sentence_chunks_overlapping(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")
    return C.chunk_by_sentences(rows, 60, 20, overlap=0.5).select("work_id", "ordinal", F.md5("text").alias("digest"))


@query()
def token_offsets(spark, d):
    return AL.token_offsets(documents(spark, d)).select("doc_id", F.size("tokens").alias("n"), F.md5(F.to_json("tokens")).alias("digest"))


@query("SELECT doc_id, list_aggregate(list_transform(<alpha>, lambda w: length(w)), 'avg') AS avg_word, list_aggregate(list_transform(<sents>, lambda text: len(<alpha>)), 'avg') AS avg_sent FROM documents", "avg_word avg_sent")
def mean_lengths(spark, d):
    return documents(spark, d).where(F.size(T.alpha_words(TEXT())) >= 0).select("doc_id", *(c.alias(n) for n, c in FT.mean_lengths(TEXT()).items()))


@query(r"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{P}\p{S}]')) / nullif(len(regexp_extract_all(text, '[\p{P}\p{S}]')) + len(<tok>), 0), 0) AS punct_ratio, 100.0 * (length(text) - length(replace(text, '—', '')) + length(text) - length(replace(text, '-', ''))) / greatest(len(<alpha>), 1) AS dash_per_100, 100.0 * (length(text) - length(replace(text, ';', ''))) / greatest(len(<alpha>), 1) AS semi_per_100 FROM documents""", "punct_ratio dash_per_100 semi_per_100")
def punctuation_rates(spark, d):
    return documents(spark, d).select("doc_id", *(c.alias(n) for n, c in FT.punctuation_rates(TEXT()).items()))


@query("WITH <works>, <counts> SELECT work_id, count(*) / sum(n) AS ttr, count(*) FILTER (n = 1) / count(*) AS hapax, CASE WHEN sum(n) > 1 THEN 10000.0 * (sum(n * n) - sum(n)) / (sum(n) * sum(n)) ELSE 0 END AS yule_k FROM counts GROUP BY work_id", "ttr hapax yule_k")
def lexical_richness(spark, d):
    return FT.richness(works(spark, d))


@query("WITH <works>, w AS (SELECT work_id, least(length(unnest(<alpha>)), 17) AS length FROM works), n AS (SELECT work_id, length, count(*) AS n FROM w GROUP BY ALL) SELECT work_id, CAST(length AS INT) AS length, n / sum(n) OVER (PARTITION BY work_id) AS share FROM n", "share")
def word_length_histogram(spark, d):
    return FT.length_histogram(works(spark, d)).withColumn("length", F.col("length").cast("int"))


@query("WITH <works>, s AS (SELECT work_id, CAST(len(<alpha>) AS DOUBLE) AS n FROM (SELECT work_id, unnest(<sents>) AS text FROM works)) SELECT work_id, stddev_pop(n) AS std, coalesce(stddev_pop(n) / nullif(avg(n), 0), 0) AS cv, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, avg(CAST(n < 5 AS INT)) AS short, avg(CAST(n > 30 AS INT)) AS long FROM s GROUP BY work_id", "std cv p10 p50 p90 short long")
def sentence_length_stats(spark, d):
    return FT.sentence_lengths(works(spark, d))


@query("WITH <works>, s AS (SELECT work_id, CAST(len(w) AS DOUBLE) AS x, len(list_distinct(w)) / len(w) AS y FROM (SELECT work_id, <alpha> AS w FROM (SELECT work_id, lower(unnest(<sents>)) AS text FROM works)) WHERE len(w) >= 5) SELECT work_id, CASE WHEN ok THEN s ELSE 0 END AS slope, CASE WHEN ok THEN i ELSE 0 END AS intercept, CASE WHEN ok THEN r ELSE 0 END AS r2 FROM (SELECT work_id, count(*) >= 6 AND min(x) < max(x) AND min(y) < max(y) AS ok, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r FROM s GROUP BY work_id)", "slope intercept r2")
def ttr_by_sentence_length(spark, d):
    return FT.richness_by_length(works(spark, d))


@query("SELECT doc_id, CASE WHEN len(<sents>) = 0 THEN 0 ELSE len(list_filter(<sents>, lambda x: x[1] IN ('—', '-'))) / len(<sents>) END AS ratio FROM documents", "ratio")
def direct_speech(spark, d):
    return documents(spark, d).select("doc_id", FT.speech_ratio(TEXT()).alias("ratio"))


VOWELS = ("oua", "eiy")


@query(r"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(<alpha>, ''), '[^ouaeiy]', '', 'g'), '[oua]', 'H', 'g'), '[eiy]', 'S', 'g') AS hs FROM (SELECT doc_id, lower(text) AS text FROM documents)),
p AS (SELECT doc_id, substr(hs, i, 2) AS p FROM (SELECT doc_id, hs, unnest(range(1, length(hs))) AS i FROM h WHERE length(hs) >= 20)), c AS (SELECT doc_id, p, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT doc_id, sum(-(n / t) * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id)
SELECT h.doc_id, coalesce(e.e, 0) AS entropy FROM h LEFT JOIN e USING (doc_id)""", "entropy")
def vowel_rhythm(spark, d):
    return documents(spark, d).select("doc_id", FT.vowel_rhythm(TEXT(), *VOWELS).alias("entropy"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0) AS ratio FROM documents", "ratio")
def cyrillic_ratio(spark, d):
    return documents(spark, d).select("doc_id", FT.cyrillic_ratio(TEXT()).alias("ratio"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?im)^\s*(?:глава|часть|том)\s+[ivxlcdm\d]')) AS chapter_markers, len(regexp_extract_all(text, '(?m)^\s*\d{1,4}\s*$')) AS page_numbers, len(regexp_extract_all(text, '(?i)ISBN')) AS isbn, len(regexp_extract_all(text, '(?i)(?:©|copyright|все права защищены|OCR|FB2|fb2|библиотека)')) AS copyright FROM documents")
def noise_counts(spark, d):
    return documents(spark, d).select("doc_id", *(c.cast("long").alias(n) for n, c in FT.noise_counts(TEXT()).items()))


_LISTS = ", ".join(f"('{lang}', '{w.replace(chr(39), chr(39) * 2)}')" for lang, ws in BUILT_IN.items() for w in dict.fromkeys(ws))


@query(f"WITH fw(lang, term) AS (VALUES {_LISTS}), t AS (SELECT doc_id, lang, unnest(<tok>) AS term FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id, count(fw.term) / count(*) AS share FROM t LEFT JOIN fw ON t.lang = fw.lang AND t.term = fw.term GROUP BY doc_id", "share")
def function_word_share(spark, d):
    t = documents(spark, d).where("lang in ('en', 'fr')").select("doc_id", "lang", F.explode(T.words(TEXT())).alias("term"))
    listed = word_table(spark).distinct().withColumn("hit", F.lit(1))
    return t.join(F.broadcast(listed), ["lang", "term"], "left").groupBy("doc_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("share"))


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_number FROM pages), k AS (SELECT page_id, line_number, unnest(list_filter([CASE WHEN regexp_matches(line, '</?[A-Za-z][^>\n]{0,200}>') THEN 'html_tag' END, CASE WHEN regexp_matches(line, '(?i)&(?:nbsp|amp|lt|gt|quot|apos|#\d+|#x[0-9a-f]+);') THEN 'html_entity' END, CASE WHEN regexp_matches(line, '(?i)https?://|www\.') THEN 'web_url' END], lambda x: x IS NOT NULL)) AS kind FROM l) SELECT page_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def transport_markup(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").alias("text"))
    return Q.line_findings(rows, "page_id").where(F.col("kind").isin("html_tag", "html_entity", "web_url")).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def line_findings(spark, d):
    return Q.line_findings(documents(spark, d).select(F.col("doc_id").alias("work_id"), "text"))


@query()
def repeated_tail(spark, d):
    return Q.repeated_tail(documents(spark, d).select(F.col("doc_id").alias("work_id"), "text"), least=60, anchor=8, least_repeat=30)


@query(r"""WITH n AS (SELECT doc_id AS work_id, len(<space>) AS n, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0) AS cyr FROM documents) SELECT work_id, 'error' AS severity, 'empty' AS code FROM n WHERE n = 0 UNION ALL SELECT work_id, 'warn', 'tiny' FROM n WHERE n > 0 AND n < 50 UNION ALL SELECT work_id, 'warn', 'non_cyrillic' FROM n WHERE n > 0 AND cyr < 0.6""")
def work_findings(spark, d):
    return Q.work_findings(documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")).where("code <> 'noise'")


@query("""WITH <works>, p AS (SELECT author, count(DISTINCT work_id) AS books, sum(len(<space>)) AS words FROM works GROUP BY author) SELECT author, 'warn' AS severity, 'few_books' AS code FROM p WHERE books < 60 UNION ALL SELECT author, 'warn', 'few_words' FROM p WHERE words < 20000 UNION ALL SELECT NULL, 'warn', 'imbalance' FROM p HAVING max(words) / min(words) FILTER (words > 0) > 1.05""")
def author_findings(spark, d):
    return Q.author_findings(works(spark, d), 60, 20_000, 1.05)


@query("""WITH <works>, p AS (SELECT author, count(DISTINCT work_id) AS n, sum(len(<space>)) AS words FROM works GROUP BY author) SELECT count(*) AS n_authors, CAST(sum(n) AS BIGINT) AS n_works, CAST(sum(words) AS BIGINT) AS total_words, round(max(words) / min(words) FILTER (words > 0), 1) AS imbalance FROM p""")
def corpus_summary(spark, d):
    return C.summary(works(spark, d)).select("n_authors", F.col("n_works").cast("long").alias("n_works"), F.col("total_words").cast("long").alias("total_words"), "imbalance")


@query(r"""WITH v AS (SELECT doc_id AS work_id, unnest(list_filter([CASE WHEN length(text) = 0 THEN 'empty' END, CASE WHEN NOT ends_with(text, chr(10)) OR ends_with(text, chr(10) || chr(10)) THEN 'final_lf' END, CASE WHEN contains(text, chr(13)) THEN 'cr' END, CASE WHEN contains(text, chr(9)) THEN 'tab' END, CASE WHEN regexp_matches(regexp_replace(text, '\n\z', ''), '\A\s|\s\z') THEN 'edge_space' END, CASE WHEN regexp_matches(regexp_replace(text, '\n\z', ''), '(?m)[^\S\n]+$') THEN 'line_end_space' END, CASE WHEN contains(text, chr(10) || chr(10) || chr(10)) THEN 'blank_lines' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN 'control' END], lambda x: x IS NOT NULL)) AS problem FROM documents) SELECT problem, count(*) AS n FROM v GROUP BY problem""")
def text_contract(spark, d):
    return Q.contract(documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH <works>, f AS (SELECT CASE WHEN len(<space>) = 0 THEN 'error' END AS s FROM works) SELECT count(s) AS errors, count(s) = 0 AS passed FROM f""")
def corpus_gate(spark, d):
    return Q.gate(Q.work_findings(works(spark, d)))


@query()
def plain_html(spark, d):
    return S.plain_html(spark.read.parquet(f"{d}/pages.parquet"))


@query(r"""SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents""")
def line_range(spark, d):
    return documents(spark, d).select("doc_id", X.line_range(TEXT(), 1, 4).alias("lines"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def assemble_turns(spark, d):
    return S.assemble(spark.read.parquet(f"{d}/conversations.parquet").withColumnRenamed("turn", "ordinal"), "conv_id")


@query()
def representation(spark, d):
    return FT.representation(works(spark, d)).drop("text")


@query(r"""WITH w AS (SELECT doc_id, unnest(<tok>) AS w FROM documents) SELECT doc_id, md5(string_agg(regexp_replace(lower(translate(w, 'ёЁѣѢіІїЇѳѲѵѴ', 'еЕеЕиИиИфФиИ')), '([а-яѣіѳѵ])ъ$', '\1'), ' ')) AS digest FROM (SELECT doc_id, w FROM w) GROUP BY doc_id""")
def historical_words(spark, d):
    return documents(spark, d).where(F.size(T.words(TEXT())) > 0).select("doc_id", F.md5(F.array_join(F.transform(T.words(TEXT()), X.historical_word), " ")).alias("digest"))
