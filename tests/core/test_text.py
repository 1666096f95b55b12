"""Cleaning, tokens and chunks on worked values."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import tokens as T
from quillmark.operators import corpus as C


def one(spark, value, fn):
    return spark.createDataFrame([Row(text=value)], "text string").select(fn(F.col("text")).alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, "a--b – c", X.normalise_dashes) == "a — b — c"
    assert one(spark, "«x» „y“", X.unify_quotes) == '"x" "y"'
    assert one(spark, "мiръ объектъ съѣздъ".replace("i", "і"), X.modern_letters) == "мир объект съезд"
    assert one(spark, "ёлка Ёж", X.fold_yo) == "елка Еж"
    assert one(spark, "__NOTOC__ text\nКатегория:Импорт lib.ru", X.strip_wiki_residue).split() == ["text"]
    assert one(spark, "a\t b$c ", X.keep_allowed) == "a b c"
    assert one(spark, "I met old John Smith there.", lambda t: X.mask_entities(t)).split() == "I met old @ there.".split()
    assert one(spark, "== Head ==\n[[a|b]] {{x}}'''bold''' <ref>z</ref>", X.wikitext_plain) == "Head\nb bold"
    assert one(spark, "Міръ", X.historical_word) == "мир"
    doubled = " ".join(f"w{i}" for i in range(150))
    assert one(spark, f"{doubled} {doubled}", X.drop_doubled) == doubled and one(spark, doubled, X.drop_doubled) == doubled
    assert one(spark, "", X.drop_doubled) == ""


def test_entities(spark):
    df = spark.sql("select 'Anna saw Bob.' as text, array(named_struct('start', 9, 'end', 12, 'label', 'PER'), named_struct('start', 0, 'end', 4, 'label', 'PER'), named_struct('start', 5, 'end', 8, 'label', 'LOC')) as e")
    assert df.select(X.mask_entities(F.col("text"), F.col("e")).alias("x")).first().x == " @  saw  @ ."


def test_contract(spark):
    f = lambda t: one(spark, t, X.canonical_violations)
    assert f("good line\nnext\n") == [] and f("no end") == ["final_lf"] and f("x \ny\n") == ["line_end_space"] and "tab" in f("a\tb\n") and f("a\n\n\nb\n") == ["blank_lines"]


def test_tokens(spark):
    assert one(spark, "A b_1 Éa-c", T.words) == ["a", "b_1", "éa", "c"]
    assert one(spark, "it's well-known -x-", T.joined_words) == ["it's", "well-known", "x"]
    assert one(spark, "One. Two!! 3 x…", T.sentences) == ["One.", "Two!!", "3 x…"]
    assert one(spark, "a b c", lambda t: T.ngrams(T.words(t), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "ab  c", lambda t: T.char_ngrams(t, 3, 4)) == ["ab ", "b c", "ab c"]
    assert one(spark, "abc d", lambda t: T.char_ngrams_in_words(t, 3)) == [" ab", "abc", "bc ", " d "]
    assert one(spark, "a, b – c", T.punctuation_string) == ", —"
    assert one(spark, "", lambda t: T.ngrams(T.words(t), 2)) == []
    assert one(spark, "x", lambda t: T.even_sample(F.array(*map(F.lit, range(10))), 4)) == [0, 3, 6, 9]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x  y")], "work_id long, text string")
    rows = sorted((r.work_id, r.ordinal, r.text) for r in C.chunk_by_words(df, 2).collect())
    assert rows == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (2, 0, "x  y")]
    assert [r.text for r in C.chunk_by_words(df, 2, keep_tail=False).orderBy("work_id", "ordinal").collect()] == ["a b", "c d", "x y"]
    sent = lambda n: " ".join(["w"] * n) + "."
    packed = lambda text, size, least, overlap=0.0: [r.text.count("w") for r in C.chunk_by_sentences(spark.createDataFrame([(1, text)], "work_id long, text string"), size, least, overlap).orderBy("ordinal").collect()]
    assert packed(" ".join(sent(5) for _ in range(20)), 20, 5) == [20] * 5
    assert packed(f"{sent(3)} {sent(50)} {sent(4)} {sent(4)}", 20, 5) == [50, 8]
    assert packed(" ".join(sent(5) for _ in range(6)), 20, 10, 0.5) == [20, 20, 10]


def test_annotations(spark):
    token = "struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,morph:map<string,string>,is_alpha:boolean,is_punct:boolean,is_space:boolean,like_num:boolean,sent:int>"
    rows = [(0, "The", "the", "DET", "det", 1, {}, True, False, False, False, 0), (1, "dogs", "dog", "NOUN", "nsubj", 2, {"Number": "Plur"}, True, False, False, False, 0), (2, "run", "run", "VERB", "ROOT", 2, {"Tense": "Pres"}, True, False, False, False, 0), (3, "2", "2", "NUM", "obj", 2, {}, False, False, False, True, 0), (4, ".", ".", "PUNCT", "punct", 2, {}, False, True, False, False, 0)]
    df = spark.createDataFrame([(1, rows)], f"chunk_id long, tokens array<{token}>")
    from quillmark.operators import features as FT

    r = df.select(T.pos_string(F.col("tokens")).alias("pos"), T.bleach(F.col("tokens"), {"NUM": "%", "NOUN": "¤"}).alias("b"), *(c.alias(n) for n, c in FT.tree_shape(F.col("tokens")).items()), *(c.alias(n) for n, c in FT.pos_ratios(F.col("tokens")).items()), *(c.alias(n) for n, c in FT.suffix_profile(F.col("tokens"), ["og", "n"]).items())).first()
    assert r.pos == "DET NOUN VERB NUM PUNCT" and r.b == "the ¤ run % ."
    assert (r.tree_depth_max, r.tree_depth_mean, r.head_dist_max, r.branching_mean, r.leaf_ratio) == (2.0, 1.0, 2.0, 0.8, 0.6)
    assert r.noun == r.verb == 1 / 3 and r.adj == 0 and r.suffix_og == 1 / 3 and r.coverage == 2 / 3
    assert {(x.term, x.value) for x in FT.morphology(df).collect()} == {("Number=Plur", 0.5), ("Tense=Pres", 0.5)}
    assert {x.term: x.value for x in FT.dependencies(df).collect()}["det"] == 0.2


def test_old_letters_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "a" * 30_000 + "ѣ" * 10_000), (2, ""), (3, None)], "id long, text string")
    got = df.select("id", X.old_orthography_share(F.col("text")).alias("whole"), X.old_orthography_share(F.col("text"), 20_000).alias("head"), X.is_old_orthography(F.col("text")).alias("old")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0.25, 0.0, False), (2, 0.0, 0.0, False), (3, 0.0, 0.0, False)]
