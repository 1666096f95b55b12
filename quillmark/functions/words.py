"""Closed function-word lists by language.

Lists of more than some two hundred words are not built in: pass them, or name a text file with one word a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# English and French function words.
ENGLISH = """the of and a to in is you that it he was for on are as with his they i at be this have from or one had by but not what all were
we when your can there an each which she do how their if will up other about out many then them these so some her would him into has two more
no way could my than been who its now did get may over only me back most very after our just where much before too any same also around does
another well must even such because here why off again while might next those both until us without once should every between own below under
few along something seem always against yet though upon within whose whom""".split()
FRENCH = """le la les un une des du au aux de d ce cet cette ces mon ton son ma ta sa mes tes ses notre votre leur nos vos leurs chaque plusieurs
quelques aucun aucune tout toute tous toutes tel telle autre autres je tu il elle on nous vous ils elles me te se y en lui eux moi toi soi lequel
laquelle celui celle ceux celles ceci cela ca rien personne l' d' j' m' t' s' n' c' qu' à dans par pour vers avec sans sous sur entre chez contre
depuis pendant selon et ou mais donc or ni car que qui quoi dont où quand pourquoi si comme lorsque puisque ne pas plus jamais non ici alors encore
toujours souvent très trop peu beaucoup aussi bien cependant pourtant toutefois ensuite enfin ainsi surtout""".split()

BUILT_IN = {"en": ENGLISH, "fr": FRENCH}


def function_words(lang: str, lists: dict[str, list[str]] | None = None, fallback: str = "en") -> list[str]:
    """The list of a language, of the fallback where it has none."""
    known = BUILT_IN | (lists or {})
    return known.get(lang, known[fallback])


def word_table(spark: SparkSession, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """lang, term: a few hundred rows."""
    known = BUILT_IN | (lists or {})
    return spark.createDataFrame([(lang, w) for lang, ws in sorted(known.items()) for w in ws], "lang string, term string")


def read_words(spark: SparkSession, path: str) -> list[str]:
    """One word a line; closed lists are small by nature."""
    return [r[0] for r in spark.read.text(path).where("trim(value) <> ''").collect()]
