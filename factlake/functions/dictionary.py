"""A table of word stems: every distinct word is stemmed once, whatever texts it is in.

English search needs no stems of texts. A question's words become stems, and each
stem the set of known words that share it; a text matches if it holds a word of
each set. Texts are only cut into words, which stays inside the JVM, and one
index of words serves both configurations.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.text import STOP_WORDS_ENGLISH, lexemes, stem_english
from factlake.session import materialize

DICTIONARY = "word string, stem string"


def distinct_words(texts: DataFrame, column: str) -> DataFrame:
    """The words of all texts but the stop words, each once."""
    return without_stop_words(texts.select(F.explode(lexemes(F.col(column), "simple")).alias("word"))).distinct()


def without_stop_words(words: DataFrame) -> DataFrame:
    return words.filter(~F.col("word").isin(*STOP_WORDS_ENGLISH))


def stemmed(words: DataFrame) -> DataFrame:
    """``word, stem`` of distinct words."""
    # A word is a row of its own; a batch of rows crosses to Python at a time.
    return words.select("word", F.element_at(stem_english(F.array("word")), 1).alias("stem"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The stored dictionary; an empty one where nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], DICTIONARY)
    return spark.read.schema(DICTIONARY).parquet(path)


def grow_dictionary(texts: DataFrame, column: str, path: str) -> DataFrame:
    """The dictionary at ``path`` after adding the words of ``texts`` that it lacks.

    Null texts have no words. Growing twice with the same texts adds nothing.
    """
    spark = texts.sparkSession
    new = distinct_words(texts, column).join(read_dictionary(spark, path), "word", "left_anti")
    materialize(stemmed(new), "new-words").write.mode("append").parquet(path)
    return read_dictionary(spark, path)


def word_classes(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``stem, words``: of each distinct stem in ``terms`` the known words that have it.

    A stem that no known word has gets an empty set.
    """
    wanted = terms.select("stem").distinct()
    known = dictionary.join(wanted, "stem", "left_semi").groupBy("stem").agg(
        F.array_sort(F.collect_set("word")).alias("words"))
    return wanted.join(known, "stem", "left").select(
        "stem", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def stem_lexemes(texts: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """``key, lexemes``: the English lexemes of each text by way of the dictionary, sorted.

    ``key`` names a row. Texts without lexemes get an empty list, null texts null.
    """
    words = texts.select(key, F.explode(lexemes(F.col(column), "simple")).alias("word"))
    found = words.join(dictionary, "word").groupBy(key).agg(F.array_sort(F.collect_set("stem")).alias("lexemes"))
    return texts.select(key, column).join(found, key, "left").select(
        key, F.when(F.col(column).isNotNull(), F.coalesce("lexemes", F.array().cast("array<string>"))).alias("lexemes"))
