"""Statistics of texts as Spark columns; null texts count as empty. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that ends a word, and the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
SYMBOL_CLASS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"{BLANK_CLASS}+"))


def count_of(text: Column, character_class: str) -> Column:
    """How many characters of a text are of a regex class like ``[a-z]``."""
    outside = f"[^{character_class[1:]}+"
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), outside, "")).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


#: Bits of a sort key that hold a window's place; the others hold the upper bits of its hash.
PLACE_BITS = 24


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with the number of words that stand in windows of three that occur twice or more in array ``words``.

    A window's place rides in the low bits of its hash, so that a sort of plain numbers brings equal windows together,
    in time n log n whatever repeats. Windows that share the upper bits but not the hash, or more places than fit, are
    told apart by a sort on both. Each step is a column of its own, since a lambda would evaluate it per element.
    """
    low = (1 << PLACE_BITS) - 1
    word = lambda i: F.get(F.col(words), i)
    place = lambda k: k.bitwiseAND(F.lit(low).cast("long")).cast("int")
    top = lambda k: F.shiftright(k, PLACE_BITS)
    none = F.array().cast("array<bigint>")

    def beside(column: str, same):
        """Keeps elements that ``same`` likens to a neighbour."""
        c = F.col(column)
        return F.filter(c, lambda x, i: F.coalesce(same(x, F.get(c, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(c, i + 1)), F.lit(False)))

    n = F.size(words)
    steps = {
        "__windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(none),
        "__keys": F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), none).otherwise(
            F.sort_array(F.transform("__windows", lambda h, i: h.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long"))))
        ),
        "__near": beside("__keys", lambda a, b: top(a) == top(b)),
        "__clash": (F.size("__windows") > low)
        | F.exists(
            F.transform(F.col("__near"), lambda k, i: (top(k) == top(F.get(F.col("__near"), i + 1))) & (F.get(F.col("__windows"), place(k)) != F.get(F.col("__windows"), place(F.get(F.col("__near"), i + 1))))),
            lambda x: F.coalesce(x, F.lit(False)),
        ),
        "__pairs": F.when(F.col("__clash"), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "__places": F.sort_array(
            F.when(F.col("__clash"), F.transform(beside("__pairs", lambda a, b: a["h"] == b["h"]), lambda x: x["i"])).otherwise(F.transform("__near", place))
        ),
        "__covered": F.aggregate(
            F.transform(F.col("__places"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("__places"), i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
        ),
        out: F.explode(F.array("__covered")),  # a filter on it isn't pushed below this, into the steps
    }
    for name, column in steps.items():
        df = df.withColumn(name, column)
    return df.drop(*[x for x in steps if x != out])
