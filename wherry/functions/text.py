"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, and invisible spaces.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: A small default list; any set of words may be given instead.
STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with", "的", "了", "和", "与", "在", "是"]
SENTENCE_ENDS = "。！？!?；;"


def clean_text(text: Column) -> Column:
    """Runs of white space as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.translate(text, WHITE, " " * len(WHITE)), " +", " "))


def fold(text: Column) -> Column:
    """Case folding: lower case, sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def compact(text: Column) -> Column:
    """Folded text reduced to ASCII letters, digits and basic Han characters."""
    return F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^0-9a-z一-鿿]+", "")


def tokens(text: Column) -> Column:
    """Terms of a text: folded words of letters and digits of any script, and pairs of neighbouring Han characters (a lone one by itself). Empty for null.

    This is the default tokenizer; wherever one is taken, any function from a text
    column to an array of terms may be given instead.
    """
    words = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+|(?<=[\p{L}\p{N}&&[^一-鿿]])(?=[一-鿿])|(?<=[一-鿿])(?=[\p{L}\p{N}&&[^一-鿿]])", " ")
    # A Han character takes its neighbour along; the last of a run has given itself to the one before.
    paired = F.regexp_replace(words, "([一-鿿])(?=([一-鿿]))|(?<=[一-鿿])[一-鿿]", "$1$2 ")
    return F.array_remove(F.split(paired, " +"), "")


def without_stopwords(terms: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """``terms`` without empty and stop words; repetitions and order stay."""
    return F.filter(terms, lambda t: (t != "") & ~t.isin(*stopwords))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text`` without overlap; 0 for an empty term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def chunks(text: Column, size: int = 650, step: int = 500) -> Column:
    """Overlapping parts of ``size`` characters, one every ``step``. None for an empty text."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda k: F.substring(text, k + 1, F.lit(size)))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences cut after each end mark, trimmed, without empty ones."""
    marked = F.split(F.regexp_replace(text, f"([{SENTENCE_ENDS}])", "$1\u0001"), "\u0001")
    return F.filter(F.transform(marked, clean_text), lambda s: s != "")


def distinct_sentences(text: Column) -> Column:
    """The sentences of a text without later ones that differ only in case and white space, one a line."""
    found = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.replace(fold(s), F.lit(" "), F.lit("")).alias("k")))
    empty = F.array().cast("array<struct<s:string,k:string>>")
    kept = F.aggregate(found, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)))
    return F.array_join(F.transform(kept, lambda x: x["s"]), "\n")


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def highlight(text: Column, query: Column) -> Column:
    """HTML of ``text`` with the words of ``query`` marked, longest first, regardless of case."""
    words = F.array_distinct(F.filter(F.split(clean_text(query), " "), lambda w: w != ""))
    quoted = F.transform(words, lambda w: F.struct(-F.length(w), F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|])", r"\\$1").alias("w")))
    pattern = F.array_join(F.transform(F.array_sort(quoted), lambda x: x["w"]), "|")
    marked = F.when(pattern == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?i)("), pattern, F.lit(")")), F.lit("\u0001$1\u0002")))
    return F.replace(F.replace(escape_html(marked), F.lit("\u0001"), F.lit("<mark>")), F.lit("\u0002"), F.lit("</mark>"))
