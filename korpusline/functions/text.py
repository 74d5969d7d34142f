"""Column functions on text, tokens, headings and keys; all run in the JVM (those with lambdas outside of generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on. Repeated groups are possessive, as nothing follows them that could
# need a part of them back: else the JVM's matcher recurses once a repeat, and a long number ends the executor.
NUMBERED_HEADING = r"(?iu)^\s*(?:(?:раздел|глава|приложение)\s+\d+|\d+(?:\.\d+){0,3})\s*[).]?\s+\S"
CAPITALS = r"[А-ЯA-Z]{3,}"
SECTION_WORD = r"(?iu)^\s*(?:раздел|глава|приложение)\s+(\d+)"
LEADING_NUMBER = r"^\s*(\d+(?:\.\d+)*+)"
REFERENCE = r"(?iu)(?:раздел|глава|пункт)[а-я]*\s+(\d+(?:\.\d+)*+)"
NOT_A_TOKEN = r"[^a-zA-Zа-яА-Я0-9]+"
PATH_SEPARATORS = r"[/_\-.()\\]+"
SENTENCE_MARK = "\u0001"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column) -> Column:
    """Null for an empty string."""
    c = col(c)
    return F.when(c != "", c)


def squeeze(c: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"[\s\p{Z}]+", " "))


def normalise(c: str | Column) -> Column:
    """Lower case, ё as е, squeezed."""
    return squeeze(F.translate(F.lower(col(c)), "ё", "е"))


def tokens(c: str | Column) -> Column:
    """Tokens of letters a-z, а-я and digits; everything else separates. A null text has none."""
    return F.filter(F.split(F.coalesce(normalise(c), F.lit("")), NOT_A_TOKEN), lambda x: x != "")


def words(c: str | Column) -> Column:
    """Unicode words, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def path_text(c: str | Column) -> Column:
    """The parts of a path as words, without those of digits only; the extension stays."""
    parts = F.split(F.coalesce(col(c), F.lit("")), PATH_SEPARATORS)
    return F.array_join(F.filter(F.transform(parts, squeeze), lambda x: (x != "") & ~x.rlike(r"^\d+$")), " ")


def is_heading(c: str | Column) -> Column:
    """A numbered heading, or a short line in capitals. Null and short texts are none."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    capitals = (F.length(t) < 120) & (t == F.upper(t)) & t.rlike(CAPITALS)
    return (F.length(t) > 3) & (t.rlike(NUMBERED_HEADING) | capitals)


def heading_depth(c: str | Column) -> Column:
    """Dots in the leading number; 0 without a number."""
    number = F.regexp_extract(col(c), LEADING_NUMBER, 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")) - 1)


def section_number(c: str | Column) -> Column:
    """The leading number, or that after the word for a section; null without one."""
    c = col(c)
    return F.coalesce(filled(F.regexp_extract(c, LEADING_NUMBER, 1)), filled(F.regexp_extract(c, SECTION_WORD, 1)))


def hierarchy_level(path: str | Column) -> Column:
    """The most parts that a section number in the path has; 0 without one."""
    parts = F.transform(F.coalesce(col(path), F.array().cast("array<string>")), lambda h: F.when(section_number(h).isNull(), 0).otherwise(F.size(F.split(section_number(h), r"\."))))
    return F.coalesce(F.array_max(parts), F.lit(0))


def section_id(path: str | Column) -> Column:
    """`root` without headings; the first leading number; else the start of the first heading."""
    path = col(path)
    numbers = F.filter(F.transform(path, lambda h: F.regexp_extract(h, LEADING_NUMBER, 1)), lambda n: n != "")
    first = F.regexp_replace(F.substring(F.get(path, F.lit(0)), 1, 20), " ", "_")
    return F.when(path.isNull() | (F.size(path) == 0), "root").otherwise(F.coalesce(F.get(numbers, F.lit(0)), first))


def references(c: str | Column) -> Column:
    """Section numbers that an element with a leading number refers to, its own left out; repeats stay."""
    c = col(c)
    own = F.regexp_extract(c, LEADING_NUMBER, 1)
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.filter(F.regexp_extract_all(c, F.lit(REFERENCE), 1), lambda x: x != own))


def token_count(c: str | Column) -> Column:
    """max(1, floor(code points / 4))."""
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4)).cast("int")


def sentences(c: str | Column) -> Column:
    """Sentences: a text is cut after . ! ? … before white space, and at line ends; trimmed, none empty."""
    marked = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"([.!?…])\s+", "$1" + SENTENCE_MARK)
    return F.filter(F.transform(F.split(marked, "[\n" + SENTENCE_MARK + "]+"), lambda x: F.trim(x)), lambda x: x != "")


def doc_key(category: str | Column = "category", doc_id: str | Column = "doc_id", doc_path: str | Column = "doc_path") -> Column:
    """category (or UNK), `::`, doc_id or doc_path (or doc); empty strings count as missing."""
    return F.concat_ws("::", F.coalesce(filled(category), F.lit("UNK")), F.coalesce(filled(doc_id), filled(doc_path), F.lit("doc")))


def split_doc_key(c: str | Column) -> Column:
    """(category, document) at the first `::`."""
    parts = F.split(col(c), "::", 2)
    return F.struct(parts[0].alias("category"), F.get(parts, F.lit(1)).alias("document"))


def heading_preview(path: str | Column) -> Column:
    return F.array_join(F.slice(F.coalesce(col(path), F.array().cast("array<string>")), 1, 2), " > ")


def citation(category: str | Column, path: str | Column, page_from: str | Column, page_to: str | Column) -> Column:
    """category | path | p. N, or pp. a–b."""
    a, b = col(page_from), col(page_to)
    pages = F.when(a.isNull(), F.lit(None).cast("string")).when(b.isNull() | (a == b), F.concat(F.lit("p. "), a.cast("string"))).otherwise(F.concat(F.lit("pp. "), a.cast("string"), F.lit("–"), b.cast("string")))
    return F.concat_ws(" | ", filled(category), filled(path), pages)


def smart_truncate(c: str | Column, budget: int) -> Column:
    """The text where it fits the token budget; else its first sentences that fit; else its first characters."""
    c = col(c)
    parts = F.filter(F.transform(F.split(c, r"[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    fold = F.aggregate(
        parts,
        start,
        lambda acc, s: F.when(acc["full"] | (token_count(F.concat(acc["text"], s, F.lit(". "))) > budget), F.struct(acc["text"].alias("text"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(acc["text"], s, F.lit(". ")).alias("text"), F.lit(False).alias("full"))
        ),
        lambda acc: F.trim(acc["text"]),
    )
    return F.when(token_count(c) <= budget, c).when(fold == "", F.substring(c, 1, 4 * budget)).otherwise(fold)


def cut_tokens(c: str | Column, tokens_: int = 256) -> Column:
    """The first tokens, at four characters each."""
    return F.substring(col(c), 1, 4 * tokens_)


def word_hit_ratio(query: str | Column, content: str | Column) -> Column:
    """Share of the query's blank-separated words that occur in the content, as substrings."""
    asked = F.filter(F.split(F.lower(col(query)), r"\s+"), lambda w: w != "")
    # bound, so that both sides are lower-cased once and not for every word
    bound = F.array(F.struct(asked.alias("words"), F.lower(F.coalesce(col(content), F.lit(""))).alias("low")))
    hits = F.transform(bound, lambda s: F.size(F.filter(s["words"], lambda w: F.contains(s["low"], w))))[0]
    return F.when(F.size(asked) == 0, 0.0).otherwise(hits / F.size(asked))


def row_text(columns: dict[str, str | Column]) -> Column:
    """`name: value; name: value`, nulls left out."""
    return F.concat_ws("; ", *[F.when(col(c).isNotNull(), F.concat(F.lit(f"{name}: "), col(c).cast("string"))) for name, c in columns.items()])


def json_in_text(c: str | Column, schema: str) -> Column:
    """The outermost {…} of a text, parsed; null where there is none."""
    return F.from_json(filled(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)), schema)
