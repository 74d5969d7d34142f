"""Rule-based entities of a query text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusline.functions.text import col, filled

# The domains by name, and the words by which a query's domain is told, in order of precedence.
DOMAINS = {
    "Юристы": ["договор", "контракт", "соглашение", "юридический", "правовой"],
    "Логистика": ["поставка", "доставка", "отгрузка", "транспорт", "логистика"],
    "Закупки": ["закупка", "тендер", "конкурс", "поставщик", "снабжение"],
    "Производство": ["производство", "цех", "линия", "изготовление", "выпуск"],
    "Финансы": ["оплата", "счет", "бюджет", "финансы", "расчет"],
    "HR": ["сотрудник", "вакансия", "персонал", "кадры", "hr"],
}
# Trade terms, units by their full names, and patterns (each list in its order).
INCOTERMS = ["EXW", "FCA", "CPT", "CIP", "DAT", "DAP", "DDP", "FAS", "FOB", "CFR", "CIF"]
UNIT_NAMES = {"т": "тонн", "кг": "килограмм", "шт": "штук", "куб.м": "м3"}
STANDARDS = [r"(?iu)ГОСТ\s*[\d\-\.]+", r"(?iu)ТУ\s*[\d\-\.]+"]
DATES = [r"\d{1,2}[\./]\d{1,2}[\./]\d{2,4}", r"\d{4}[-\.]\d{1,2}[-\.]\d{1,2}", r"(?U)до\s+\d{1,2}\s+\w+\s+\d{4}"]
QUANTITY = r"(?iu)(\d+(?:\.\d+)?)\s*(тонн|т|кг|м3|куб\.м|шт|штук)"
IDENTIFIERS = [r"(?iu)№\s*[\d\-/]+", r"(?iu)договор\s+[\d\-/]+", r"(?iu)контракт\s+[\d\-/]+"]
ORGANISATIONS = [r"ООО\s+\"[^\"]+\"", r"(?U)ООО\s+\w+", r"АО\s+\"[^\"]+\"", r"(?U)АО\s+\w+", r"ПАО\s+\"[^\"]+\"", r"(?U)ПАО\s+\w+"]
#: An addition of this engine: names in guillemets, which a tagger of names would find and the patterns above don't.
QUOTED_ORGANISATION = r"(?<![\p{L}])(?:ООО|ПАО|ЗАО|АО)\s+«[^»]+»"
STATION_WORD = "станци"
# Confidence of what a rule finds.
CONFIDENCE = {"domain": 0.9, "quantity": 0.95, "location": 0.8, "actors": 0.7}


def matches(text: str | Column, *patterns: str) -> Column:
    """The matches of each pattern in turn, in order of occurrence; none for a null text."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(p), 0) for p in patterns])


def domain(text: str | Column) -> Column:
    """The first domain with a keyword in the text, as a part of any word; null without one."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, keys in reversed(DOMAINS.items()):
            some = F.contains(low, F.lit(keys[0]))
            for k in keys[1:]:
                some = some | F.contains(low, F.lit(k))
            out = F.when(some, name).otherwise(out)
        return out

    # bound, so that the text is lower-cased once and not for every word
    return F.transform(F.array(F.lower(col(text))), first)[0]


def standards(text: str | Column) -> Column:
    return F.array_distinct(matches(text, *STANDARDS))


def dates(text: str | Column) -> Column:
    """All matches of the last pattern that matches; repeats stay."""
    found = [matches(text, p) for p in reversed(DATES)]
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])


def quantity(text: str | Column) -> Column:
    """(value, unit) of the first number with a unit, usual units by their full name; null without one."""
    value = filled(F.regexp_extract(col(text), QUANTITY, 1))
    unit = F.regexp_extract(col(text), QUANTITY, 2)
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    return F.when(value.isNotNull(), F.struct(value.cast("double").alias("value"), F.coalesce(names[unit], unit).alias("unit")))


def incoterms(text: str | Column) -> Column:
    upper = F.upper(col(text))
    return F.filter(F.array(*map(F.lit, INCOTERMS)), lambda t: F.contains(upper, t))


def constraints(text: str | Column) -> Column:
    """The trade terms of the text as conditions."""
    return F.coalesce(F.transform(incoterms(text), lambda t: F.concat(F.lit("Инкотермс: "), t)), F.array().cast("array<string>"))


def identifiers(text: str | Column) -> Column:
    return F.array_distinct(matches(text, *IDENTIFIERS))


def organisations(text: str | Column) -> Column:
    return F.array_distinct(matches(text, *ORGANISATIONS, QUOTED_ORGANISATION))


def labelled(text: str | Column) -> Column:
    """All (kind, value) by which texts are indexed."""
    kinds = {"object_attributes": standards(text), "identifiers": identifiers(text), "actors": organisations(text), "domain": F.array_compact(F.array(domain(text)))}
    return F.flatten(F.array(*[F.transform(v, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("value"))) for k, v in kinds.items()]))


def stations(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, station, place): stations of the dictionary in the query; a destination where the word for station stands before it.

    dictionary: entry. A dictionary is bounded (some hundred entries) and is checked before it is broadcast.
    """
    names = dictionary.select(F.col("entry").alias("station")).distinct()
    if names.limit(10_001).count() <= 10_000:
        names = F.broadcast(names)
    # lower-cased once per text and once per name, before they meet
    names = names.withColumn("low_name", F.lower("station"))
    texts = queries.withColumn("low", F.lower("query")).withColumn("before", F.instr("low", STATION_WORD))
    found = texts.crossJoin(names).filter(F.contains(F.col("low"), F.col("low_name")))
    behind = (F.col("before") > 0) & (F.col("before") < F.expr("instr(low, low_name)"))
    return found.select("query_id", "station", F.when(behind, "destination").otherwise("origin").alias("place"))


def locations(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, location): origin and destination by name; of several stations the last by name."""
    found = stations(queries, dictionary).groupBy("query_id").agg(*[F.max(F.when(F.col("place") == p, F.col("station"))).alias(p) for p in ("origin", "destination")])
    return found.select("query_id", F.struct("origin", "destination").alias("location"))


def extract(queries: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(query_id, domain, object_attributes, raw_dates, quantity, incoterms, constraints, identifiers, actors, location, confidences): absent ones null or empty.

    dictionary: entry, the names of stations; without it there are no locations.
    """
    q = F.col("query")
    out = queries.select(
        "query_id", domain(q).alias("domain"), standards(q).alias("object_attributes"), dates(q).alias("raw_dates"), quantity(q).alias("quantity"), incoterms(q).alias("incoterms"), constraints(q).alias("constraints"),
        identifiers(q).alias("identifiers"), organisations(q).alias("actors"),
    )
    if dictionary is None:
        out = out.withColumn("location", F.lit(None).cast("struct<origin:string,destination:string>"))
    else:
        out = out.join(locations(queries, dictionary), "query_id", "left")
    found = {"domain": F.col("domain").isNotNull(), "quantity": F.col("quantity").isNotNull(), "location": F.col("location").isNotNull(), "actors": F.size("actors") > 0}
    marks = F.map_from_entries(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), F.lit(CONFIDENCE[k]).alias("value"))) for k, c in found.items()])))
    return out.withColumn("confidences", marks)


def merge_model(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Entities with those of a model merged in: its domain overrides where valid, lists are appended without repeats.

    model: query_id, domain, and any of object_attributes, actors, identifiers, constraints (arrays may be null).
    """
    lists = ("object_attributes", "actors", "identifiers", "constraints")
    known = [c for c in lists if c in model.columns and c in rules.columns]
    other = model.select("query_id", F.col("domain").alias("m_domain"), *[F.col(c).alias(f"m_{c}") for c in known])
    empty = F.array().cast("array<string>")
    joined = rules.join(other, "query_id", "left").withColumn("domain", F.when(F.col("m_domain").isin(*DOMAINS), F.col("m_domain")).otherwise(F.col("domain")))
    for c in known:
        joined = joined.withColumn(c, F.array_distinct(F.concat(c, F.coalesce(f"m_{c}", empty))))
    return joined.drop("m_domain", *[f"m_{c}" for c in known])


def present(entities: DataFrame) -> DataFrame:
    """(query_id, field, value): the filled fields as JSON, null and empty ones left out. Sets are listed in alphabetical order, dates as they occur."""
    pairs = [F.struct(F.lit(c).alias("field"), F.when(F.size(c) > 0, F.to_json(c if c in ("raw_dates", "constraints") else F.array_sort(c))).alias("value")) for c in ("object_attributes", "raw_dates", "constraints", "identifiers", "actors")]
    pairs += [F.struct(F.lit("domain").alias("field"), F.col("domain").alias("value"))]
    pairs += [F.struct(F.lit(c).alias("field"), F.to_json(c).alias("value")) for c in ("quantity", "location")]
    return entities.select("query_id", F.explode(F.array(*pairs)).alias("x")).select("query_id", "x.field", "x.value").filter("value is not null")
