"""Personal data: exact patterns, and information-theoretic sanitisation of the terms that disclose them; DataFrame operations only.

Protected entities are the addresses and numbers that the patterns find.  A term of a document with an entity discloses it
as far as knowing the term removes doubt about the entity: D(t, e) = min(1, PMI(t; e) / IC(e)) * (1 - 2 ** (1 - n)), with document probabilities
over the whole corpus and n the documents that hold both.  The first factor is 1 if the term occurs only with the entity and 0 if the two
are independent.  The second shrinks what rests on few documents: each further one halves the doubt, and a single one is
no evidence, for any rare word of a document would pass then.  Terms with D >= REMOVE are removed wherever they stand in a document with
the entity, those with D >= GENERALISE are replaced by their class (number, code, name or word).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import keep

KINDS = ("email", "ip", "card", "phone")
#: The base patterns as possessive forms that look at each character once (same matches: leftmost, longest, not overlapping).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+(?<=[0-9])",
}
IP_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
GENERALISE, REMOVE = 0.7, 0.9
TERM = r"[\p{L}\p{N}]{3,}"
#: Matches whose places are added up in one list; lists are joined afterwards, so long texts stay linear.
STEP = 128


# ---------------------------------------------------------------- base patterns
def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with their places in code points: array of (start, end, value)."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    # Running total: the gap before each match and the matches before it.
    steps = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("n"), v.alias("v")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), F.lit(STEP)), lambda i: F.slice(steps, i, STEP))
    own = F.transform(parts, lambda part: F.aggregate(
        part, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.struct((s["at"] + x["g"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["n"]).alias("end"), x["v"].alias("value")))).alias("out")),
    ))
    folded = F.aggregate(
        own, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(F.transform(x["out"], lambda m: F.struct((s["at"] + m["start"]).alias("start"), (s["at"] + m["end"]).alias("end"), m["value"].alias("value"))))).alias("out")),
    )
    return F.flatten(folded["out"])


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_RANGE)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: What a text must have for a pattern to be worth running.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def with_matches(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_email``, ``_ip``, ``_card`` and ``_phone``: the valid matches of each kind."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    for kind in KINDS:
        maybe = F.col(text).contains(NEEDS[kind]) & F.col(text).rlike(r"[0-9]" if kind != "email" else "@")
        df = df.withColumn(f"_{kind}", F.when(maybe, located(F.col(text), PATTERNS[kind])).otherwise(none))
        df = df.withColumn(f"_{kind}", _kept(F.col(f"_{kind}"), kind))
    return df


def _kept(matches: Column, kind: str) -> Column:
    return F.filter(matches, lambda m: _valid(kind, m["value"]))


def spans(df: DataFrame) -> Column:
    """Base spans of all kinds in the order of KINDS, then start: array of (kind, start, end, value)."""
    return F.concat(*(F.transform(f"_{k}", _with_kind(k)) for k in KINDS))


def _with_kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# ---------------------------------------------------------------- disclosure
def own_terms(entities: DataFrame) -> DataFrame:
    """_row, term, start, end, value: every term of a document that has an entity, outside of the base spans.

    ``entities`` has _row, _text, _spans.
    """
    term = entities.select("_row", F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_taken"), F.explode(located(F.col("_text"), TERM)).alias("m"))
    free = term.filter(~F.exists("_taken", lambda t: (t["start"] < F.col("m.end")) & (F.col("m.start") < t["end"])))
    return free.select("_row", F.lower("m.value").alias("term"), "m.start", "m.end", "m.value")


def least_documents(least: float) -> int:
    """The fewest common documents with which a term can disclose anything at ``least``."""
    n = 1
    while n < 60 and 1 - 2.0 ** (1 - n) < least:
        n += 1
    return n


def disclosure(docs: DataFrame, places: DataFrame, entities: DataFrame, least: float = GENERALISE) -> DataFrame:
    """_row, term, disclosure: the terms of each document that disclose one of its entities at or above ``least``, by the entity they disclose most.

    ``docs`` has _text (all rows), ``places`` _row and term, ``entities`` _row and _spans.  Terms and entities that no count could lift to
    ``least`` are left out before anything is paired.
    """
    total, few = docs.count(), least_documents(least)
    own = entities.select("_row", F.explode(F.array_distinct(F.transform("_spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))).alias("entity"))
    n_entity = keep(own.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= few), "entity-counts")
    # Even if every document of the entity has the term, D >= least needs n_term <= total ** (1 - least) * n_entity ** least.
    most = F.pow(F.lit(float(total)), F.lit(1 - least)) * F.pow(F.col("n_entity"), F.lit(least)) * 1.000001
    bound = n_entity.agg(F.max(most)).first()[0] or 0.0
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(TERM), F.lit(0)))).alias("term"))
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).filter(F.col("n_term").between(few, bound))
    met = own.join(n_entity, "entity").join(places.select("_row", "term").distinct().join(n_term, "term"), "_row")
    pairs = keep(met.filter(F.col("n_term") <= most), "term-pairs")
    both = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= few)
    content = -F.log2(F.col("n_entity") / F.lit(total))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    sure = F.lit(1.0) - F.pow(F.lit(2.0), F.lit(1) - F.col("n_both"))
    told = both.select("entity", "term", F.when(content > 0, F.least(F.lit(1.0), pmi / content) * sure).otherwise(0.0).alias("disclosure")).filter(F.col("disclosure") >= least)
    return pairs.select("_row", "entity", "term").join(told, ["entity", "term"]).groupBy("_row", "term").agg(F.max("disclosure").alias("disclosure"))


# ---------------------------------------------------------------- documents
def find(docs: DataFrame, text: str = "text", key: str = "doc_id", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, _base (spans), _terms (spans of disclosing terms with their action).

    Rows are told apart by key and text: rows equal in both share their terms.  A null text is an empty one; a null key is
    a key.  An empty table gives an empty result.  Columns other than ``text`` and ``key`` are not read.
    """
    one = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    located_ = with_matches(one, "_text")
    base = located_.select("_key", "_text", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), spans(located_).alias("_base"))
    row = F.struct(F.col("_key"), F.xxhash64("_text"))
    with_any = base.filter(F.size("_base") > 0).select(row.alias("_row"), "_text", F.col("_base").alias("_spans"))
    entities = keep(with_any.dropDuplicates(["_row"]), "entities")
    places = keep(own_terms(entities), "own-terms")
    told = disclosure(one, places, entities, generalise)
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    terms = places.join(told, ["_row", "term"]).select("_row", F.struct(F.lit("term").alias("kind"), "start", "end", "value", action.alias("action")).alias("t"))
    by_row = terms.groupBy("_row").agg(F.array_sort(F.collect_list("t")).alias("_terms"))  # bounded by the words of one text
    marked = by_row.select(F.col("_row._key").alias("_other"), F.col("_row.col2").alias("_other_text"), "_terms")
    met = base.withColumn("_hash", F.xxhash64("_text")).join(marked, F.col("_key").eqNullSafe(F.col("_other")) & (F.col("_hash") == F.col("_other_text")), "left")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,action:string>>")
    return met.select(F.col("_key").alias(key), "_text", *(f"n_{k}" for k in KINDS), "_base", F.coalesce("_terms", empty).alias("_terms"))


def _class(value: Column) -> Column:
    digit, letter = value.rlike(r"\p{N}"), value.rlike(r"\p{L}")
    return F.when(digit & ~letter, "[number]").when(digit, "[code]").when(value.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")


def sanitised(found: DataFrame) -> Column:
    """The text with base spans replaced by their kind in brackets, disclosing terms removed or replaced by their class in brackets."""
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("to")))
    terms = F.transform("_terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise(_class(s["value"])).alias("to")))
    ordered = F.array_sort(F.concat(base, terms))
    folded = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(s["out"], F.array(F.substring("_text", s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"])), F.when(x["start"] >= s["at"], x["to"]).otherwise(""))).alias("out"))),
    )
    rest = F.substring("_text", folded["at"] + 1, F.length("_text"))
    return F.when(F.size(ordered) == 0, F.col("_text")).otherwise(F.concat(F.array_join(folded["out"], ""), rest))
