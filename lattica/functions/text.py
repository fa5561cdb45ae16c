"""Text functions as Columns; Python only where Unicode normalisation needs it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Results depend on each of these.
TRIM_CHARS = ".,-·'\"“”‘’`"
SELF_REFERENCES = [
    "we", "us", "our", "the company", "company", "the corporation", "corporation", "the registrant", "registrant",
    "the parent", "parent", "the issuer", "issuer", "management", "the board", "board",
    "당사", "회사", "본사", "본 회사", "본 법인", "본인", "주식회사",
    "findings", "results", "data", "methods", "conclusions",
]
DEIXIS = (
    r"^(?:(?:the|this|that|these|those|our|its|their|present|current|a|an)\s+)+"
    r"(?:stud(?:y|ies)|papers?|reports?|articles?|manuscripts?|research|findings?|results?|datasets?|data|methods?|"
    r"methodolog(?:y|ies)|analys[ie]s|investigations?|works?|approach(?:es)?|documents?|observations?|reviews?|"
    r"hypothes[ie]s|conclusions?|aims?|assays?|protocols?|procedures?|process(?:es)?|experiments?|trials?)$"
)
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9-]{2,18}[A-Za-z0-9]$"
KEYWORD = r"(?U)\b([A-Z][A-Za-z0-9_\-]{1,}|[가-힣]{2,})\b"
TRIVIAL = ["The", "This", "That", "These", "Those", "Inc", "Ltd", "Corp", "Co", "Company", "FY", "Q1", "Q2", "Q3", "Q4", "Note", "Notes", "Item", "그것", "이것", "저것", "여기", "거기"]

_SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize(text: Column, *, unicode: bool = True) -> Column:
    """Canonical form of a name: NFC, lower case, single spaces, outer punctuation of TRIM_CHARS off; null is empty.

    unicode=False stays in the JVM and is exact for texts that are in NFC already.
    """
    t = F.coalesce(text, F.lit(""))
    # Texts of ASCII are in NFC; what is passed for them is null, which costs Python next to nothing.
    t = F.coalesce(nfc(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t) if unicode else t
    t = F.regexp_replace(F.lower(t), _SPACE, " ")
    t = F.btrim(F.btrim(t), F.lit(TRIM_CHARS))
    return F.btrim(t)


def is_self_reference(normalized: Column) -> Column:
    return normalized.isin(SELF_REFERENCES) | normalized.rlike(DEIXIS)


def is_identifier(token: Column) -> Column:
    """A code: 4 to 20 ASCII letters, digits and hyphens, a letter and three digits at least."""
    t = F.btrim(token, F.lit(".,'\"()"))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return F.length(t).between(4, 20) & t.rlike(IDENTIFIER) & t.rlike("[A-Za-z]") & (digits >= 3)


def distinct_by(values: Column, key) -> Column:
    """The first of each key, in order; values whose key is empty are dropped."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("keys"), empty.alias("values"))

    def step(a: Column, v: Column) -> Column:
        k = key(v)
        known = (k == "") | F.array_contains(a["keys"], k)
        return F.struct(F.when(known, a["keys"]).otherwise(F.array_append(a["keys"], k)).alias("keys"), F.when(known, a["values"]).otherwise(F.array_append(a["values"], v)).alias("values"))

    return F.aggregate(values, start, step, lambda a: a["values"])


def identifier_aliases(name: Column) -> Column:
    """Codes in a name: those in parentheses first, then the others; one of each spelling."""
    n = F.coalesce(name, F.lit(""))
    inside = F.flatten(F.transform(F.regexp_extract_all(n, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda p: F.split(p, r"[\s,;/]+")))
    tokens = F.transform(F.concat(inside, F.split(n, r"[\s,;/]+")), lambda t: F.btrim(t, F.lit(".,'\"()")))
    return distinct_by(F.filter(tokens, is_identifier), F.lower)


def alias_union(a: Column, b: Column) -> Column:
    """Both lists, the first spelling of each normalised form."""
    none = F.array().cast("array<string>")
    return distinct_by(F.concat(F.coalesce(a, none), F.coalesce(b, none)), lambda v: normalize(v, unicode=False))


def search_text(name: Column, aliases: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda t: F.btrim(F.coalesce(t, F.lit(""))) != ""), " ")


def one_line(text: Column, most: int = 180) -> Column:
    t = F.btrim(F.regexp_replace(text, _SPACE, " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit("…")))


def head_lines(text: Column, lines: int = 60) -> Column:
    return F.array_join(F.slice(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), 1, lines), "\n")


def lenient_json(text: Column, schema: str | None = None) -> Column:
    """The body of a fenced JSON answer; with a schema, what it says in it, null where it is no such JSON."""
    body = F.regexp_replace(F.regexp_replace(F.btrim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return body if schema is None else F.from_json(body, schema)


def keywords(text: Column) -> Column:
    """All keywords of a text as they occur: capitalised Latin words and runs of Hangul, without the trivial ones."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEYWORD))
    return F.filter(found, lambda k: ~k.isin(TRIVIAL))


def top_keywords(docs: DataFrame, most: int = 6, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keyword, n: the commonest keywords of each text, equally common ones by name."""
    found = docs.select(key, F.explode(keywords(F.col(text))).alias("keyword"))
    ranked = Window.partitionBy(key).orderBy(F.col("n").desc(), "keyword")
    return found.groupBy(key, "keyword").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= most).drop("k")


def source_ref_union(a: Column, b: Column) -> Column:
    """Both lists of (source_path, chunk_index, ...), the first of each source and chunk."""
    key = lambda r: F.concat(r["source_path"], F.lit("\x00"), F.coalesce(r["chunk_index"].cast("string"), F.lit("")))
    both = F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
    keys = F.transform(both, key)
    return F.filter(F.transform(both, lambda r, i: F.when(F.array_position(keys, key(r)) == i + 1, r)), lambda r: r.isNotNull())


def clamp(text: Column, most: int) -> Column:
    """At most the first characters; null stays null."""
    return F.left(text, F.lit(most))


def price_key(model: Column) -> Column:
    """The second name that a model's price is looked up by: that of its default vendor, if it names none."""
    return F.when(~model.contains("/"), F.concat(F.lit("openai/"), model))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; 0 for empty ones, different lengths and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def fingerprint(prompt: Column, schema: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", prompt, schema, model).cast("binary"), 256), 1, 16)


def extractor_version(pipeline: int, prompt: Column, schema: Column, model: Column) -> Column:
    """p, the pipeline's number, and the fingerprint of what the extractor is asked."""
    return F.concat(F.lit(f"p{pipeline}:"), fingerprint(prompt, schema, model))
