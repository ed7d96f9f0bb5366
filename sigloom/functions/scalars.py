"""Scalar functions over strings, arrays and sets; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The residues of a signature; a gap counts as one.
ALPHABET = "-ACDEFGHIKLMNPQRSTVWY"
#: What references to articles start with.
REFERENCE_PREFIX = r"^(?i:https?://(dx\.)?doi\.org/|https?://(www\.)?ncbi\.nlm\.nih\.gov/pubmed/|https?://pubmed\.ncbi\.nlm\.nih\.gov/|doi:|pmid:)"
DOI, PMID = r"^10\.[0-9]{4,9}/\S+$", r"^[0-9]{1,8}$"


def padded(value: Column, size: int) -> Column:
    """Upper-cased, cut to size or filled up with gaps."""
    return F.rpad(F.upper(F.substring(F.coalesce(value, F.lit("")), 1, size)), size, "-")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of equal length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Null for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def same_set(values: Column) -> Column:
    """Equal for equal sets; to be joined on."""
    return F.array_sort(F.array_distinct(values))


def bitvector(values: Column, selected: list[int]) -> Column:
    return F.array(*[F.array_contains(values, F.lit(x)).cast("int") for x in selected])


def replaced(text: Column, some: str, others: str) -> Column:
    """As translate, for a few characters none of which is put in for another: each is a quick scan of the whole text."""
    for a, b in zip(some, others):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def letters(text: Column) -> Column:
    """All letters of a text as residues."""
    return replaced(F.upper(F.regexp_replace(text, "[^A-Za-z]+", "")), "BJOUXZ", "ACDEFG")


def residues(text: Column, size: int) -> Column:
    """Letters of a text as residues, the first size of them; what follows these isn't looked at."""
    return letters(F.regexp_extract(text, f"^(?:[^A-Za-z]*[A-Za-z]){{0,{size}}}", 0))


def valid_alphabet(sequence: Column) -> Column:
    return sequence.rlike("^[ACDEFGHIKLMNPQRSTVWY-]+$")


def features(sequence: Column, properties: dict[str, list[float]]) -> Column:
    """The residues' properties in a row; an unknown residue raises."""
    table = F.array(*[F.array(*map(F.lit, v)) for v in properties.values()])
    known = lambda c: F.coalesce(F.get(table, F.instr(F.lit("".join(properties)), c) - 1), F.raise_error(F.concat(F.lit("unknown residue "), c)))
    return F.flatten(F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), known))


def protein_of(synonym: Column) -> Column:
    """What stands before the last dot; nothing if there is none."""
    return F.when(synonym.contains("."), F.regexp_replace(synonym, r"\.[^.]*$", "")).otherwise(F.lit(""))


def domain_number(synonym: Column) -> Column:
    """n of ``{protein}.A{n}``; raises for other forms."""
    number = F.regexp_extract(synonym, r"^.*\.A(\d+)$", 1)
    return F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a domain name: "), synonym)).cast("int"))


def display_name(name: Column) -> Column:
    """What stands before the first white space."""
    return F.split(F.trim(name), r"\s+")[0]


def header(name: Column, number: Column, start: Column, end: Column, s1: str = "|", s2: str = "_", s3: str = "-") -> Column:
    return F.concat(name, F.lit(f"{s1}domain{s2}"), number.cast("string"), F.lit(s1), start.cast("string"), F.lit(s3), end.cast("string"))


def fenced_json(body: Column) -> Column:
    """The body if it is JSON itself, else its first fenced block that is. What can't begin JSON isn't parsed: a failed parse costs far more than a look at the beginning."""
    block = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    is_json = lambda x: x.rlike(r'^\s*(?:[\[{"0-9-]|true|false|null)') & F.try_parse_json(x).isNotNull()
    return F.get(F.filter(F.array(body, block), is_json), 0)


def orcid_valid(value: Column) -> Column:
    """Sixteen characters whose last is the ISO 7064 mod 11-2 check of the others; a URL before them and dashes are dropped."""
    plain = F.upper(F.regexp_replace(F.regexp_replace(value, r"^https?://orcid\.org/", ""), "-", ""))
    total = F.aggregate(F.split(F.substring(plain, 1, 15), ""), F.lit(0), lambda s, c: (s + F.coalesce(c.try_cast("int"), F.lit(0))) * 2)
    check = F.pmod(F.lit(12) - F.pmod(total, F.lit(11)), F.lit(11))
    return plain.rlike("^[0-9]{15}[0-9X]$") & (F.substring(plain, 16, 1) == F.when(check == 10, F.lit("X")).otherwise(check.cast("string")))


def reference_tokens(text: Column, most: int = 20) -> Column:
    """Distinct DOIs and PubMed ids of a free text, in order, twenty at most."""
    tokens = F.transform(F.split(text, r"[\s,;]+"), lambda t: F.regexp_replace(t, REFERENCE_PREFIX, ""))
    return F.slice(F.array_distinct(F.filter(tokens, lambda t: t.rlike(DOI) | t.rlike(PMID))), 1, most)


def annotation_type(matched: Column, named: Column, same: Column, custom: Column) -> Column:
    return F.when(matched & same & ~custom, "duplicate").when(matched & named & ~same, "correction").when(matched, "no_update").otherwise("new")


def equivalent(a: Column, b: Column, share: float = 0.8) -> Column:
    """One sequence holds the other, or a suffix of one is a prefix of the other over at least that share of the shorter."""
    shorter = F.least(F.length(a), F.length(b))
    sizes = F.sequence(F.greatest(F.floor(shorter * share).cast("int"), F.lit(1)), F.greatest(shorter, F.lit(1)))
    over = lambda x, y: F.exists(sizes, lambda k: F.right(x, k) == F.left(y, k))
    return a.contains(b) | b.contains(a) | over(a, b) | over(b, a)


def register(spark: SparkSession) -> None:
    """The functions that SQL users get."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming10(a STRING, b STRING) RETURNS INT RETURN aggregate(zip_with(split(rpad(upper(left(a, 10)), 10, '-'), ''), split(rpad(upper(left(b, 10)), 10, '-'), ''), (x, y) -> if(x <> y, 1, 0)), 0, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jaccard(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE RETURN size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0)")
