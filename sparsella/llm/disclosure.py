"""Personal data by patterns, and by what the corpus discloses: DataFrame functions only.

Base findings are emails, IP addresses, payment cards and phone numbers. Protected entities are each
distinct value, its provider (domain, network, issuer or area, so that values seen once or twice count
too) and its kind. A term reveals an entity as far as their co-occurrence in documents exceeds chance:
with n rows, PMI(t; e) = log(n * n_te / (n_t * n_e)), and the share of the entity's information that the
term discloses is PMI / IC(e), IC(e) = log(n / n_e) (after Sanchez and Batet, 2016). A term that goes with an entity in SUPPORT
differing contexts (the terms near its first finding in a document, which copies share), more often than
chance would bring about for any of the pairs looked at (Chernoff's bound of the Poisson tail, divided by
their number, below CHANCE), and that discloses THRESHOLD of it or more is a finding of kind `term` wherever it stands; from REMOVE on it is
removed from sanitised text, below it is generalised to the kind of data that it reveals.

Defined results: null texts are empty; a row without findings has zero counts and empty spans; equal
rows get equal results, and each counts; a term inside a base finding is not a finding of its own and reveals nothing; extra
columns are left alone, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, row_key, settled, stored, whole_row

#: Differing contexts that a term needs, shares of an entity's information for a finding and for removal, code points and terms of context on each side, most rows of terms that are broadcast.
SUPPORT, THRESHOLD, REMOVE, REACH, NEAREST, BROADCAST_ROWS = 3, 0.6, 0.9, 160, 8, 200_000
#: Probability that any term of a corpus is flagged by chance.
CHANCE = 0.01
KINDS = ("email", "ip", "card", "phone")
# The patterns of the base findings. Quantifiers are possessive and starts anchored where that changes no match, so that no text takes quadratic time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.split(F.reverse(digits), "")
    worth = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)),
    "card": lambda x: _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}
#: What a text must hold to be searched for a kind at all.
MAY = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}


def _pieces(text: Column, pattern: str) -> Column:
    """Matches of a pattern with the texts before and after each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # Zipped, so that each array is made once: inside a lambda it would be made anew for each match.
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), g.alias("before")))
    both = F.zip_with(pairs, F.slice(gaps, 2, 1 << 30), lambda p, after: F.struct(p["value"].alias("value"), F.length(p["before"]).alias("gap"), F.right(p["before"], F.lit(REACH)).alias("before"), F.left(after, F.lit(REACH)).alias("after")))
    return F.filter(both, lambda x: x["value"].isNotNull())


def base_findings(docs: DataFrame) -> DataFrame:
    """key, rows (how many have it), kind (by number), value, start, end, before and after of the valid base findings; equal rows once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<value:string,gap:int,before:string,after:string>>")
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.when(MAY[k](text), _pieces(text, PATTERNS[k])).otherwise(none).alias("found")) for i, k in enumerate(KINDS)])
    rows = docs.select(row_key().alias("key"), F.explode_outer(each).alias("x"))
    rows = rows.select("key", "x.kind", F.posexplode_outer("x.found").alias("at", "y")).where("at is not null").select("key", "kind", "at", "y.*")
    rows = rows.groupBy("key", "kind", "at").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("value", "gap", "before", "after")])
    ends = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("key", "kind").orderBy("at"))
    valid = F.coalesce(*[F.when(F.col("kind") == i, VALID[k](F.col("value"))) for i, k in enumerate(KINDS)])
    return rows.withColumn("end", ends).where(valid).select("key", "rows", "kind", "value", (F.col("end") - F.length("value")).alias("start"), "end", "before", "after")


def _entities() -> Column:
    """The entities that a finding belongs to: its value, its provider and its kind."""
    kind, digits = F.col("kind"), _digits(F.col("value"))
    value = F.when(kind == 0, F.lower("value")).when(kind == 1, F.col("value")).otherwise(digits)
    provider = F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2)).when(kind == 2, F.left(digits, F.lit(6))).otherwise(F.left(digits, F.lit(4)))
    return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit("~"), provider), kind.cast("string"))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def disclosing_terms(docs: DataFrame, base: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """term, disclosure (the greatest over entities) and the kind of the entity it discloses most."""
    # A term cut off at REACH may be a part: the outermost is left out, the nearest are kept.
    left, right = _terms(F.col("before")), _terms(F.col("after"))
    left = F.when(F.length("before") >= REACH, F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    right = F.when(F.length("after") >= REACH, F.slice(right, 1, F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    near = F.concat(F.slice(F.reverse(left), 1, NEAREST), F.slice(right, 1, NEAREST))
    met = base.select("key", "rows", "kind", "start", F.xxhash64(near).alias("near"), F.explode(_entities()).alias("entity"))
    met = met.groupBy("key", "kind", "entity").agg(F.first("rows").alias("rows"), F.min_by("near", "start").alias("context"))
    strong = few(met.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support).select("entity", "n_e"))
    met = stored(met.join(strong, "entity"), "met")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(row_key().alias("key"), "text").join(few(met.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).select("key", F.array_distinct(_terms(F.regexp_replace(text, PATTERNS["email"], " "))).alias("terms"))  # the other kinds hold no letters
    both = held.join(met, "key").select("kind", "entity", "n_e", "rows", "context", F.explode("terms").alias("term"))
    pairs = both.groupBy("term", "entity", "kind", "n_e").agg(F.sum("rows").alias("n_te"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support)
    pairs = stored(pairs, "pairs")
    candidates = few(pairs.select("term").distinct())
    n = docs.agg(F.count("*").alias("n"))
    counts = docs.select(F.explode(F.array_distinct(_terms(text))).alias("term")).join(candidates, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    rated = pairs.join(counts, "term").crossJoin(F.broadcast(n))  # one row
    pmi, ic = F.log(F.col("n") * F.col("n_te") / (F.col("n_t") * F.col("n_e"))), F.log(F.col("n") / F.col("n_e"))
    odds = F.col("n_te") * pmi - F.col("n_te") + F.col("n_t") * F.col("n_e") / F.col("n")
    rated = rated.where(odds >= math.log(max(1, pairs.count()) / CHANCE)).withColumn("disclosure", F.when(ic > 0, pmi / ic)).where(F.col("disclosure") >= threshold)
    return rated.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max_by("kind", F.struct("disclosure", F.col("entity"))).alias("reveals"))


def findings(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """key, kind (4: term), start, end, disclosure and reveals of base findings and disclosing terms."""
    base = stored(base_findings(docs), "base")
    terms = settled(lambda: disclosing_terms(docs, base, support, threshold), "terms")
    found = base.select("key", "kind", "start", "end", F.lit(None).cast("double").alias("disclosure"), F.col("kind").alias("reveals"))
    n_terms = terms.count()
    if not n_terms:
        return found
    flagged = F.broadcast(terms) if n_terms <= BROADCAST_ROWS else terms
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(row_key().alias("key"), F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term")).join(flagged.select("term"), "term", "left_semi").select("key").distinct()
    pieces = docs.select(row_key().alias("key"), "text").join(held, "key", "left_semi").select("key", F.posexplode_outer(F.transform(_pieces(text, TERM), lambda p: F.struct(p["value"].alias("value"), p["gap"].alias("gap")))).alias("at", "y")).select("key", "at", "y.*").dropDuplicates(["key", "at"])
    placed = pieces.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("key").orderBy("at")))
    marked = placed.withColumn("term", F.lower("value")).join(flagged, "term").select("key", F.lit(4).alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end", "disclosure", "reveals")
    inside = base.select(F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    return found.unionByName(marked.join(inside, (F.col("key") == F.col("k")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans; spans_found keeps them as an array."""
    spans = findings(docs, **how).groupBy("key").agg(
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.struct("kind", "start", "end", "disclosure", "reveals"))).alias("found"),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key")).join(spans, "key", "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint,disclosure:double,reveals:int>>"))
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.filter(found, lambda x: x["kind"] < 4)), 256).alias("base_sha256"), _joined(found).alias("spans"))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """docs with base findings replaced by their kind in brackets, and disclosing terms generalised to what they reveal or removed."""
    names = F.array(*map(F.lit, KINDS))
    spans = findings(docs, **how).withColumn("put", F.when(F.col("kind") < 4, F.concat(F.lit("["), F.get(names, F.col("kind")), F.lit("]"))).when(F.col("disclosure") >= REMOVE, F.lit("")).otherwise(F.concat(F.lit("[of "), F.get(names, F.col("reveals")), F.lit("]"))))
    spans = spans.groupBy(F.col("key").alias("span_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("span_list"))
    rows = docs.select(whole_row(docs)).join(spans, row_key("doc.") == F.col("span_key"), "left")
    text = F.col("doc.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), x["put"])).alias("out")))
    done = F.aggregate("span_list", start, step)
    new = F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return rows.select(*[F.when(F.col("span_list").isNull(), text).otherwise(new).alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
