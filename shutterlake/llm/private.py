r"""Personal data and the terms that give it away.

Base findings are e-mail addresses, IP addresses, payment cards and phone numbers, found by pattern and checked by rule.
Around them works an information-theoretic sanitiser: each found value is a protected entity c, and the words of the
documents that mention it, however far from the mention, are the terms t. With n documents, of which n_c mention c, n_t hold
t and n_ct do both,

    disclosure(c, t) = PMI(c, t) / IC(c) = log(n_ct * n / (n_c * n_t)) / log(n / n_c),

that is the share of what there is to learn about c that t reveals; 1 means that t never stands without c. All four
counts cover all documents. Terms seen with c in at least `min_documents` documents are removed wherever they stand in a
document that mentions c from `remove_at` on, and generalised to a placeholder from `generalise_at` on. With fewer documents a
share tells nothing: each word that only the one document of an entity holds would have a share of 1.

Positions are found without row-wise code: the text is split at the matches, and the lengths of the pieces add up to
the offsets. The patterns are possessive and start only where a run starts, so they take linear time on any text and
find what the plain patterns of the contract find.

Edge cases: null and empty texts have no spans; spans are code points, end exclusive; repeated rows get equal results
and count as documents of their own; a term that one entity
removes and another generalises is removed; with one document, or an entity in every document, IC is 0 and nothing is
disclosed; an empty table gives an empty result; `sanitise` keeps all columns and renews n_chars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import KEY, let, settled, small_side, table, text_key, written

KINDS = ("email", "ip", "card", "phone")
#: Java patterns of the base findings.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no finding of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){16}", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: A word of letters that stands alone, so that no part of an address or a number is one.
TERM = r"(?<=\s)\p{L}[\p{L}\p{M}'’-]*+(?=[\s.,;:!?)])"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
_SPAN = "array<struct<start:int,stop:int,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    """Parameters of the sanitiser."""

    #: The context of a mention is its whole document; no text has more characters.
    context = 2**31 - 1
    min_documents: int = 3
    generalise_at: float = 0.7
    remove_at: float = 0.9


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their code point offsets, in order."""

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def lay(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.when(F.size(hits) == 0, F.array().cast(_SPAN)).otherwise(F.aggregate(pairs, zero, add, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lay)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_VALID)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Findings of one kind as an array of (start, stop, value)."""
    found = F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(_SPAN))


def _found(documents: DataFrame, *more: Column) -> DataFrame:
    """The documents' keys, texts and base findings by kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(*more, *text_key(), text.alias("whole"), *[base_spans(text, k).alias(k) for k in KINDS])


def _entity(kind: str, value: Column) -> Column:
    plain = {"email": F.lower, "ip": lambda v: v}.get(kind, _digits)
    return F.concat(F.lit(f"{kind}:"), plain(value))


def _names() -> Column:
    """The distinct entities of a row with its findings by kind."""
    def entities(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: _entity(kind, s["value"]))

    return F.array_distinct(F.concat(*[entities(k) for k in KINDS]))


def _masked() -> Column:
    """The text of a row with its findings by kind, padded by a blank on either side; the findings are masked, as no term is part of one."""
    spans = F.array_sort(F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"], s["stop"])) for k in KINDS]))
    whole = F.col("whole")

    def step(acc: Column, span: Column) -> Column:
        start, stop = F.greatest(span["start"], acc["at"]), F.greatest(span["stop"], acc["at"])
        piece = F.concat(F.substring(whole, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit("\u0001"), stop - start))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.lit(" "), F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole)), F.lit(" "))
    named = spans.cast("array<struct<start:int,stop:int>>")
    return F.aggregate(named, zero, step, rest)


def _mentioning(documents: DataFrame, limits: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(entity, n_c) of the entities in enough documents; (key, copies, names, padded) of each distinct text with such an entity."""
    found = _found(documents).where(" or ".join(f"size({k}) > 0" for k in KINDS))
    # Copies of a text combine before they shuffle.
    named = settled(found.select(*KEY, _names().alias("names")).groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("names").alias("names")))
    entities = settled(
        named.select("copies", F.explode("names").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_c"))
        .where(F.col("n_c") >= limits.min_documents))
    frequent = settled(
        named.select(*KEY, "copies", F.explode("names").alias("entity")).join(small_side(entities.select("entity")), "entity", "left_semi")
        .groupBy(*KEY, "copies").agg(F.collect_list("entity").alias("names")))
    texts = (
        found.join(small_side(frequent.select(*KEY)), KEY, "left_semi").select(*KEY, _masked().alias("padded"))
        .groupBy(*KEY).agg(F.first("padded").alias("padded"))
    )
    return entities, written(texts.join(frequent, KEY), "mentioning")


def _pairs(mentioning: DataFrame) -> DataFrame:
    """(key, copies, entity, term): the distinct terms of each text with each of its entities, which are few."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all("padded", F.lit(TERM), F.lit(0)), F.lower))
    return mentioning.select(*KEY, "copies", "names", F.explode(terms).alias("term")).select(*KEY, "copies", F.explode("names").alias("entity"), "term")


def _disclosing(documents: DataFrame, entities: DataFrame, mentioning: DataFrame, limits: Disclosure) -> DataFrame:
    """(entity, term, action) above the thresholds; every count covers all documents."""
    n = F.lit(documents.count())
    joint = _pairs(mentioning).groupBy("entity", "term").agg(F.sum("copies").alias("n_ct")).where(F.col("n_ct") >= limits.min_documents)
    padded = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))
    terms = (
        documents.select(F.explode(F.array_distinct(F.regexp_extract_all(padded, F.lit(TERM), F.lit(0)))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= limits.min_documents)
    )
    share = F.ln(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))) / F.ln(n / F.col("n_c"))
    return (
        joint.join(entities, "entity").join(terms, "term").where(F.col("n_c") < n)
        .withColumn("share", share).where(F.col("share") >= limits.generalise_at)
        .select("entity", "term", F.when(F.col("share") >= limits.remove_at, "remove").otherwise("generalise").alias("action"))
    )


def _term_spans(documents: DataFrame, limits: Disclosure) -> DataFrame:
    """One row per distinct text with disclosing terms: all their places and what is done to them, by start."""
    entities, mentioning = _mentioning(documents, limits)
    disclosing = settled(_disclosing(documents, entities, mentioning, limits))
    found = _pairs(mentioning).join(small_side(disclosing), ["entity", "term"])
    # "remove" sorts after "generalise" and wins; the set is bounded by the text's own words.
    marked = (
        found.groupBy(*KEY, "term").agg(F.max("action").alias("action"))
        .groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    )
    action = lambda s: F.col("actions")[F.lower(s["value"])]
    places = F.transform(
        F.filter(_located(F.col("padded"), TERM), lambda s: action(s).isNotNull()),
        lambda s: F.struct((s["start"] - 1).alias("start"), (s["stop"] - 1).alias("stop"), action(s).alias("action")))
    return mentioning.join(marked, KEY).select(*KEY, places.alias("terms"))


def _marked(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(PLACEHOLDERS[kind]).alias("put")))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))


def findings(documents: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """Per row of documents (doc_id, text): counts by kind, the base digest and all spans. Texts are not shuffled."""
    base = F.concat(*[_listed(k, F.col(k)) for k in KINDS])
    own = (
        _found(documents, F.col("doc_id"))
        .select("doc_id", *KEY, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_join(base, ",").alias("base"))
    )
    terms = _term_spans(documents, limits).select(
        *KEY, F.size("terms").cast("long").alias("n_term"), F.array_join(_listed("term", F.col("terms")), ",").alias("listed"),
    )
    return own.join(terms, KEY, "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.coalesce("n_term", F.lit(0)).alias("n_term"), F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "listed").alias("spans"),
    )


def sanitise(documents: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """All documents with the findings replaced by placeholders and disclosing terms generalised or removed."""
    names = documents.columns
    rows = _found(documents, F.struct(*[documents[c] for c in names]).alias("row")).join(_term_spans(documents, limits), KEY, "left")
    marked = [_marked(k) for k in KINDS]
    put = lambda s: F.when(s["action"] == "remove", F.lit(PLACEHOLDERS["remove"])).otherwise(F.lit(PLACEHOLDERS["generalise"]))
    marked.append(F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,action:string>>")),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), put(s).alias("put")),
    ))
    whole = F.col("whole")

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), s["put"])
        return F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(
            F.struct(F.greatest(s["stop"], acc["at"]).alias("at"), acc["out"].alias("out")))

    def rebuilt(spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole)))
        return F.when(F.size(spans) == 0, F.col("row.text")).otherwise(F.aggregate(spans, zero, step, end))

    out = rows.withColumn("clean", let(F.sort_array(F.concat(*marked)), rebuilt))
    renewed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[renewed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def op4_private_data(spark, folder: str) -> DataFrame:
    """Personal data and disclosing terms in the whole `documents` table."""
    return findings(table(spark, folder, "documents"))
