"""PII: pattern spans, and information-theoretic sanitisation of the terms that go with them.

Personal data found by pattern (email, ip, card, phone) are the protected
entities. A term that stands in the same document as an entity, at any distance,
may give the entity away even where the entity itself is removed. How strongly
is estimated from the whole corpus: of an entity's information log2(N / n_e), a
term with it in n_te of its n_t documents leaves -log2(n_te / n_t) bits, and
gives the rest away (their pointwise mutual information). n_te / n_t is lowered
by ERRORS standard errors with the different texts as evidence (copies count
once), so that a term of one text leaves a whole bit, of two 0.58, of three
0.42. A term that leaves at most REMOVE bits is removed wherever it stands in
documents with that entity (kind ``reveal``), one that leaves at most GENERALISE
(the entity is as likely as not) is generalised (kind ``hint``). Both limits mean the same in a corpus of any
size. A term must also give away SHARE of the entity's information, or chance
alone would mark the terms that go with an entity of very many documents. Terms
are those of the whole text outside its pattern spans.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spans import count_kind, joined, listed, matches, named, rebuilt, replaced
from riskloom.llm.store import stored

# A match can only begin where its run begins or where the last match ended; with that said,
# possessive repeats match the same spans as plain ones, in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{3,}+"
KINDS = ("email", "ip", "card", "phone", "reveal", "hint")
ERRORS = 1.0          # standard errors by which few texts lower an estimate
REMOVE, GENERALISE = 0.5, 1.0   # bits of the entity that a term leaves open, at most
SHARE = 0.5           # of the entity's information that a term gives away, at least
SLOTS = 256           # maps over which a text's marked terms are dealt
TERM_PART = 1024      # terms of a text that meet its entities under one key
SHOWN = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "reveal": "", "hint": "[TERM]"}


def _octets(m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")

    def weigh(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0),
                        lambda a, v: a + F.coalesce(v, F.lit(0)))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """Sorted array of struct(s, k, e, kind, m) of the four pattern kinds."""
    email = matches(text, EMAIL, text.contains("@"))
    ip = F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda x: _octets(x["m"]))
    card = F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda x: _luhn(x["m"]))
    phone = F.filter(matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(
        F.regexp_replace(x["m"], "[^0-9]", "")).between(9, 15))
    return F.array_sort(F.concat(*[named(v, kind, k) for k, (kind, v) in enumerate(
        (("email", email), ("ip", ip), ("card", card), ("phone", phone)))]))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with every code point of the non-overlapping ``spans`` made a space."""
    return rebuilt(text, spans, lambda x: F.repeat(F.lit(" "), x["e"] - x["s"]))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, rest, terms): key names the text if it has spans, rest is then the text
    with them blanked; terms are the distinct terms of the whole text outside its spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    has = F.size("base") > 0
    rows = rows.withColumn("rest", F.when(has, _blanked(F.col("text"), joined(F.col("base")))).otherwise(F.col("text")))
    terms = F.array_distinct(F.transform(F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)), F.lower))
    return stored(rows.select("doc_id", F.when(has, F.md5("text")).alias("key"), "base",
                              F.when(has, F.col("rest")).alias("rest"), terms.alias("terms")), "pii")


def _texts(found: DataFrame) -> DataFrame:
    """(key, copies, entities, terms, rest) of every text with spans, once for equal texts."""
    entities = F.array_distinct(F.transform("base", lambda x: F.concat_ws(":", x["kind"], F.lower(x["m"]))))
    return stored(found.where("key is not null").groupBy("key")
                  .agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("terms").alias("terms"),
                       F.first("rest").alias("rest"))
                  .select("key", "copies", entities.alias("entities"), "terms", "rest"), "texts")


def _pairs(found: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(key, copies, entity, term, n_t, n_e) of the entities and terms of every text.

    Left out are only terms in so many documents that they leave more than
    GENERALISE bits even if all documents of the entity hold them, and entities
    of all documents. The terms of a long text meet its entities in parts, so
    that a text of very many of both spreads over tasks.
    """
    most = F.col("n_e") * (2.0 ** GENERALISE * (1 + 1e-9))
    with_entity = stored(texts.select("copies", F.explode("entities").alias("entity"))
                         .groupBy("entity").agg(F.sum("copies").alias("n_e"))
                         .where(F.col("n_e") < n).withColumn("most", most), "entities")
    top = with_entity.agg(F.max("most")).first()[0] or 0.0
    # documents of every term of the corpus, added up in each task before rows move or meet a candidate
    with_term = (found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
                 .where(F.col("n_t") <= top))
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("terms"), F.lit(1)) - 1) / TERM_PART).cast("int"))
    holds = (texts.select("key", "copies", parts.alias("parts"), F.explode("entities").alias("entity"))
             .join(with_entity, "entity").withColumn("part", F.explode("parts")).drop("parts"))
    terms = (texts.select("key", F.posexplode("terms").alias("part", "term"))
             .withColumn("part", F.floor(F.col("part") / TERM_PART).cast("int")).join(with_term, "term"))
    return stored(holds.join(terms, ["key", "part"]).where("n_t <= most")
                  .select("key", "copies", "entity", "term", "n_t", "n_e"), "pairs")


def disclosure(pairs: DataFrame, n: int, errors: float = ERRORS) -> DataFrame:
    """(entity, term, contexts, bits, share): what the term leaves open and gives away of the entity's information.

    n_te / n_t is lowered by ``errors`` standard errors (Wilson's lower bound),
    the texts that hold both (contexts) being its evidence: few texts leave more open.
    """
    p, z = F.col("n_te") / F.col("n_t"), F.lit(float(errors ** 2))
    trials = F.col("contexts") / p
    low = (p + z / (2 * trials) - F.sqrt(z * (p * (1 - p) / trials + z / (4 * trials * trials)))) / (1 + z / trials)
    return (pairs.groupBy("entity", "term")
            .agg(F.sum("copies").alias("n_te"), F.count("*").alias("contexts"), F.first("n_t").alias("n_t"),
                 F.first("n_e").alias("n_e"))
            .select("entity", "term", "contexts", (-F.log2(low)).alias("bits"),
                    (1 + F.log2(low) / F.log2(F.lit(float(n)) / F.col("n_e"))).alias("share")))


def _slot(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(SLOTS))


def _dealt(marked: DataFrame) -> DataFrame:
    """(key, kinds) of rows (key, term, k): a map of slot to a map of term to k, as a map is searched entry by entry."""
    return (marked.groupBy("key", _slot(F.col("term")).alias("slot"))
            .agg(F.map_from_entries(F.collect_list(F.struct("term", "k"))).alias("terms"))
            .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "terms"))).alias("kinds")))


def _places(text: Column, kinds: Column) -> Column:
    """Sorted array of struct(s, k, e, kind, m) of every mention of a term in ``kinds`` (from ``_dealt``)."""
    def mention(x: Column) -> Column:
        term = F.lower(x["m"])
        k = F.try_element_at(F.try_element_at(kinds, _slot(term)), term)
        return F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e"))

    marked = F.filter(F.transform(matches(text, TERM, F.lit(True)), mention), lambda x: x["k"].isNotNull())
    return F.transform(marked, lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"),
        F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), F.lit("").alias("m")))


def _term_spans(found: DataFrame) -> DataFrame:
    """(key, more): the added spans of each text that has any, wherever in the text they stand."""
    n, texts = found.count(), _texts(found)
    pairs = _pairs(found, texts, n)
    strong = disclosure(pairs, n).where((F.col("bits") <= GENERALISE + 1e-9) & (F.col("share") >= SHARE)).drop("contexts")
    kind = F.when(F.col("bits") <= REMOVE, F.lit(4)).otherwise(F.lit(5))
    kinds = _dealt(pairs.select("key", "entity", "term").join(strong, ["entity", "term"])
                   .groupBy("key", "term").agg(F.min(kind).alias("k")))
    return stored(texts.select("key", "rest").join(kinds, "key")
                  .select("key", _places(F.col("rest"), F.col("kinds")).alias("more")), "terms")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, counts by kind, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) of the pattern
    spans and of the added terms by start, then kind; ``base_sha256`` is the
    digest of the pattern spans alone. A text is searched whole at any length;
    n spans in it take time in proportion to n * sqrt(n). Defined cases: a null or empty text has
    no spans (digest of the empty string, spans empty); rows that repeat a
    doc_id or a text are answered each; a null doc_id stays null; an empty
    table gives no rows. Other columns are not read.
    """
    found = _found(docs)
    more = _term_spans(found)
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(found.schema["base"].dataType))))
    rows = found.select("doc_id", "key", "base").join(more, "key", "left").withColumn("spans_all", spans)
    return rows.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans_all")).alias("spans"),
        *[count_kind(F.col("spans_all"), k).alias(f"n_{k}") for k in KINDS[4:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind, revealing terms removed, hinting terms generalised.

    Columns are those of ``docs``; n_chars, if there, follows the text. A text
    without spans stays as it is, null included. Overlapping spans are replaced
    together, by the kind of the first.
    """
    names = docs.columns
    found = _found(docs)
    more = _term_spans(found)
    rows = docs.withColumn("__base", base_spans(F.coalesce(F.col("text").cast("string"), F.lit("")))) \
        .withColumn("__key", F.when(F.size("__base") > 0, F.md5("text")))
    rows = rows.join(more.withColumnRenamed("key", "__key").withColumnRenamed("more", "__more"), "__key", "left")
    spans = F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast(found.schema["base"].dataType))))
    rows = rows.withColumn("__spans", joined(spans))
    new = F.when(F.size("__spans") > 0, replaced(F.col("text"), F.col("__spans"), SHOWN)).otherwise(F.col("text"))
    rows = rows.withColumn("text", new)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long"))
                               .otherwise(F.col("n_chars")))
    return rows.select(*names)
