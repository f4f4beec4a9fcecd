"""Personal data: patterns, and terms that give protected entities away (information-theoretic).

Base spans are emails, ip addresses, card and phone numbers by pattern and check. The entities found
are protected. A word discloses an entity as far as the one predicts the other: with counts of
documents over the whole corpus, the pointwise mutual information of word and entity, as a share of
the entity's information content. A document counts for a word that stands anywhere in it outside
base spans, for an entity that it holds, and for both if it does both, however far apart they stand.
Words whose share reaches the threshold, seen with the entity in at least ``MIN_DOCUMENTS``
documents, are spans of kind ``term`` wherever they stand in documents that hold that entity.
Sanitising generalises an entity to its kind and removes such terms.

All steps are built-in expressions, joins and grouped counts. Runs are matched without backtracking,
so a text of one very long run costs linear time.

A null text is empty and has no spans. Repeated rows each get their spans; rows without a doc_id too.
Offsets count code points, ends are exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import stored
from casemetrics.operators.sizing import fits_broadcast, lookup_join

KINDS = ["email", "ip", "card", "phone"]
DISCLOSURE = 0.8
MIN_DOCUMENTS = 2
#: Stand-ins of one code point for a separator inside a run; such characters of a text are masked first.
_JOIN, _DOT, _MASK = "\ue000", "\ue001", "\ue002"
_WORD = r"[\p{L}\p{N}]"


def _spans(text: Column, pattern: Column | str, kind: str, good) -> Column:
    """Non-overlapping matches with their places, from the pieces between matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("gap"))
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>").alias("out"))

    def add(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    located = F.aggregate(zipped, step, add, lambda state: state["out"])
    return F.filter(located, lambda s: good(s["text"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.reverse(_digits(text))
    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda sum_, i: sum_
        + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int")
            + F.substring(digits, i, F.lit(1)).cast("int") * 2 % 10
        ),
    )
    return total % 10 == 0


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")


def base_spans(text: Column) -> Column:
    """The spans of all four kinds, each leftmost and without overlaps in its kind."""
    masked = F.translate(text, _JOIN + _DOT, _MASK + _MASK)
    dotted = F.regexp_replace(masked, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    local = f"[A-Za-z0-9._%+{_DOT}-]"
    email = f"(?:\\G|(?<!{local})){local}++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]*+"
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    joined = F.regexp_replace(masked, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
    card = f"[0-9{_JOIN}]{{12,}}+"
    phone = r"\+[0-9][ ().0-9-]+[0-9]"

    def fits_ip(x: Column) -> Column:
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.ltrim(F.lit("0"), p)) <= 3) & F.forall(
            F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255
        )

    def fits_card(x: Column) -> Column:
        return F.when(F.length(_digits(x)).between(12, 19), _luhn(x)).otherwise(False)

    def fits_phone(x: Column) -> Column:
        return F.length(_digits(x)).between(9, 15)

    has_digits = F.col("_digits")
    parts = [
        F.when(F.col("_at"), _spans(dotted, email, "email", lambda x: F.lit(True))).otherwise(_none()),
        F.when(has_digits, _spans(text, ip, "ip", fits_ip)).otherwise(_none()),
        F.when(has_digits, _spans(joined, card, "card", fits_card)).otherwise(_none()),
        F.when(F.col("_plus"), _spans(text, phone, "phone", fits_phone)).otherwise(_none()),
    ]
    return F.concat(*parts)


def with_base(docs: DataFrame) -> DataFrame:
    """Add ``_text`` and ``_base``; a pattern only runs where its sign or a digit run is present."""
    text = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    signs = text.withColumns(
        {"_at": F.col("_text").contains("@"), "_plus": F.col("_text").contains("+"), "_digits": F.col("_text").rlike("[0-9]{2}|[0-9][. -][0-9]")}
    )
    return signs.withColumn("_base", base_spans(F.col("_text"))).drop("_at", "_plus", "_digits")


def _words() -> Column:
    """Distinct lower-cased words of ``_text`` outside the spans of ``_base``."""
    order = F.array_sort(F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state, s):
        between = F.substring(F.col("_text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], between, F.lit(" ")).alias("out"))

    rest = F.aggregate(order, begin, cut, lambda state: F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, F.length("_text"))))
    outside = F.when(F.size("_base") > 0, rest).otherwise(F.col("_text"))
    return F.array_remove(F.array_distinct(F.split(F.lower(outside), rf"[^\p{{L}}\p{{N}}]+")), "")


def disclosing(docs: DataFrame, min_share: float = DISCLOSURE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The terms of each text (by ``_row``) that give one of its entities away.

    ``docs`` has ``_text``, its hash ``_row`` and ``_base``. Entities and words of documents that hold
    an entity are stored once. Documents are counted by entity first, so that only entities in enough
    of them meet words; pairs are counted map-side, and the documents of a term only for terms of
    such pairs. Rows of hot entities and terms are spread where a lookup is too large to broadcast.
    """
    total = docs.count()
    entities = F.array_distinct(F.transform("_base", lambda s: F.xxhash64(s["text"])))
    held = docs.filter(F.size("_base") > 0).select("_row", entities.alias("entities"), _words().alias("terms"))
    held = stored(held.withColumn("_at", F.monotonically_increasing_id()))
    mentions = held.select("_at", "_row", F.explode("entities").alias("entity"), "terms")
    known = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"))
    known = stored(known.filter(F.col("n_entity").between(min_documents, total - 1)))
    fits = fits_broadcast(known)
    met = lookup_join(mentions, known, ["entity"], fits, "inner", ["_at"]).select("entity", "n_entity", F.explode("terms").alias("term"))
    pairs = met.groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both"))
    pairs = stored(pairs.filter(F.col("n_both") >= min_documents))
    terms = pairs.select("term").distinct()
    words = docs.select(F.explode(_words()).alias("term"))
    if fits_broadcast(terms):
        words = words.join(F.broadcast(terms), "term", "left_semi")
    often = stored(words.groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") >= min_documents))
    joined = lookup_join(pairs, often, ["term"], how="inner", spread_by=["entity"])
    shared = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    told = joined.filter(shared >= F.lit(min_share) * content).groupBy("entity").agg(F.collect_set("term").alias("told"))
    told = stored(told)
    fits = fits_broadcast(told.select("entity", F.array_join("told", " ")))
    found = lookup_join(mentions.select("_row", "entity").distinct(), told, ["entity"], fits, "inner", ["_row"])
    return found.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("told"))).alias("_terms"))


def find(docs: DataFrame, min_share: float = DISCLOSURE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows and columns with ``_text``, ``_base`` and ``_added`` (spans of disclosing terms)."""
    based = with_base(docs).withColumn("_row", F.xxhash64("_text"))
    terms = stored(disclosing(based, min_share, min_documents))
    if fits_broadcast(terms.select("_row", F.array_join("_terms", " "))):
        terms = F.broadcast(terms)
    joined = based.join(terms, "_row", "left")
    quoted = F.array_join(F.transform(F.array_sort("_terms"), lambda t: t), "|")
    pattern = F.concat(F.lit(f"(?iu)(?<!{_WORD})(?:"), quoted, F.lit(f")(?!{_WORD})"))
    spans = _spans(F.col("_text"), F.coalesce(pattern, F.lit("(?!)")), "term", lambda x: F.lit(True))
    added = F.when(F.col("_terms").isNotNull(), spans).otherwise(_none())
    return joined.withColumn("_added", added).drop("_row", "_terms")


def _ordered(spans: Column) -> Column:
    order = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            reduce(lambda c, k: c.when(s["kind"] == k[1], k[0]), enumerate(KINDS), F.when(s["kind"] == "term", 9)).alias("rank"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    )
    return F.array_sort(order)


def digest(spans: Column) -> Column:
    """Spans as text: kind:start:end by start, then kind."""
    return F.array_join(F.transform(_ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Per row the counts by kind, a hash of the base spans, and all spans."""
    found = find(docs.select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    every = F.concat("_base", "_added")
    return found.select("doc_id", *counts, F.sha2(digest(F.col("_base")), 256).alias("base_sha256"), digest(every).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """All rows and columns with entities of ``text`` generalised to their kind, terms removed.

    Of overlapping spans the one that starts first stands, the longer one among equals.
    """
    found = find(docs)
    order = F.array_sort(
        F.transform(
            F.concat("_base", "_added"),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")),
        )
    )
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state, s):
        end = -s["back"]
        between = F.substring(F.col("_text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.when(s["start"] < state["at"], F.struct(F.greatest(state["at"], end).alias("at"), state["out"].alias("out"))).otherwise(
            F.struct(end.alias("at"), F.concat(state["out"], between, name).alias("out"))
        )

    clean = F.aggregate(order, begin, add, lambda state: F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, F.length("_text"))))
    text = F.when(F.size(F.concat("_base", "_added")) > 0, clean).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
