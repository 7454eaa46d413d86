"""Personal data in texts, and the terms that give it away, in DataFrame functions only.

Patterns find addresses, numbers and the like: the protected entities. Terms near their mentions may reveal them
even when they are masked, and how strongly is estimated from the corpus: with N documents, of which n(e) mention
the entity, n(t) hold the term and n(e, t) hold the term near a mention, the entity's information is
ln(N / n(e)) and the term gives away ln(N n(e, t) / (n(e) n(t))) of it. A term whose share exceeds the threshold is generalised to
its initial if that, weighed in the same way, stays below the threshold, and removed otherwise.

Documents are known by a digest of their text, so that copies are weighed as often as they occur but looked at
once; a pair counts as known only if seen in several different contexts, so copies alone are no evidence. Terms are counted map-side
over all documents. Only mentions and their near words meet in joins, so the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shardline.session import cut_lineage

#: What is matched. Possessive parts and looks behind keep long runs linear; each pattern finds what the plain
#: one in its comment finds, as no shorter match or later start within a run could succeed.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
KINDS = (*BASE, "general", "removed")
#: Words of letters with inner hyphens and apostrophes that can't be part of an address.
TERM = (
    r"(?<![\p{L}\p{M}\p{N}._%+@'’-])[\p{L}\p{M}]++(?:['’-][\p{L}\p{M}]++)*+"
    r"(?![\p{L}\p{M}\p{N}_%+@-]|\.[^\s])"
)
#: Characters on each side of a mention in which its near words are looked for.
REACH = 400
SPANS = "array<struct<kind: string, start: int, end: int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression in which a value that it names several times is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _sums(x: Column) -> Column:
    """Running sums of an array, in blocks of about the root of its size, as growing an array copies it."""

    def last(a: Column) -> Column:
        return F.element_at(a, -1)

    def running(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda a, v: F.concat(a, F.array(last(a) + v)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        before = F.slice(running(totals, F.lit(0)), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda b, o: F.slice(running(b, o), F.lit(2), F.size(b))))

    def in_blocks(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(x), width), lambda at: F.slice(x, at, width))

    summed = let(x, lambda x: F.when(F.size(x) > 0, let(in_blocks(x), joined)))
    return F.coalesce(summed, F.array().cast("array<int>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Texts that match, before they are tested; cheap tests first tell most texts apart."""
    all_ = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    return F.when(F.contains(text, F.lit(sign)), all_).otherwise(F.array().cast("array<string>")) if sign else all_


def _placed(matches: Column, pieces: Column) -> Column:
    """(start, end, value) of matches by the lengths of the pieces between them."""

    def of(m: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), m, lambda p, m: F.length(p) + F.length(m))
        return F.zip_with(m, _sums(steps), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return let(matches, of)


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names that no column has."""
    used = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def with_base_spans(rows: DataFrame, text_column: str, into: str) -> DataFrame:
    """Rows with the patterns' spans in code points by kind and start; a null text has none."""
    names = fresh(rows, *(f"m_{k}" for k in BASE))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    found = rows.select("*", *(_matches(text, k).alias(n) for k, n in zip(BASE, names, strict=True)))

    def spans(kind: str, name: str) -> Column:
        m = F.col(name)
        placed = F.filter(_placed(m, F.split(text, PATTERNS[kind], -1)), lambda x: _valid(kind, x["value"]))
        told = F.transform(placed, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"], x["end"]))
        return F.when(F.size(m) > 0, told.cast(SPANS)).otherwise(F.array().cast(SPANS))

    every = F.concat(*(spans(k, n) for k, n in zip(BASE, names, strict=True)))
    return found.select(*(f"`{c}`" for c in rows.columns), every.alias(into))


def _entity(kind: str, value: Column) -> Column:
    plain = _digits(value) if kind in ("card", "phone") else F.lower(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _initial(term: Column) -> Column:
    """What a term is generalised to; the mark before it keeps it apart from terms."""
    return F.concat(F.lit("="), F.substring(term, 1, 1))


def _near(kind: str, matches: Column, text: Column, window: int) -> Column:
    """(entity, near words, lower case) of every mention of a kind."""

    def words(part: Column, cut: Column, from_end: bool) -> Column:
        """The window's words, without one that may be cut at the far end."""
        all_ = F.transform(F.regexp_extract_all(part, F.lit(TERM), F.lit(0)), F.lower)
        all_ = F.reverse(all_) if from_end else all_
        short = lambda w: cut & F.size(w).between(1, window)
        return let(all_, lambda w: F.slice(w, F.lit(1), F.when(short(w), F.size(w) - 1).otherwise(window)))

    def around(x: Column) -> Column:
        left = words(F.right(x["l"], F.lit(REACH)), F.length(x["l"]) > REACH, True)
        return F.concat(left, words(F.left(x["r"], F.lit(REACH)), F.length(x["r"]) > REACH, False))

    at = let(
        F.split(text, PATTERNS[kind], -1),
        lambda p: F.transform(
            matches, lambda m, i: F.struct(m.alias("value"), F.get(p, i).alias("l"), F.get(p, i + 1).alias("r"))
        ),
    )
    return F.transform(
        F.filter(at, lambda x: _valid(kind, x["value"])),
        lambda x: F.struct(_entity(kind, x["value"]).alias("entity"), F.array_distinct(around(x)).alias("words")),
    )


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _with_initials(words: Column) -> Column:
    return let(words, lambda w: F.concat(w, F.array_distinct(F.transform(w, _initial))))


def disclosures(
    rows: DataFrame, text_column: str, window: int = 8, support: int = 2, threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Weighed pairs of entities and terms, and for each text (``key``) its ``terms`` that exceed the threshold.

    Both are tables of the shared folder. ``pairs`` has every (``entity``, ``term``) near each other in ``support``
    different contexts or more, the counts, ``share`` (of the entity's information that the term gives away, at
    most 1) and ``action`` (general, removed or null). ``window`` is in words to each side. An entity that every document
    mentions has no information to give away.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    texts = rows.select(text.alias("text"))
    spark = rows.sparkSession
    counted = texts.select(
        F.explode(F.array_append(
            _with_initials(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))), F.lit("")
        )).alias("term")
    )
    # every document counts once for the empty term
    terms = counted.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))

    names = [f"m_{k}" for k in BASE]
    found = texts.select("text", *(_matches(F.col("text"), k).alias(n) for k, n in zip(BASE, names, strict=True)))
    none = F.array().cast("array<struct<entity: string, words: array<string>>>")
    near = F.concat(
        *(
            F.when(F.size(n) > 0, _near(k, F.col(n), F.col("text"), window)).otherwise(none)
            for k, n in zip(BASE, names, strict=True)
        )
    )
    holding = found.filter(" OR ".join(f"size({n}) > 0" for n in names)).select(
        text_key(F.col("text")).alias("key"), near.alias("near")
    )
    once = holding.filter("size(near) > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.any_value("near").alias("near"))
    mentions = cut_lineage(
        once.select("key", "n", F.explode("near").alias("m")).select("key", "n", "m.entity", "m.words"), "mentions"
    )
    with_entity = mentions.groupBy("entity", "key").agg(F.max("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("with_entity"))
    context = F.xxhash64(F.array_join(F.array_sort("words"), " "))
    each = mentions.select("key", "n", "entity", context.alias("context"), F.explode(_with_initials(F.col("words"))).alias("term"))
    texts_of = cut_lineage(
        each.groupBy("entity", "term", "key").agg(F.max("n").alias("n"), F.min("context").alias("context")), "near"
    )
    seen = texts_of.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count_distinct("context").alias("contexts"))
    known = cut_lineage(seen.filter(F.col("contexts") >= support), "known")
    # the number of documents comes along with the terms' counts, and has one row
    counts = cut_lineage(terms.join(known.select("term").distinct().union(spark.sql("SELECT ''")), "term", "left_semi"), "terms")
    documents = counts.filter("term = ''").agg(F.coalesce(F.first("with_term"), F.lit(0))).first()[0]
    information = F.log(F.lit(float(documents)) / F.col("with_entity"))
    gives = F.log(F.lit(float(documents)) * F.col("both") / (F.col("with_entity") * F.col("with_term")))
    weighed = (
        known.join(with_entity.filter(F.col("with_entity") < documents), "entity")
        .join(counts, "term")
        .withColumn("share", F.least(gives / information, F.lit(1.0)))
    )
    letters = weighed.filter("term LIKE '=%'").select(
        "entity", F.col("term").alias("initial"), (F.col("share") >= threshold).alias("tells")
    )
    # the initial of a pair that is known is known as well
    pairs = (
        weighed.filter("term NOT LIKE '=%'")
        .withColumn("initial", _initial(F.col("term")))
        .join(letters, ["entity", "initial"], "left")
        .withColumn("action", F.expr(f"if(share >= {threshold!r}D, if(tells, 'removed', 'general'), NULL)"))
        .select("entity", "term", "both", "contexts", "with_entity", "with_term", "share", "action")
    )
    pairs = cut_lineage(pairs, "pairs")
    told = texts_of.join(pairs.filter("action IS NOT NULL").select("entity", "term", "action"), ["entity", "term"])
    # removed where any of the entities asks for it
    of_text = told.groupBy("key", "term").agg(F.max("action").alias("action"))
    flagged = of_text.groupBy("key").agg(F.collect_list(F.struct("term", "action")).alias("terms"))  # words near its mentions
    return pairs, cut_lineage(flagged, "flagged")


def sanitise(
    rows: DataFrame,
    text_column: str,
    spans: str = "spans",
    sanitised: str = "sanitised",
    window: int = 8,
    support: int = 2,
    threshold: float = 0.8,
) -> DataFrame:
    """Rows with all spans (by kind as listed in KINDS, then start), and the text without them.

    ``spans`` has kind, start and end (exclusive) in code points. The patterns' spans don't depend on the corpus; terms that give
    away an entity near them are added wherever they stand in that text. In ``sanitised`` a pattern's span becomes
    its kind in brackets, a generalised term its initial and a full stop, a removed one ``[...]``; kinds are masked
    in their order, each in what the one before left. A null text has no spans and stays null, an empty text empty. Repeated rows stay
    repeated, ids play no part, and an empty table gives an empty one. The two names must not be columns of ``rows``.
    """
    if {spans, sanitised} & set(rows.columns):
        raise ValueError("the names of the results are taken")
    _, flagged = disclosures(rows, text_column, window, support, threshold)
    key, terms, base = fresh(rows, "key", "terms", "base")
    text = F.col(f"`{text_column}`")
    found = with_base_spans(rows, text_column, base).withColumn(key, text_key(text))
    found = found.join(flagged.select(F.col("key").alias(key), F.col("terms").alias(terms)), key, "left")
    asked = F.map_from_entries(terms)
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    each = F.transform(
        _placed(words, F.split(text, TERM, -1)),
        lambda x: F.struct(F.try_element_at(asked, F.lower(x["value"])).alias("kind"), x["start"], x["end"]),
    ).cast(SPANS)
    added = F.filter(each, lambda x: x["kind"].isNotNull())
    added = F.concat(*(F.filter(added, _is_kind(k)) for k in KINDS[len(BASE) :]))
    found = found.withColumn(spans, F.when(F.col(terms).isNotNull(), F.concat(F.col(base), added)).otherwise(F.col(base)))
    return found.select(
        *(f"`{c}`" for c in rows.columns), F.col(f"`{spans}`"), _rewritten(text, F.col(f"`{spans}`"), asked).alias(sanitised)
    )


def _masked(text: Column, pattern: str, mark: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern put otherwise."""
    matches = F.array_append(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(""))
    parts = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.concat(p, F.when(m == "", "").otherwise(mark(m))))
    return F.array_join(parts, "")


def _rewritten(text: Column, spans: Column, asked: Column) -> Column:
    """The text without its spans: the terms first, which no pattern's span overlaps, then kind after kind."""

    def term(m: Column) -> Column:
        action = F.try_element_at(asked, F.lower(m))
        initial = F.concat(F.substring(m, 1, 1), F.lit("."))
        return F.when(action == "general", initial).when(action == "removed", F.lit("[...]")).otherwise(m)

    out = F.when(asked.isNotNull(), _masked(text, TERM, term)).otherwise(text)
    for kind in BASE:
        out = let(out, _masker(kind, F.exists(spans, _is_kind(kind))))
    return out


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _masker(kind: str, there: Column) -> Callable[[Column], Column]:
    return lambda t: F.when(there, _masked(t, PATTERNS[kind], _marks(kind))).otherwise(t)


def _marks(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.when(_valid(kind, m), F.lit(f"[{kind}]")).otherwise(m)
