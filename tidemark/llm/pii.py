"""Personal data: pattern spans, and terms that disclose the people behind them (DataFrame functions only).

Base spans are e-mail addresses, IP addresses, card and phone numbers. Beyond them, a term can give an entity away
even when the entity itself is masked. How much it gives away is estimated from the corpus: with bags
(the set of words of a document, copies counted once) as the unit of every count, the pointwise mutual information
of term and entity, as a share of the entity's own information content, is the part of the entity that
the term discloses. Most values are too rare for evidence of their own, so it is pooled as well: by the domain of
e-mail addresses, and by kind. Terms above the upper threshold are removed from the entity's documents, terms above
the lower one are generalised to the entity's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, fits, small_join, stage

#: The patterns by kind, in the order of the output. They find what the plain patterns find (e-mail
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`` and so on) but never go back over what they have read, so
#: that a run of 100,000 letters or digits takes linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Distinct contexts of an entity in which a term must occur before anything is concluded.
SUPPORT = 3
#: Shares of an entity's information from which a term is removed, or generalised.
REMOVE, GENERALISE = 0.9, 0.75
TERM = r"\p{L}{2,}"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts double, less nine if over nine."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0))),
    )
    return total % 10 == 0


#: Fixed value: a number of at most 255, leading zeros allowed.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _sums(sizes: Column, chunk: int = 256) -> Column:
    """Running totals of an array, in chunks, so that long arrays don't take quadratic time."""
    running = lambda part, start: F.slice(F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, F.greatest(F.size(part), F.lit(0)))
    one = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + x)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int")), lambda k: F.slice(sizes, k * chunk + 1, F.lit(chunk)))
    before = F.aggregate(F.transform(parts, one), F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    whole = F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.when(p.isNotNull() & b.isNotNull(), running(p, b))))
    return F.when(F.size(sizes) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _sized(gap: Column, found: Column) -> Column:
    return F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(found).cast("bigint").alias("size"))


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value) of all matches that pass, in code points, in order.

    What lies between the matches gives the offsets: a match starts after all gaps and matches before it.
    """
    nothing = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    ends = _sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
    zipped = F.arrays_zip(found.alias("m"), ends.alias("e"))
    made = F.transform(
        F.filter(zipped, lambda x: _valid(kind, x["m"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), (x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("value")),
    )
    return F.when(text.rlike(pattern), made).otherwise(nothing)


def base(docs: DataFrame, *keep: str, **more: Column) -> DataFrame:
    """``keep`` and ``more`` columns of all documents, _row (a number of the row), and one array of spans per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [c.alias(n) for n, c in more.items()]
    return docs.select(*keep, *more, F.monotonically_increasing_id().alias("_row"), *[spans_of(text, k, p).alias(f"s_{k}") for k, p in PATTERNS.items()])


def _entities(spans: Column) -> Column:
    """The entities that spans name, each once: kind and value without case and punctuation, domain of e-mails, and kind."""
    value = lambda s: F.concat(s["kind"], F.lit(":"), F.regexp_replace(F.lower(s["value"]), r"[\x20()+-]", ""))
    domains = F.transform(F.filter(spans, lambda s: s["kind"] == "email"), lambda s: F.concat(F.lit("email:@"), F.lower(F.substring_index(s["value"], "@", -1))))
    return F.array_distinct(F.concat(F.transform(spans, value), domains, F.transform(spans, lambda s: s["kind"])))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _plain(text: Column) -> Column:
    """The text without e-mail addresses: an address is no context of its own."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def _words() -> Column:
    """The words of the text, each once."""
    return F.array_distinct(terms(_plain(F.col("text"))))


def _bag(words: Column) -> Column:
    """The same number for the same set of words, whatever their order."""
    return F.xxhash64(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))))


def _term_counts(docs: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """t (hash of a term), n_term: the bags with the term. ``sizes``: bag and n, the rows with it.

    A bag of one row is counted where it is read. Of bags that copies repeat, as long as they fit a broadcast, term and bag
    meet once after copies were combined map-side; beyond it each bag's words move once, combined map-side as well.
    """
    repeated = sizes.filter("n > 1").select("bag", F.col("bag").alias("copies"))
    every = docs.select(_words().alias("words")).withColumn("bag", _bag(F.col("words")))
    t = F.transform("words", lambda w: F.xxhash64(w))
    if not fits(repeated, rows):
        return every.dropDuplicates(["bag"]).select(F.explode(t).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_term"))
    told = every.join(F.broadcast(repeated), "bag", "left").select("copies", F.explode(t).alias("t"))
    told = told.groupBy("t", "copies").agg(F.count(F.lit(1)).alias("n"))
    return told.groupBy("t").agg(F.sum(F.when(F.col("copies").isNull(), F.col("n")).otherwise(1)).alias("n_term"))


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, least: float = GENERALISE, rows: int = BROADCAST_ROWS) -> DataFrame:
    """entity, term, share: terms that disclose at least ``least`` of an entity's information.

    ``found`` is what ``base`` gives, with texts and bags. The unit of every count is the bag, a distinct set of words that is the text of
    some document: copies are one bag and no evidence. An entity's probability is the share of bags that
    name it; given a term, it is the share of the term's bags, smoothed by one more bag at the plain odds.
    """
    spans = F.concat(*[F.col(f"s_{k}") for k in PATTERNS])
    named = stage(found.filter(F.size(spans) > 0).select("bag", _entities(spans).alias("entities"), _words().alias("words")), "pii-named")
    contexts = named.select(F.explode("entities").alias("entity"), "bag").distinct()
    # Only entities with as many contexts can have a term with them, so the others are left out before words are counted.
    alone = stage(contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support), "pii-alone")
    bags = named.select("bag", "words").dropDuplicates(["bag"])
    joint = small_join(contexts, alone.select("entity"), "entity").join(bags, "bag").select("entity", F.explode("words").alias("term"))
    joint = stage(joint.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support), "pii-joint")
    sizes = stage(found.groupBy("bag").agg(F.count(F.lit(1)).alias("n")), "pii-bags")
    both = joint.withColumn("t", F.xxhash64("term")).join(_term_counts(docs, sizes, rows), "t").join(alone, "entity")
    p_e = F.col("n_entity") / F.lit(float(max(1, sizes.count())))
    given = (F.col("both") + p_e) / (F.col("n_term") + 1)
    information, mutual = -F.log2(p_e), F.log2(given / p_e)
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    return both.select("entity", "term", share.alias("share")).filter(F.col("share") >= least)


def find(docs: DataFrame, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, base (array of kind, start, end), extra (array of kind, start, end, share).

    ``extra`` holds the occurrences of disclosing terms in documents that name the entity, outside of base
    spans: kind ``term`` if they are to be removed, ``generalised`` if they are to be replaced by the kind of
    entity. Null is an empty text. Documents without base spans never have extra ones; unless ``whole``, their
    text is left out.
    """
    every = F.concat(*[F.col(f"s_{k}") for k in PATTERNS])
    found = base(docs, "doc_id", "text", bag=_bag(_words()))
    found = stage(found if whole else found.withColumn("text", F.when(F.size(every) > 0, F.col("text"))), "pii-found")
    telling = disclosing(docs, found, support, generalise)
    # An entity's terms can be many, so a row asks for those alone that it holds.
    named = found.filter(F.size(every) > 0).select("_row", _entities(every).alias("entities"), _words().alias("words"))
    named = named.select("_row", "words", F.explode("entities").alias("entity")).select("_row", "entity", F.explode("words").alias("term"))
    pairs = small_join(named, stage(telling, "pii-telling"), ["entity", "term"]).groupBy("_row", "term").agg(F.max("share").alias("share"))
    told = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_terms"))
    matches = spans_of(F.coalesce(F.col("text"), F.lit("")), "term", TERM)
    rows = small_join(found, stage(told, "pii-told"), "_row", "left")
    hit = F.filter(matches, lambda m: F.map_contains_key(F.col("_terms"), F.lower(m["value"])) & ~F.exists(F.col("_base"), lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    extra = F.transform(hit, lambda m: F.struct(F.when(F.element_at(F.col("_terms"), F.lower(m["value"])) >= remove, F.lit("term")).otherwise(F.lit("generalised")).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.element_at(F.col("_terms"), F.lower(m["value"])).alias("share")))
    plain = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.select("doc_id", "text", plain.alias("base"), F.col("_terms"), F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_base"))
    nothing = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,share:double>>)")
    return rows.select("doc_id", "text", "base", F.when(F.col("_terms").isNull(), nothing).otherwise(extra).alias("extra"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    Null counts as an empty text, without spans; repeated rows each get a row; an empty table gives none; other columns are
    ignored. Whole texts are read.
    """
    rows = find(docs, **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    extra = F.array_sort(F.transform("extra", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    extra = F.concat(F.filter(extra, lambda s: s["kind"] == "term"), F.filter(extra, lambda s: s["kind"] != "term"))
    return rows.select("doc_id", *[count(k) for k in PATTERNS], F.size("extra").cast("bigint").alias("n_term"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(F.col("base"), extra)).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with every span replaced: entities by their kind, generalised terms by ``[context]``, others by nothing.

    Where spans overlap, the one that starts first (of those, the longest) is replaced and the others go with it. A null text
    becomes an empty one, repeated rows each get a row, an empty table gives none, and other columns are left out.
    """
    rows = find(docs, whole=True, **options)
    spans = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))), F.transform("extra", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind")))))
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("out"))
    label = lambda k: F.when(k == "term", "").when(k == "generalised", "[context]").otherwise(F.concat(F.lit("["), k, F.lit("]")))
    step = lambda a, s: F.when(s["start"] < a["end"], a).otherwise(F.struct((-s["neg"]).alias("end"), F.concat(a["out"], F.array(F.substring(text, (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), label(s["kind"]))).alias("out")))
    made = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["end"] + 1).cast("int"), F.length(text))))
    return rows.select("doc_id", made.alias("text"))
